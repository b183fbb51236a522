import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from llm_fixtures import LONG, no_docs, odd, odd_rows  # noqa: F401
from revmine.llm import importance as I


def features(text, n_buckets=I.N_BUCKETS):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    f = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    return len(w), [zlib.crc32(x.encode()) % n_buckets for x in f]


def brute(docs, items, percent=25, least=20, n_buckets=I.N_BUCKETS):
    each = [(i, *features(t, n_buckets)) for i, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in items for b in features(x, n_buckets)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out, able = [], []
    for i, n, f in each:
        g = [math.floor(1000 * math.log((t[b] + 1) * (ss + n_buckets) / ((s[b] + 1) * (tt + n_buckets)))) for b in f]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(f), weight, score, None])
        if n >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[4], -math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "漢字", "x" * 70, "Zed", "don", "a"]
    return [(i, " ".join(rng.choice(vocab) + rng.choice(["", ",", " -", "\n"]) for _ in range(rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("max_words", [0, 5, 50_000])
def test_equals_brute_force_with_any_dictionary(spark, max_words):
    rng = random.Random(1)
    docs, items = corpus(rng, 120), [t for _, t in corpus(rng, 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = I.resample(df, target, max_words=max_words)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    assert [r["rank"] for r in got.where("rank is not null").orderBy("rank").collect()] == list(range(1, 25 * sum(f[1] >= 20 for f in brute(docs, items)) // 100 + 1))


@pytest.mark.parametrize("n_buckets", [7, 65_536, 70_000])
def test_other_numbers_of_buckets(spark, n_buckets):
    rng = random.Random(2)
    docs, items = corpus(rng, 40), [t for _, t in corpus(rng, 3)]
    got = I.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in items], "text string"), n_buckets=n_buckets, percent=50)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 50, n_buckets=n_buckets)


@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=400)), min_size=1, max_size=20))
@settings(max_examples=80, deadline=None)
def test_composed_checksums(pairs):
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    n = np.array([len(p[1]) for p in pairs])
    assert (I.shift(a, n) ^ b).tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_checksum_before_a_very_long_word():
    for n in (4_097, 65_536, 1_000_003):
        got = I.shift(np.array([zlib.crc32(b"ab "), 5], np.uint32), np.array([n, 3]))
        assert int(got[0]) ^ zlib.crc32(b"y" * n) == zlib.crc32(b"ab " + b"y" * n)


@given(st.lists(st.text(alphabet="aAbß é-.漢\x00\n", max_size=30), max_size=8), st.lists(st.text(alphabet="abß漢", min_size=1, max_size=4), max_size=6))
@settings(max_examples=150, deadline=None)
def test_scan_of_a_slice(texts, words):
    flat, at, n = I.Dictionary(sorted({w.encode() for w in words})).features(pa.array(texts, pa.string()), 10_000)
    for k, t in enumerate(texts):
        count, want = features(t)
        assert int(n[k]) == count and sorted(flat[at[k]:at[k + 1]].tolist()) == sorted(want)


def test_odd_rows_and_empty_tables(spark, odd, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows()]
    items = ["the quick brown fox", None, ""]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = sorted(map(tuple, I.resample(odd, target).collect()), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in brute(rows, items)]
    assert sorted(r[5] for r in got if r[5]) == sorted(r[5] for r in brute(rows, items) if r[5])  # among equal ids any order
    assert I.resample(no_docs, target).collect() == []
    alone = I.resample(odd, target.where("text = 'no'")).collect()
    assert len(alone) == len(rows)
    assert features(LONG)[0] == next(r[1] for r in got if r[0] == 8)
