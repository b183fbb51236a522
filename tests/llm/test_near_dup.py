import random
import re

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import no_docs, odd  # noqa: F401
from revmine.llm import near_dup as N


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (set size, least reachable id) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def family(rng, n_base, copies, words=120):
    """Texts with chains of edits: neighbours are similar, ends of a chain are not."""
    out = []
    for _ in range(n_base):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, words))]
        for _ in range(rng.randrange(1, copies)):
            out.append(" ".join(w))
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(5000)}"
    rng.shuffle(out)
    return list(enumerate(out, 10))


@pytest.mark.parametrize("seed,hubs", [(1, 16), (2, 1)])
def test_equals_all_pairs(spark, seed, hubs):
    rows = family(random.Random(seed), 40, 9)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hubs=hubs).collect()
    want = brute(rows)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_shared_passage_and_hot_group(spark):
    """A passage that many texts share links nothing; a large group of copies is one component."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(60))) for i in range(60)]
    base = [f"c{i}" for i in range(100)]
    for i in range(60, 200):
        w = list(base)
        w[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w if i % 3 else base)))
    got = {r["id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}
    assert all(got[i] == i for i in range(60)) and len({got[i] for i in range(60, 200)}) == 1


def test_recall_at_the_threshold():
    """Pairs of similarity 0.75 to 0.8 share a band nearly always, short texts too."""
    rng = np.random.default_rng(3)
    orders = N.orders_of(N.BANDS * N.ROWS)
    missed = 0
    for _ in range(600):
        n = int(rng.integers(4, 400))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        extra = rng.integers(0, 1 << 63, int(n / 0.75) - n, dtype=np.uint64)
        a, b = np.unique(both), np.unique(np.concatenate([both, extra]))
        keys = [N.band_keys(N.signature(s, orders), N.BANDS, N.ROWS) for s in (a, b)]
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 2


def test_densification_copies_from_full_bins():
    orders = N.orders_of(24)
    hashes = np.sort(np.array([5, 1 << 62, 3 << 62], np.uint64))
    values = N.signature(hashes, orders)
    assert set(values.tolist()) == set(hashes.tolist()) and len(values) == 24


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["comp"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[k] == 100 for k in range(100, 140))
    assert got[301] == got[300] == 300 and 200 not in got


def test_odd_rows(spark, odd, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = N.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    want = brute([(i, t) for i, t in dict.fromkeys(rows) if i is not None])
    for r in got:
        if r["id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["id"]]
    kept = N.deduplicate(odd)
    assert kept.schema == odd.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()}) and ids.count(None) == 2
    assert N.near_duplicates(no_docs).collect() == [] and N.deduplicate(no_docs).collect() == []


def test_texts_that_share_an_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(3, a), (3, b), (5, b), (7, a), (9, "other")], "doc_id long, text string")
    got = {(r["id"], r["component_id"]) for r in N.near_duplicates(df).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (9, 9)}
    assert sorted(r["doc_id"] for r in N.deduplicate(df).collect()) == [3, 9]


def test_sets_are_of_folded_words():
    a, b = N.shingle_sets(pa.array(["The Quick brown fox JUMPS over", "the quick\tbrown\nfox jumps over"]))
    assert (a == b).all() and len(a) == 2
    one, two, none = N.shingle_sets(pa.array(["one two", "one  two ", " \x0b "]))
    assert (one == two).all() and len(one) == 1 and len(none) == 0


def test_sample_counts_are_bounded(spark):
    """The most frequent shingles of the sample, as many as asked for."""
    texts = [f"one two three four five {'six ' * (k % 3)}t{k} u{k} v{k}" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "rep long, text string").repartition(7)
    count = {}
    for s in N.shingle_sets(N.pa.array(texts, N.pa.string())):
        for h in s.view(N.np.int64).tolist():
            count[h] = count.get(h, 0) + 1
    want = sorted(((h, n) for h, n in count.items() if n > 2), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in N.frequent(df).collect()] == want and len(want) > 2
    assert [tuple(r) for r in N.frequent(df, most=2).collect()] == want[:2]
    assert N.frequent(df, sample_rows=2).collect() == []
