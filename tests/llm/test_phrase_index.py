import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from llm_fixtures import no_docs, odd  # noqa: F401
from revmine.llm import phrase_index as PI

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return ALNUM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            p = words(t)
            if item is None or not p:
                continue
            n = min(window, len(p))
            phrases = {tuple(p[k:k + n]) for k in range(len(p) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in phrases:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(index, matches):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in cols) for r in PI.verdicts(index, matches).collect()), key=str)


@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_equals_brute_force(spark, block_bytes):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(12)]  # few words: many chance matches of short items
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30)))) for k in range(30)]
    items += [(3, "W1, w2! w3"), (None, "w1 w2"), (40, None), (41, "..."), (5, items[5][1])]
    docs = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            p = words(items[rng.randrange(30)][1])
            w[len(w) // 2:len(w) // 2] = p
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    index = PI.build_index(df)
    matches = PI.phrase_matches(index, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert got(index, matches) == brute(docs, items)


def test_phrases_never_span_documents(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string").coalesce(1)
    index = PI.build_index(df)
    m = PI.phrase_matches(index, spark.createDataFrame([(1, "b c d"), (2, "c"), (3, "d e f g")], "item_id long, text string"))
    assert {(r["item"], r["begin"], r["end"]) for r in m.collect()} == {(2, 2, 3)}


def test_proximity(spark):
    docs = [(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha beta"), (4, "alpha q q q q q beta gamma"), (5, "gamma")]
    index = PI.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    m = PI.proximity_matches(index, items, span=5).join(PI.documents_of(index), ["segment", "ordinal"])
    assert {(r["doc_id"], r["begin"], r["end"]) for r in m.collect()} == {(1, 0, 5), (2, 0, 3)}


def near_items(text, items, span):
    w = words(text)
    return {i for i, t in items if words(t) and any(set(words(t)) <= set(w[k:k + span]) for k in range(len(w)))}


def test_proximity_equals_brute_force_in_one_segment(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(10)]
    items = [(k, " ".join(rng.sample(vocab, rng.randrange(1, 5)))) for k in range(12)]
    items += [(20, "rare w0 w1"), (21, "w0 rare w1"), (22, "w0 w1 rare"), (23, "absent w0"), (24, "...")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    docs += [(100, "rare w0 w1"), (101, "w0 rare w1"), (102, "w1 w0 rare"), (103, "w1 w0"), (104, "rare w0 w9 w9 w9 w9 w1")]
    item_df = spark.createDataFrame(items, "item_id long, text string")
    index = PI.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert index.count() == 1
    for span in (1, 3, 6):
        m = PI.proximity_matches(index, item_df, span=span)
        texts = dict(docs)
        got = {}
        for r in m.join(PI.documents_of(index), ["segment", "ordinal"]).collect():
            item = set(words(dict(items)[r["item"]]))
            assert r["end"] - r["begin"] <= span and item <= set(words(texts[r["doc_id"]])[r["begin"]:r["end"]])
            got.setdefault(r["doc_id"], set()).add(r["item"])
        want = {i: near_items(t, items, span) for i, t in docs}
        assert got == {i: x for i, x in want.items() if x}
        counts = {r["doc_id"]: (r["n_words"], r["n_near_items"]) for r in PI.proximity_counts(index, m).collect()}
        assert counts == {i: (len(words(t)), len(want[i])) for i, t in docs}


def plain_stretches(lists, span):
    """The shortest stretch through each entry of the first list; of equal ones the last to begin."""
    out = set()
    for p in lists[0]:
        best = None
        for b in sorted({q for x in lists for q in x if p - span < q <= p}, reverse=True):
            ends = [min((q for q in x if q >= b), default=None) for x in lists]
            if None not in ends and (e := max([p, *ends])) - b < span and (best is None or e - b < best[1] - best[0]):
                best = (b, e)
        if best:
            out.add((best[0], best[1] + 1))
    return out


def test_stretches_equal_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        places = list(range(rng.randrange(1, 40)))
        rng.shuffle(places)
        k = rng.randrange(1, 5)
        lists = [sorted(places[i::k]) for i in range(k)]
        if all(lists):
            for span in (1, 2, 5, 12):
                got = PI._stretches([PI.np.array(x) for x in lists], span)
                assert set(zip(*(x.tolist() for x in got), strict=True)) == plain_stretches(lists, span)


def test_a_common_word_is_one_pass(spark):
    """20 documents of 20,000 equal words: an item of that word has one stretch an occurrence, in one pass."""
    index = PI.build_index(spark.createDataFrame([(i, "alpha " * 20_000) for i in range(20)], "doc_id long, text string").coalesce(1))
    m = PI.proximity_matches(index, spark.createDataFrame([(1, "alpha"), (2, "alpha beta")], "item_id long, text string"), span=5)
    assert m.count() == 400_000 and {r["n_near_items"] for r in PI.proximity_counts(index, m).collect()} == {1}


def test_proximity_of_nulls_and_nothing(spark, odd, no_docs):
    items = spark.createDataFrame([(1, "quick fox"), (2, None), (None, "quick"), (3, "")], "item_id long, text string")
    index = PI.build_index(odd)
    counts = PI.proximity_counts(index, PI.proximity_matches(index, items, span=20)).collect()
    assert len(counts) == odd.count() and sum(r["n_near_items"] for r in counts) == 5  # four copies in lower case or not, one null id
    assert PI.proximity_matches(index, items.where("item_id < 0"), span=20).count() == 0
    empty = PI.build_index(no_docs)
    assert PI.proximity_counts(empty, PI.proximity_matches(empty, items, span=20)).collect() == []


def test_blocks_of_items_give_the_same_matches(spark):
    docs = spark.createDataFrame([(i, f"one two w{i} three four w{i + 1} five") for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i} three four") for i in range(31)], "item_id long, text string")
    index = PI.build_index(docs)
    whole, blocks = (sorted(map(tuple, PI.phrase_matches(index, items, block_bytes=b).collect())) for b in (1 << 20, 60))
    assert whole == blocks and len(whole) == 30


def test_row_groups_of_an_index_are_bounded(spark):
    """One task's 28 MB of text: 8 segments, never all in one row group (the memory of a reader and of the writer)."""
    docs = spark.range(0, 16, numPartitions=1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 420000), i -> hex(pmod(xxhash64(id, i), 5000)))) AS text")
    index = PI.build_index(docs)
    groups = [(g.num_rows, g.total_byte_size) for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(n for n, _ in groups) == index.count() >= 8
    assert max(size for _, size in groups) < 14 << 20 and len(groups) > 1
    assert [r["n_words"] for r in PI.documents_of(index).collect()] == [420_000] * 16


def test_odd_rows_and_empty_tables(spark, odd, no_docs):
    items = spark.createDataFrame([(1, "quick BROWN fox"), (2, "漢字"), (None, "one"), (4, None), (5, "two words")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    index = PI.build_index(odd)
    matches = PI.phrase_matches(index, items)
    want = brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(index, matches) == want
    kept = PI.decontaminate(odd, items)
    assert kept.schema == odd.schema
    bad = {w[0] for w in want if w[5]}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert PI.decontaminate(odd, none).count() == len(rows)
    assert PI.decontaminate(no_docs, items).collect() == []
    empty = PI.build_index(no_docs)
    assert got(empty, PI.phrase_matches(empty, items)) == []


def test_rows_with_null_ids_are_judged_apart(spark):
    docs = [(None, "quick brown fox"), (None, "clean text"), (None, "clean text"), (None, None), (None, ""), (1, "quick brown fox"), (1, "clean text"),
            (2, "clean text"), (3, "quick brown fox"), (None, "quick brown fox"), (4, None)]
    items = spark.createDataFrame([(1, "quick BROWN fox")], "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, key string, id string")
    for frame in (df.coalesce(1), df.repartition(5)):
        kept = PI.decontaminate(frame, items, nulls_apart=True)
        assert kept.schema == frame.schema
        want = [(i, t, "x", "y") for i, t in docs if t != "quick brown fox" and i != 1]
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    assert sorted(str(r["doc_id"]) for r in PI.decontaminate(df, items).collect()) == ["2", "4"]
