"""Term vectors against a dense decomposition, spread labels against a dense iteration, learnt scores."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revmine.operators import scoring as SC
from revmine.operators import vectors as V

LABELS = ["anger", "joy"]


def corpus(rng, n=60, size=30):
    return [[f"t{min(int(rng.exponential(6)), size - 1)}" for _ in range(rng.integers(0, 25))] for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, tokens array<string>").repartition(3)


def dense(texts, terms, window=4):
    at, out = {t: i for i, t in enumerate(terms)}, np.zeros((len(terms), len(terms)))
    for x in texts:
        for p, a in enumerate(x or []):
            for q, b in enumerate(x):
                if p != q and abs(p - q) <= window and a in at and b in at:
                    out[at[a], at[b]] += 1
    with np.errstate(all="ignore"):
        v = np.log(out * out.sum() / np.outer(out.sum(axis=1), out.sum(axis=1)))
    return out, np.where(np.isfinite(v) & (v > 0), v, 0)


@pytest.fixture(scope="module")
def texts():
    return [*corpus(np.random.default_rng(0)), [], None, ["alone"], ["t0", None, "t1"]]


def test_counts_and_pmi_equal_brute_force(spark, texts):
    df = frame(spark, texts)
    terms = V.vocabulary(df, max_terms=12, stop=["t2"])
    n = Counter(t for x in texts if x for t in x if t is not None and t != "t2")
    assert terms == sorted(n, key=lambda t: (-n[t], t))[:12]
    counts, pmi = dense(texts, terms)
    got, v = np.zeros(counts.shape), np.zeros(counts.shape)
    for r in V.cooccurrences(df, terms).collect():
        got[r["i"], r["j"]] = r["n"]
    for r in V.positive_pmi(V.cooccurrences(df, terms)).collect():
        v[r["i"], r["j"]] = r["v"]
    assert (got == counts).all() and np.allclose(v, pmi)


@pytest.mark.parametrize("places", [1, 3, 7])
def test_counts_do_not_depend_on_the_pieces(spark, texts, places, monkeypatch):
    df = frame(spark, texts).coalesce(1)
    terms = V.vocabulary(df, max_terms=12)
    whole = V.cooccurrences(df, terms).collect()
    monkeypatch.setattr(V, "SLICE_TOKENS", places)
    assert sorted(V.cooccurrences(df, terms).collect()) == sorted(whole) and len(whole) > 50


def test_vectors_equal_a_dense_decomposition(spark, texts):
    df = frame(spark, texts)
    terms = V.vocabulary(df)
    matrix = V.positive_pmi(V.cooccurrences(df, terms)).select("i", "j", "v")
    _, pmi = dense(texts, terms)
    size, vectors = V.randomised_vectors(matrix, len(terms), dim=6, rounds=12)
    u, s, _ = np.linalg.svd(pmi)
    assert np.allclose(size, s[:6], rtol=1e-6)
    for k in range(6):
        want = u[:, k] * np.sqrt(s[k])
        assert min(np.abs(vectors[:, k] - want).max(), np.abs(vectors[:, k] + want).max()) < 1e-4


def test_terms_are_classified_by_their_company(spark):
    rng = np.random.default_rng(3)
    smell, look = ["nose", "floral", "pine", "citrus", "scent"], ["colour", "hazy", "amber", "clear", "foam"]
    texts = [[str(w) for w in rng.choice(smell if k % 2 else look, 12)] for k in range(80)]
    vectors = V.term_vectors(frame(spark, texts), dim=4)
    seeds = spark.createDataFrame([("nose", "aroma"), ("colour", "appearance"), ("unknown", "taste")], "term string, category string")
    got = {r["term"]: (r["category"], r["kept"]) for r in SC.classify_vectors(vectors, V.seed_centroids(vectors, seeds), "term", "vector").collect()}
    assert got == {**{t: ("aroma", True) for t in smell}, **{t: ("appearance", True) for t in look}}


def test_spread_equals_a_dense_iteration(spark, texts):
    df = frame(spark, texts)
    terms = V.vocabulary(df)
    _, pmi = dense(texts, terms)
    np.fill_diagonal(pmi, 0)
    m = 3
    edges = np.zeros(pmi.shape)
    for i, row in enumerate(pmi):
        top = sorted(np.flatnonzero(row), key=lambda j: (-round(row[j], 9), j))[:m]
        if top:
            edges[i, top] = row[top] / row[top].sum()
    own = np.zeros((len(terms), 2))
    a, b, c = np.argsort(-(edges > 0).sum(axis=0))[:3]  # terms that many are near to
    own[a, 0] = own[b, 1] = own[c, 1] = 0.4
    f, rounds = own, 0
    while True:
        new = 0.6 * edges @ f + own
        rounds += 1
        done = np.abs(new - f).max() < 1e-4
        f = new
        if done:
            break
    seeds = spark.createDataFrame([(terms[a], "anger"), (terms[b], "joy"), (terms[c], "joy"), ("nowhere", "joy")], "term string, label string")
    got = {r["term"]: (r["anger"], r["joy"]) for r in V.induce_lexicon(df, seeds, LABELS, m=m, terms=terms).collect()}
    assert 2 < rounds < 40
    for i, t in enumerate(terms):
        assert np.allclose(got.get(t, (0, 0)), f[i], atol=1e-12)


def test_scores_come_from_the_weights(spark):
    lexicon = spark.createDataFrame([("bad", 1.0, 0.0), ("good", 0.0, 0.5), ("fine", 0.25, 0.25)], "term string, anger double, joy double")
    df = spark.createDataFrame([(1, ["bad", "good", "good"]), (2, ["fine"]), (3, ["what"]), (4, []), (5, None), (6, ["good", "bad", "bad"])], "id long, tokens array<string>")
    got = {r["id"]: (r["anger"], r["joy"], r["max_feel"]) for r in V.score_with_lexicon(df, ["id"], lexicon, LABELS).collect()}
    assert got == {1: (0.5, 0.5, "anger"), 2: (0.5, 0.5, "anger"), 3: (0, 0, "anger"), 4: (0, 0, "anger"), 5: (0, 0, "anger"), 6: (0.8, 0.2, "anger")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, tokens array<string>")
    assert V.term_vectors(none).collect() == []
    seeds = spark.createDataFrame([("a", "joy")], "term string, label string")
    assert V.induce_lexicon(none, seeds, LABELS, terms=["a", "b"]).select("term", F.round("joy", 6)).collect() == [("a", 0.4)]


def test_summary_without_repeats(spark):
    near = [f"The muddy amber ale tasted flat and stale near {x} rivers" for x in ("nine", "ten")]
    texts = [*near, "Stale rivers ruined amber bread", "Green hops smell like pine forests", "Pine forests grow green needles", "Tiny unrelated remark", "...", None]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)] + [("lone", 50, "Just one sentence here"), ("none", 60, "?!")], "g string, review_id long, t string")
    got = SC.summarise_by_graph(df, ["g"], "t", 3).collect()
    mine = [r["sentence"] for r in sorted(got, key=lambda r: r["rank"]) if r["g"] == "g"]
    assert len(mine) == 3 and sum(s in near for s in mine) == 1  # near-equal sentences never both
    assert [(r["rank"], r["sentence"]) for r in got if r["g"] == "lone"] == [(1, "Just one sentence here")]
    assert all(r["g"] != "none" for r in got)
    assert SC.summarise_by_graph(df.where("g = 'x'"), ["g"], "t", 3).collect() == []


def test_central_sentences_equal_a_dense_iteration(spark):
    rng = np.random.default_rng(4)
    terms = [sorted({f"w{w}" for w in rng.integers(0, 40, rng.integers(1, 9))}) for _ in range(30)]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(terms)], "g string, id long, terms array<string>")
    got = {r["s"]["id"]: r["score"] for r in SC.central_sentences(df, ["g"], ["id"], max_shared=5).collect()}
    df_ = Counter(t for x in terms for t in x)
    w = np.zeros((30, 30))
    for a in range(30):
        for b in range(30):
            both = [t for t in terms[a] if t in terms[b] and 2 <= df_[t] <= 5]
            if a != b and both:
                w[a, b] = sum(np.log(30 / df_[t]) for t in both) / (np.log(1 + len(terms[a])) + np.log(1 + len(terms[b])))
    p = w / np.maximum(w.sum(axis=0), 1e-300)
    r = np.ones(30)
    while True:
        new = 0.15 + 0.85 * p @ r
        done = np.abs(new - r).max() < 1e-4
        r = new
        if done:
            break
    assert np.allclose([got[i] for i in range(30)], r, atol=1e-9)


def plain_centrality(rows, damping=0.85, tolerance=1e-4, max_rounds=30):
    """key -> score over all pairs of rows (key, terms) that share a term; a key's rows give and get as one, each row once."""
    df_ = Counter(t for _, x in rows for t in x)
    n, keys = len(rows), [k for k, _ in rows]
    w = np.zeros((n, n))
    for a in range(n):
        for b in range(n):
            if keys[a] != keys[b]:
                w[a, b] = sum(np.log(n / df_[t]) for t in rows[a][1] if t in rows[b][1]) / (np.log(1 + len(rows[a][1])) + np.log(1 + len(rows[b][1])))
    names = sorted(set(keys), key=str)
    m = np.array([[k == x for x in keys] for k in names], float)
    w = m @ w @ m.T
    p = np.divide(w, w.sum(axis=0), where=w.sum(axis=0) > 0, out=np.zeros_like(w)) * m.sum(axis=1)
    r, moved = np.ones(len(names)), np.inf
    for _ in range(max_rounds):
        if moved >= tolerance:
            new = 1 - damping + damping * p @ r
            r, moved = new, np.abs(new - r).max()
    return dict(zip(names, r, strict=True))


def test_common_terms_link_their_sentences(spark):
    """Terms of any number of sentences count, also with repeated and null keys; a term of one key or of all rows links none."""
    rng = np.random.default_rng(9)
    rows = [(i, sorted({f"w{w}" for w in rng.integers(0, 12, rng.integers(1, 9))}) + ["all"]) for i in range(60)]
    rows += [(7, ["w1", "w2", "all"]), (8, rows[8][1]), (None, ["w3", "all"]), (None, ["w3", "w4", "all"]), (90, ["only", "all"]), (90, ["only", "all"]), (91, ["all"])]
    df = spark.createDataFrame([("g", i, t) for i, t in rows] + [("two", 1, ["x", "y"]), ("two", 2, ["x"]), ("none", 1, [])], "g string, id long, terms array<string>")
    got = SC.central_sentences(df, ["g"], ["id"], max_rounds=5).collect()
    assert Counter((r["g"], r["s"]["id"]) for r in got) == Counter((r["g"], r["id"]) for r in df.collect())
    want = plain_centrality(rows, max_rounds=5)
    assert max(Counter(t for _, x in rows for t in x if t != "all").values()) > 20
    assert [r for r in got if not np.isclose(r["score"], want[r["s"]["id"]] if r["g"] == "g" else 0.15, atol=1e-9)] == []
    assert {round(r["score"], 9) for r in got if r["s"]["id"] in (90, 91)} == {0.15}


def test_a_common_word_makes_no_pairs(spark):
    """20,000 sentences with one word in all but one: 200 million pairs, but a row a sentence and term."""
    df = spark.range(20_000).selectExpr("'g' AS g", "id", "if(id = 0, array('other'), array('word', concat('w', id div 2))) AS terms")
    graph = SC.sentence_graph(df, ["g"], ["id"])
    assert graph.links.count() == 19_999 + 19_998
    got = {r["s"]["id"]: r["score"] for r in SC.central_sentences(df, ["g"], ["id"], max_rounds=2).where("s.id < 4").collect()}
    assert np.isclose(got[0], 0.15) and 0.15 < got[1] < got[2] and np.isclose(got[2], got[3])


def test_texts_of_a_batch_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(V, "SLICE_TOKENS", 5)
    texts = pa.array([["a"] * 3, ["b"] * 2, None, ["c"] * 9, [], ["d"] * 4, ["e"]])
    got = [p.to_pylist() for p in V._pieces(texts)]
    assert [t for p in got for t in p] == texts.to_pylist()
    assert [sum(len(t or []) for t in p) for p in got] == [5, 9, 5]
