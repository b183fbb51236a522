import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import SF001, SF01, no_docs, odd  # noqa: F401
from revmine.llm import quality_rank as QR, queries as Q, toxicity as TX
from revmine.llm.common import learnable, table


SF1 = "/root/testdata/sf0.1"


def auc(pairs):
    score, y = np.array([p for p, _ in pairs]), np.array([v for _, v in pairs])
    good, bad = score[y == 1], score[y == 0]
    return ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean())


@pytest.mark.parametrize("name,label,least", [("op2_quality_rank", "quality", 0.98), ("op9_toxicity", "toxic", 0.8)])
def test_held_out_accuracy(spark, name, label, least):
    got = Q.QUERIES[name](spark, SF01)
    rows = got.collect()
    assert len(rows) == table(spark, SF01, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= (0.3 if label == "quality" else 0.5))
    truth = {r["doc_id"]: r[label] for r in table(spark, SF01, "labels").collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert auc(held) >= least


@pytest.mark.parametrize("name,label,value,precision,recall", [("op2_quality_rank", "quality", 0, 0.95, 0.9), ("op2_quality_rank", "quality", 1, 0.98, 0.98),
                                                               ("op9_toxicity", "toxic", 1, 0.95, 0.75), ("op9_toxicity", "toxic", 0, 0.95, 0.99)])
def test_held_out_predictions(spark, held_out, name, label, value, precision, recall):
    pairs = held_out(name, label)
    said, true = sum(p == value for p, _ in pairs), sum(v == value for _, v in pairs)
    both = sum(p == v == value for p, v in pairs)
    assert true >= 50 and both / said >= precision and both / true >= recall, (both, said, true)


@pytest.fixture(scope="module")
def held_out(spark):
    known = {}

    def pairs(name, label):
        if name not in known:
            truth = {r["doc_id"]: r[label] for r in table(spark, SF1, "labels").collect()}
            known[name] = [(r["predicted"], truth[r["doc_id"]]) for r in Q.QUERIES[name](spark, SF1).where("held_out").collect() if truth.get(r["doc_id"]) is not None]
        return known[name]
    return pairs


def test_gram_weights_reach_the_dense_optimum():
    """Logistic regression on log-count ratios: the sparse method against Newton's on the same rows."""
    rng = np.random.default_rng(2)
    n, m, l2 = 60, 5, 2.0
    on, ratio = rng.random((n, m)) < 0.5, rng.normal(0, 1, m)
    y = (rng.random(n) < 1 / (1 + np.exp(-(on * ratio).sum(axis=1)))).astype(float)
    text, feature = np.nonzero(on)
    w, b = TX._logistic(text, feature, ratio, y, m, l2, 6000)
    x, v = np.column_stack([on * ratio, np.ones(n)]), np.zeros(m + 1)
    ridge = np.diag([l2] * m + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ v))
        v -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ v)
    assert np.allclose(np.append(w, b), v, atol=1e-4)


def test_gram_ratios_are_counted_from_the_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["bad cat", "bad dog", "nice cat", "nice dog", "nice bird", None])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(6)], "doc_id long, toxic int")
    model = TX.fit(docs, labels, min_z=0.0)
    texts = ["bad cat", "bad dog", "nice cat", "nice dog", "nice bird", ""]
    text, gram = TX.text_grams(TX.pa.array(texts))
    has = [set(gram[text == i].tolist()) for i in range(6)]
    toxic = {g: sum(g in has[i] for i in range(2)) for g in set().union(*has)}
    clean = {g: sum(g in has[i] for i in range(2, 6)) for g in set().union(*has)}
    assert set(model.grams.tolist()) == set(toxic)
    for g, w in zip(model.grams.tolist(), model.weights, strict=True):
        ratio = np.log((toxic[g] + 1) / 4) - np.log((clean[g] + 1) / 6)
        assert ratio == 0 or w == 0 or np.sign(w) == np.sign(ratio) or abs(w) < 0.2


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    turned = labels.withColumn("toxic", F.when(learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (TX.fit(docs, x, train=learnable()) for x in (labels, turned))
    assert a.grams.tolist() == b.grams.tolist() and a.weights.tolist() == b.weights.tolist() and a.bias == b.bias


def test_same_model_from_any_partitioning(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    a, b = (QR.fit(x, labels) for x in (docs, docs.repartition(7)))
    assert a.slope == b.slope and all((x == y).all() for x, y in zip(a.weights, b.weights, strict=True))


def test_pairs_prefer_label_1():
    rng = np.random.default_rng(0)
    x = np.zeros((400, len(QR.FEATURES)))
    y = (np.arange(400) % 4 != 0).astype(int)
    x[:, 3] = np.where(y == 1, rng.uniform(0, 0.5, 400), rng.uniform(0.5, 1, 400))
    model = QR.fit_pairs(x, y)
    s = model.raw_score(x)
    assert s[y == 1].min() > s[y == 0].max()
    assert ((model.probability(x) >= QR.THRESHOLD_SCORE) == (y == 1)).all()


def test_every_labelled_row_and_pair_counts(spark):
    """The fit against Newton's method on all pairs written out, and the Spark fit against the one in memory."""
    rng = np.random.default_rng(4)
    x = np.round(rng.random((60, 2)), 3)
    y = (x[:, 0] + 0.5 * rng.random(60) > 0.7).astype(int)
    model = QR.fit_pairs(x, y, n_pairs=50, l2=1.0)
    edges = [np.unique(np.quantile(QR._short(x[:, j]), QR.QUANTILES)) for j in range(2)]
    hot = np.zeros((60, sum(len(e) + 1 for e in edges)))
    np.put_along_axis(hot, QR._binned(x, edges), 1.0, axis=1)
    pairs = (hot[y == 1][:, None] - hot[y == 0][None]).reshape(-1, hot.shape[1])
    want = QR._logistic(pairs, np.ones(len(pairs)), 1.0, np.full(len(pairs), 50 / len(pairs)))
    assert np.allclose(np.concatenate(model.weights), want, atol=2e-4)
    docs = [(i, f"word{i % 9} " * (i % 13 + 1) + "#" * (i % 5)) for i in range(9_000)]
    labels = [(i, int((i * 7919) % 11 > 2 + 3 * (i % 5 == 0))) for i in range(9_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = QR.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    whole = QR.fit_pairs(QR.text_features(pa.array([t for _, t in docs])), np.array([v for _, v in labels]))
    assert all((a == b).all() for a, b in zip(got.weights, whole.weights, strict=True)) and got.slope == whole.slope
    assert np.isclose(got.threshold, whole.threshold, rtol=0, atol=1e-9)


def labels_for(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("mod,label", [(QR, "quality"), (TX, "toxic")])
def test_odd_rows_get_scores(spark, odd, no_docs, mod, label):
    few = labels_for(spark, [(5, 1, 0, None), (5, 1, 0, None), (8, 0, 1, None), (9, None, None, None), (None, 1, 1, None), (999, 0, 1, None), (4, 0, 1, None)])
    model = mod.fit(odd, few)
    rows = mod.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["id"] in (5, 6)]
    assert len(same) == 3 and len(set(same)) == 1
    assert mod.score(no_docs, model).collect() == []
    # no labels, or of one class
    for some, want in (([], {0.5} if mod is QR else {0.0}), ([(5, 1, 1, None)], {1.0})):
        got = {round(r["score"], 9) for r in mod.score(odd, mod.fit(odd, labels_for(spark, some))).collect()}
        assert got == want


def test_accept_keeps_rows_and_columns(spark, odd, no_docs):
    model = QR.fit(table(spark, SF01, "documents"), table(spark, SF01, "labels"), train=learnable())
    out = QR.accept(odd, model)
    assert out.schema == odd.schema
    score = {}
    for r in QR.score(odd, model).collect():
        score.setdefault(r["id"], []).append(r["score"])
    want = sorted(str(i) for i, s in score.items() for v in s if v >= QR.THRESHOLD_SCORE)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == want
    assert QR.accept(no_docs, model).collect() == []


def test_grams_are_characters_of_words():
    w, g = TX.word_grams(["idiot".encode(), "é".encode(), b"idiotic"])
    of = [set(g[w == i]) for i in range(3)]
    assert len(of[0]) == 5 + 4 + 3 + 2 and len(of[1]) == 1  # " idiot ", " é "
    assert len(of[0] & of[2]) == len(of[0]) - 4  # all but the four at the end of the word
