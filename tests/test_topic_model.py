"""Topic inference under fixed topics, the model's round trip, and reading no more files than wanted."""

import numpy as np
import pytest

from revmine.operators import topics as TP
from revmine.sources import reviews as RV


def tiny():
    return TP.TopicModel(["hops", "malt", "yeast", "foam"], np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.6]]), np.array([0.5, 0.5]))


def test_mixture_is_the_posterior_mode_on_a_grid():
    """The rounds climb sum n ln(theta . w) + prior ln(theta); compare with the best point of a fine grid."""
    m = tiny()
    for counts in ([3, 1, 0, 0], [0, 0, 2, 5], [1, 1, 1, 1], [0, 0, 0, 1]):
        n = np.array(counts, float)
        use = np.flatnonzero(n)
        got = m.mixture(use, n[use], tolerance=1e-12, max_rounds=5000)
        t = np.linspace(1e-6, 1 - 1e-6, 200_001)
        value = sum(n[i] * np.log(t * m.weights[0, i] + (1 - t) * m.weights[1, i]) for i in use) + 0.5 * np.log(t) + 0.5 * np.log(1 - t)
        assert abs(got[0] - t[value.argmax()]) < 1e-4 and abs(got.sum() - 1) < 1e-12


def test_topics_of_new_entities_and_round_trip(spark, tmp_path):
    m = tiny()
    df = spark.createDataFrame([("a", "hops hops malt"), ("a", "hops"), ("b", "foam yeast foam"), ("c", "nothing known"), ("d", None), (None, "hops")], "e string, t string")
    got = {r["e"]: [s["prob"] for s in r["topics"]] for r in m.topics(df, "e", "t").collect()}
    assert got.keys() == {"a", "b", "c", "d"}
    assert np.allclose(got["a"], m.mixture(np.array([0, 1]), np.array([3.0, 1.0]))) and np.allclose(got["c"], [0.5, 0.5]) and np.allclose(got["d"], [0.5, 0.5])
    m.save(spark, str(tmp_path / "m"))
    m.save(spark, str(tmp_path / "m"))  # again, over the first
    back = TP.TopicModel.load(spark, str(tmp_path / "m"))
    assert back.terms == m.terms and (back.weights == m.weights).all() and (back.prior == m.prior).all()
    assert {r["e"]: [s["prob"] for s in r["topics"]] for r in back.topics(df, "e", "t").collect()} == got
    assert m.top_terms(2) == [["hops", "malt"], ["foam", "yeast"]]


def test_fitted_topics_tell_texts_apart(spark):
    rng = np.random.default_rng(0)
    one, two = ["pine", "resin", "citrus", "hoppy"], ["coffee", "roast", "cocoa", "smoke"]
    rows = [(f"e{k}", " ".join(rng.choice(one if k % 2 else two, 40))) for k in range(20)]
    df = spark.createDataFrame(rows, "e string, t string")
    m = TP.fit_topics(df, "e", "t", k=2, max_iter=30, min_df=2, max_df=0.9)
    new = spark.createDataFrame([("x", "pine resin pine citrus"), ("y", "smoke roast coffee")], "e string, t string")
    got = {r["e"]: max(r["topics"], key=lambda s: s["prob"])["topic"] for r in m.topics(new, "e", "t").collect()}
    assert got["x"] != got["y"]
    assert TP.fit_topics(df.where("e = 'none'"), "e", "t") is None


def block(i):
    return f"beer_name: b{i}\nuser_id: {i}\nrating: 3\ntext: t{i}\n\n"


@pytest.mark.parametrize("n", [0, 1, 7, 10, 11, 35, 99])
def test_first_records_in_file_order(spark, tmp_path, n):
    for k in range(6):
        (tmp_path / f"part {k}.txt").write_text("\n\n" * (k % 2) + "".join(block(i) for i in range(10 * k, 10 * k + (10 if k != 2 else 0))))
    every = [i for k in range(6) for i in range(10 * k, 10 * k + (10 if k != 2 else 0))]
    got = sorted(r["user_id"] for r in RV.read_simple_reviews(spark, str(tmp_path), n=n).collect())
    assert got == every[:n]
    assert sorted(int(r["user_id"]) for r in RV.read_review_blocks(spark, str(tmp_path), ["user_id"], casts=None, max_reviews=n).collect()) == every[:n]


def test_later_files_are_not_read(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"a{k}.txt").write_text("".join(block(i) for i in range(10 * k, 10 * k + 10)))
    (tmp_path / "z.txt.gz").write_bytes(b"no gzip file")  # reading it fails
    assert RV.read_simple_reviews(spark, str(tmp_path), n=10).count() == 10
    with pytest.raises(Exception):
        RV.read_simple_reviews(spark, str(tmp_path)).count()


def test_many_splits_of_one_file(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(block(i) for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sorted(r["user_id"] for r in RV.read_simple_reviews(spark, str(tmp_path), n=3_000).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(3_000))
