"""Two-level running sums and positions, percentiles of groups that no task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revmine.operators import ranks as R
from revmine.operators import window as W


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_running_sums_over_slices(spark, slices):
    rng = np.random.default_rng(slices)
    keys = rng.choice(["hot", "hot", "hot", "b", "c", None], 400).tolist()
    rows = [(k, int(o), int(v)) for k, o, v in zip(keys, rng.permutation(400), rng.integers(-5, 6, 400), strict=True)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    got = {r["o"]: (r["s"], r["p"]) for r in R.position_in_group(R.running_sum(df, ["k"], ["o"], "v", "s", slices), ["k"], ["o"], "p", slices).collect()}
    for key in {"hot", "b", "c", None}:
        mine = sorted((o, v) for k, o, v in rows if k == key)
        for n, (o, _) in enumerate(mine):
            assert got[o] == (sum(v for _, v in mine[:n + 1]), n + 1)


def test_without_keys_and_rows(spark):
    df = spark.createDataFrame([(i, 10 - i) for i in range(10)], "a int, b int")
    got = {r["a"]: r["n"] for r in R.position_in_group(df, [], [F.desc("b")], "n", 4).collect()}
    assert got == {i: i + 1 for i in range(10)}
    none = df.where("a < 0")
    assert R.position_in_group(none, ["a"], ["b"]).collect() == [] and R.running_sum(none, [], ["b"], "a", "s").collect() == []


def test_a_hot_key_is_sorted_in_many_slices(spark):
    """3 M rows of one key among others: no slice holds a tenth, positions are row_number's, ties and NULL order keys included."""
    n = 3_000_000
    df = spark.range(n).select((F.col("id") % 50 == 0).alias("other"), F.when(F.col("id") % 1000 != 7, F.pmod(F.xxhash64("id"), F.lit(n // 2))).alias("o"), "id")
    placed = R._sliced(df, ["other"], ["o", "id"], 32)
    sizes = [r["count"] for r in placed.groupBy("_slice").count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 10
    got = R.position_in_group(df, ["other"], ["o", "id"], "p", 32).toPandas()
    want = got.sort_values(["other", "o", "id"], na_position="first")
    assert (want["p"].to_numpy() == want.groupby("other").cumcount().to_numpy() + 1).all()


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.973, 1.0])
def test_narrowed_percentiles_equal_numpy(spark, q):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.standard_normal(4000) * 10.0 ** rng.integers(-3, 6, 4000)] + [("hot", 1.5)] * 700
    rows += [("many", float(x)) for x in rng.random(900)] + [("few", 1.0), ("few", 2.0), (None, 3.0), ("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r["g"]: r["percentile"] for r in R.percentile_by_rank(df, "x", q, ["g"], max_values=50).collect()}
    want = {}
    for g in ("hot", "many", "few", None):
        want[g] = np.percentile([x for k, x in rows if k == g and x is not None and x == x], q * 100)
    assert got.keys() == want.keys() and all(np.isclose(got[g], want[g], rtol=1e-12, atol=1e-12) for g in want)
    total = R.percentile_by_rank(df, "x", q, max_values=50).collect()
    assert len(total) == 1 and np.isclose(total[0][0], np.percentile([x for _, x in rows if x is not None and x == x], q * 100), rtol=1e-12)


def test_constant_and_empty(spark):
    same = spark.createDataFrame([(2.0,)] * 30, "x double")
    assert R.percentile_by_rank(same, "x", 0.3, max_values=1).first()[0] == 2.0
    assert R.percentile_by_rank(same.where("x > 5"), "x", 0.3).collect() == [(None,)]
    two = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert R.percentile_by_rank(two, "x", 0.25, max_values=1).first()[0] == 1.25


def test_ten_million_distinct_values_of_a_hot_group(spark):
    n = 10_000_000
    x = F.pmod(F.xxhash64("id"), F.lit(1 << 52)).cast("double") / 1024
    df = spark.range(n).select((F.col("id") % 100 == 0).alias("g"), x.alias("x"))
    got = {r["g"]: r["percentile"] for r in R.percentile_by_rank(df, "x", 0.1, ["g"], max_values=500_000).collect()}
    data = df.toArrow()
    g, v = data.column("g").to_numpy(), data.column("x").to_numpy()
    assert all(np.isclose(got[k], np.percentile(v[g == k], 10), rtol=1e-12) for k in (True, False))


def test_average_rank_of_ties_over_slices(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", None), ("b", 2.0), (None, 1.0)]
    got = W.average_rank(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).where("k = 'a' or v = 2").collect()
    assert sorted((r["k"], r["v"], r["v_rank"]) for r in got) == [("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 3.0, 3.0), ("b", 2.0, 1.0)]
