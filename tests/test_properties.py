"""Property tests (hypothesis) against plain-Python models of the operators."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revmine.operators import aggregate as A
from revmine.operators import ranks as RK
from revmine.operators import window as W

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=40)


@SETTINGS
@given(vals=values, q=st.sampled_from([0.0, 0.1, 0.37, 0.5, 0.9, 1.0]))
def test_rank_percentile_equals_numpy(spark, vals, q):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = RK.percentile_by_rank(df, "x", q).first()["percentile"]
    assert abs(got - float(np.percentile(vals, q * 100))) < 1e-9


@SETTINGS
@given(groups=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 1000)), min_size=1, max_size=60, unique=True))
def test_positions_equal_sequential_count(spark, groups):
    df = spark.createDataFrame(groups, "k string, o int")
    got = {(r["k"], r["o"]): r["p"] for r in RK.position_in_group(df, ["k"], ["o"], "p").collect()}
    for k in "abc":
        for i, o in enumerate(sorted(o for kk, o in groups if kk == k)):
            assert got[(k, o)] == i + 1


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from("xy"), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=40))
def test_split_covers_every_non_null_rating(spark, rows):
    df = spark.createDataFrame([(e, None if r is None else float(r)) for e, r in rows], "e string, r double")
    lab = W.quantile_split(df, "e", "r", 10).collect()
    non_null = sum(1 for _, r in rows if r is not None)
    assert sum(1 for x in lab if x["polarity"] in ("negative", "positive")) == non_null
    assert all(x["polarity"] is None for x in lab if x["r"] is None)


@SETTINGS
@given(vals=st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=50),
       bins=st.integers(1, 12))
def test_histogram_counts_match_numpy(spark, vals, bins):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["count"] for r in A.histogram(df, "x", bins).orderBy("bin").collect()]
    want, _ = np.histogram(vals, bins)
    assert got == list(want) and sum(got) == len(vals)


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["anger", "joy", "sadness", "fear"])), min_size=1,
                     max_size=40))
def test_emotion_shares_sum_to_100(spark, rows):
    df = spark.createDataFrame(rows, "score int, max_feel string")
    for r in A.emotion_share_by_score(df).collect():
        assert abs(sum(v for k, v in r.asDict().items() if k != "score") - 100.0) < 1e-9
