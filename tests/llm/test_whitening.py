import math

import numpy as np
import pytest

from llm_fixtures import SF001
from revmine.llm import queries as Q, whitening as W
from revmine.llm.common import table


def plain(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), [int(t) for t in fit.sum(axis=0)]
    centred = np.array([[n * int(a) - t for a, t in zip(r, total, strict=True)] for r in fit], np.float64) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return x, n, total, values[::-1], vecs[:, ::-1]


def check(rows, ids, vectors, most=16):
    x, n, total, values, vecs = plain(vectors)
    k = min(most, int((values > 1e-10 * max(values[0], 1e-300)).sum()))
    assert len(rows) == len(ids) * k
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    for c in range(1, k + 1):
        want = (x - np.array(total) / n) @ vecs[:, c - 1] / np.sqrt(values[c - 1])
        got = np.array([by[i][c][0]["whitened"] for i in ids])
        sign = 1 if got @ want > 0 else -1
        assert np.abs(got - sign * want).max() < 1e-7
        assert all(abs(by[i][c][0]["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9 and by[i][c][0]["n"] == n for i in ids)
    for j, i in enumerate(ids):
        assert by[i][1][0]["deviation"] == sum((n * int(a) - t) ** 2 for a, t in zip(x[j], total, strict=True))
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and 0 <= rows[0]["identity_error"] < 1e-9


def test_query_equals_a_dense_decomposition(spark):
    rows = table(spark, SF001, "embeddings").orderBy("vec_id").collect()
    check(Q.op13_whitening(spark, SF001).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


@pytest.mark.parametrize("rows_per_task", [3, 40, 10_000])
def test_any_number_of_tasks(spark, rows_per_task, monkeypatch):
    """40 tasks and more meet in two levels."""
    monkeypatch.setattr(W, "ROWS_PER_TASK", rows_per_task)
    rng = np.random.default_rng(2)
    v = rng.standard_normal((120, 5)) * [3, 1, 0.5, 0.2, 0.1]
    v[100:] = v[0]  # a hot vector counts once
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    parts = W.integers(df).select("x").distinct()
    model = W.fit(W.stored(parts, "t"), 5, rows_per_task=rows_per_task)
    assert model.n == len(np.unique(np.floor(64 * v.astype(np.float32).astype(float)), axis=0))
    check([r for r in W.whiten(df).withColumnRenamed("id", "vec_id").collect()], list(range(120)), v.astype(np.float32).tolist())


def test_rank_one_updates_with_deflation():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 40):
        for t in range(40):
            d = np.sort(rng.random(n) * 10.0 ** rng.integers(-6, 6))
            z = rng.standard_normal(n) * 10.0 ** rng.integers(-4, 4)
            if t % 3 == 0:
                d[:] = np.round(d, 1)
            if t % 5 == 0:
                d[:] = d[0]
            if t % 4 == 0:
                z[rng.integers(0, n)] = 0
            d.sort()
            values, q = W.rank_one(d, z)
            a = np.diag(d) + np.outer(z, z)
            size = max(np.abs(a).max(), 1e-300)
            assert np.abs(q @ np.diag(values) @ q.T - a).max() < 1e-11 * size and np.abs(q.T @ q - np.eye(n)).max() < 1e-11
            assert (np.diff(values) >= 0).all() and np.abs(values - np.linalg.eigvalsh(a)).max() < 1e-11 * size


def test_updates_and_combined_spectra_alone_are_close():
    rng = np.random.default_rng(1)
    x = (np.floor(64 * rng.standard_normal((900, 12)) * rng.random(12)) + 1_000_000).astype(np.int64)
    parts = [W.Spectrum(12) for _ in range(4)]
    for s, rows in zip(parts, (x[:1], x[1:300], x[300:], x[:0]), strict=True):
        if len(rows):
            s.add(rows)
    whole = W.Spectrum(12)
    for s in parts:
        whole.combine(s)
    c = x - x.mean(axis=0)
    assert whole.n == 900 and [int(t) for t in whole.total] == x.sum(axis=0).tolist()
    assert np.abs(whole.basis @ np.diag(whole.values) @ whole.basis.T - c.T @ c).max() < 1e-9 * np.abs(c.T @ c).max()


@pytest.mark.parametrize("block_rows", [1, 8, 50])
def test_condensed_blocks_give_the_same(spark, block_rows):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((300, 6)) * [4, 2, 1, 0.5, 0.25, 0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    check(W.whiten(df, block_rows=block_rows).withColumnRenamed("id", "vec_id").collect(), list(range(300)), v.tolist())
    rows = np.floor(64 * v).astype(np.int64)
    one, many = W.Spectrum(6), W.Spectrum(6)
    one.add(rows)
    for lo in range(0, 300, 50):
        many.add_block(rows[lo:lo + 50])
    assert one.n == many.n and (one.total == many.total).all() and np.allclose(one.values, many.values, rtol=1e-10, atol=1e-7)


def test_rows_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, -0.25, 1.0], [0.1, 0.9, -0.3], [0.4, 0.4, 0.4], [0.1, 0.9, -0.3]]
    rows = [(i, v) for i, v in enumerate(good)] + [(10, None), (11, [0.1, None, 0.2]), (12, [nan, 0.0, 0.0]), (13, [0.0, inf, 0.0]), (14, []), (15, [1.0]), (None, [0.2, 0.2, 0.9]), (16, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, component string")
    got = W.whiten(df).withColumnRenamed("id", "vec_id").collect()
    check(got, [0, 1, 2, 3, None], [*good, [0.2, 0.2, 0.9]])


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, None)]])
def test_without_two_distinct_vectors(spark, rows):
    out = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []


def test_deviation_beyond_a_long_is_null():
    model = W.Model(3, (0, 3), np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[1 << 40, 0], [2, 5]], np.int64)
    assert W._deviation(x, model) == [None, 36 + 144]
    big = W.Model(1 << 33, ((1 << 33) * 5 + 1, 0), np.ones(1), np.ones((2, 1)), 1.0)
    assert W._deviation(np.array([[5, 0]]), big) == [1]
