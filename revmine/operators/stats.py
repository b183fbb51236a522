"""Statistics (M1-M8)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revmine.functions.arrays import circular_pair_smooth, circular_triple_smooth  # noqa: F401  (M4, M5)
from revmine.operators.aggregate import row_normalise_pct  # noqa: F401  (M7)
from revmine.operators.text import document_frequency, tfidf_scores  # noqa: F401  (M6, M1)
from revmine.operators.window import average_rank


# M2
def spearman(df: DataFrame, x: str, ys: Sequence[str], label: str = "label",
             out: str = "spearman") -> DataFrame:
    """Spearman rank correlation of ``x`` with each column of ``ys``.

    Long form: one ``(label, value)`` row per (row, y); average ranks (ties
    averaged) per label; Pearson ``corr`` of the ranks per label.  Rows with a
    NULL in x or y are left out pairwise.
    """
    ys = list(ys)
    long = df.select(x, F.inline(F.array(*[F.struct(F.lit(y).alias(label), F.col(y).cast("double").alias("value"))
                                           for y in ys])))
    long = long.where(F.col(x).isNotNull() & F.col("value").isNotNull())
    r = average_rank(long, x, [label], "_rx")
    r = average_rank(r, "value", [label], "_ry")
    den = F.stddev_pop("_rx") * F.stddev_pop("_ry")
    rho = F.when(den > 0, F.covar_pop("_rx", "_ry") / den)
    return r.groupBy(label).agg(rho.alias(out), F.count("*").alias("n"))


# M3
def _t_two_sided_p(t: float, nu: int) -> float:
    """P(|T| >= |t|) for Student's t with integer ``nu`` (finite series)."""
    if nu < 1:
        return float("nan")
    if math.isinf(t):
        return 0.0
    theta = math.atan(abs(t) / math.sqrt(nu))
    s, c = math.sin(theta), math.cos(theta)
    if nu % 2 == 1:
        acc, term = 0.0, 1.0
        if nu > 1:
            acc = 1.0
            for k in range(1, (nu - 3) // 2 + 1):
                term *= (2 * k) / (2 * k + 1) * c * c
                acc += term
            a = 2.0 / math.pi * (theta + s * c * acc)
        else:
            a = 2.0 / math.pi * theta
    else:
        acc, term = 1.0, 1.0
        for k in range(1, (nu - 2) // 2 + 1):
            term *= (2 * k - 1) / (2 * k) * c * c
            acc += term
        a = s * acc
    return max(0.0, min(1.0, 1.0 - a))


def spearman_p_series(r: pd.Series, n: pd.Series) -> pd.Series:
    """Undefined coefficients (or n < 3) give NULL, not NaN."""
    out = []
    for rv, nv in zip(r, n):
        if rv is None or nv is None or pd.isna(rv) or pd.isna(nv) or nv < 3:
            out.append(None)
        elif abs(rv) >= 1.0:
            out.append(0.0)
        else:
            t = rv * math.sqrt((nv - 2) / (1.0 - rv * rv))
            out.append(_t_two_sided_p(t, int(nv) - 2))
    return pd.Series(pd.array(out, dtype="Float64"))


@F.pandas_udf(T.DoubleType())
def spearman_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return spearman_p_series(r, n)


def spearman_p_value(df: DataFrame, r: str = "spearman", n: str = "n", out: str = "p_value") -> DataFrame:
    """Two-sided p-value of a rank correlation (t test with n - 2 degrees of
    freedom); runs on the few result rows only."""
    return df.withColumn(out, spearman_p_udf(F.col(r), F.col(n)))


# M8
def weighted_mean(value, weight) -> Column:
    """Aggregate expression ``sum(w * x) / sum(w)``."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.try_divide(F.sum(w * v), F.sum(w))
