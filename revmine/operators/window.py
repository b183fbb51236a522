"""Ranks, splits, ordered limits and set-like operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from revmine.functions import lexicon as L
from revmine.operators.joins import attach_entity_percentile
from revmine.operators.ranks import percentile_by_rank, position_in_group, running_sum  # noqa: F401


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# W6
def average_rank(df: DataFrame, col: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Rank of ``col`` with ties averaged (1-based), per ``by`` group.

    Ranked on the counted distinct values, then joined back: a hot value is one
    row for the window.
    """
    by = _list(by)
    out = out or f"{col}_rank"
    vals = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n"))
    cum = running_sum(vals, by, [col], "_n", "_cum")
    ranks = cum.select(*by, col, (F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, [*by, col], "left")


# W5 / T3 / U5
def pos_neg_partition(df: DataFrame, col: str, threshold, out: str = "polarity",
                      negative: str = "negative", positive: str = "positive", digits: int = 9) -> DataFrame:
    """``col <= threshold`` -> negative, ``>`` -> positive, NULL -> neither.

    Both sides are rounded to ``digits`` decimals before comparing, so a value
    equal to an interpolated threshold lands on the same side in every engine.
    """
    thr = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    v, t = F.round(F.col(col), digits), F.round(thr, digits)
    return df.withColumn(out, F.when(v <= t, F.lit(negative)).when(v > t, F.lit(positive)))


def quantile_split(df: DataFrame, entity: str, col: str = "rating", q: float = 10.0, out: str = "polarity",
                   approx: bool = False) -> DataFrame:
    """Per-entity q-th percentile; <= -> negative, > -> positive."""
    with_p = attach_entity_percentile(df, entity, col, q, approx=approx)
    return pos_neg_partition(with_p, col, "percentile", out)


def entity_percentile_split(df: DataFrame, entity: str, col: str = "rating", q: float = 10.0) -> DataFrame:
    """Each row with its entity's q-th percentile as ``percentile``; entities of NULL rows are left out."""
    return attach_entity_percentile(df, entity, col, q)


def global_threshold_split(df: DataFrame, entity: str, col: str = "rating", q: float = 10.0,
                           min_each: int = 10, out: str = "polarity") -> DataFrame:
    """T4: one global percentile as threshold, then keep entities with more than
    ``min_each`` reviews on each side (A24)."""
    thr = percentile_by_rank(df, col, q / 100.0).select("percentile").scalar()
    labelled = pos_neg_partition(df.withColumn("_thr", thr), col, "_thr", out).drop("_thr")
    counts = labelled.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.count_if(F.col(out) == "negative").alias("_bad"), F.count_if(F.col(out) == "positive").alias("_good"))
    keep = counts.where((F.col("_bad") > min_each) & (F.col("_good") > min_each)).select(entity)
    return labelled.join(keep, entity, "left_semi")


# T5
def emotion_split(df: DataFrame, feel: str = "max_feel", out: str = "polarity") -> DataFrame:
    """disgust/sadness -> negative; neutral/joy -> positive; others -> neither."""
    return df.withColumn(out, F.when(F.col(feel).isin(L.NEGATIVE_EMOTIONS), F.lit("negative"))
                         .when(F.col(feel).isin(L.POSITIVE_EMOTIONS), F.lit("positive")))


# K1
def most_negative_reviews(df: DataFrame, score: str = "polarity", key: str = "review_id", n: int = 5,
                          reverse: bool = False) -> DataFrame:
    """The n rows with the highest ``score`` (or lowest with ``reverse``), ties by key."""
    order = [F.col(score).asc() if reverse else F.col(score).desc(), F.col(key).asc()]
    return df.orderBy(*order).limit(n)


# K3
def sample_first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """``head(n)`` with an explicit order (row order is not defined in Spark)."""
    return df.orderBy(*_list(order)).limit(n)


# K4
def order_by_total(df: DataFrame, cols: Sequence[str], out: str = "total") -> DataFrame:
    """Adds the row total of ``cols`` and sorts by it, largest first."""
    total = sum((F.col(c) for c in cols), F.lit(0))
    return df.withColumn(out, total.cast("bigint")).orderBy(F.col(out).desc())


# K6
def select_styles(df: DataFrame, names: Sequence[str], col: str = "style") -> DataFrame:
    return df.where(F.col(col).isin(list(names)))


# U4
def compare_sites(dfs: dict[str, DataFrame]) -> DataFrame:
    """Stack the same metric of several datasets with a ``site`` column."""
    parts = [d.withColumn("site", F.lit(s)) for s, d in dfs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out

