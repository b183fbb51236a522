"""Aggregations.

All are hash aggregations with map-side partial aggregation.  Global scalars
(percentiles, min/max) are scalar subqueries (`DataFrame.scalar()`), so no
cross join and no value travels through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.operators.clean import classify_location, normalise_country


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


# A1
def review_counts_by(df: DataFrame, by: str | Sequence[str], out: str = "review_count") -> DataFrame:
    keys = _list(by)
    return _not_null(df, keys).groupBy(*keys).agg(F.count("*").alias(out))


# A2
def review_avg_by(df: DataFrame, by: str | Sequence[str], on: str, out: str | None = None) -> DataFrame:
    """Mean per key (NULLs skipped; the original let NaN poison a group)."""
    keys = _list(by)
    return _not_null(df, keys).groupBy(*keys).agg(F.avg(on).alias(out or f"avg_{on}"))


# A3
def aspect_means(df: DataFrame, entity: str, cols: Sequence[str] = L.ASPECTS, prefix: str = "avg_") -> DataFrame:
    return _not_null(df, [entity]).groupBy(entity).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in cols])


# A9
def beers_by_location_category(df: DataFrame, location: str = "location", n: str = "nbr_beers",
                               home: str = L.HOME_COUNTRY) -> DataFrame:
    cat = classify_location(F.col(location), home)
    return (df.groupBy(cat.alias("Location")).agg(F.sum(n).cast("bigint").alias("Total Beers"))
            .where(F.col("Location").isNotNull()))


# A10 / U4
def reviews_per_entity_sum(dfs: dict[str, DataFrame], entity: str, n: str,
                           out: str = "total_reviews") -> DataFrame:
    """Sum of ``n`` per entity for several sites, stacked with a ``site`` column."""
    parts = [d.groupBy(entity).agg(F.sum(n).cast("bigint").alias(out)).withColumn("site", F.lit(site))
             for site, d in dfs.items()]
    out_df = parts[0]
    for p in parts[1:]:
        out_df = out_df.unionByName(p)
    return out_df


# A11
def percentile_expr(col: str, q: float, approx: bool = False, accuracy: int = 10_000) -> Column:
    if approx:
        return F.percentile_approx(col, q / 100.0, accuracy).cast("double")
    return F.percentile(F.col(col), q / 100.0)


def percentile_value(df: DataFrame, col: str, q: float = 50.0, approx: bool = False) -> DataFrame:
    """Exact, linearly interpolated percentile (numpy default); one row.

    Exact = over counted distinct values; ``approx=True`` = sketch.
    """
    if approx:
        return df.agg(percentile_expr(col, q, True).alias("percentile"))
    from revmine.operators.ranks import percentile_by_rank

    return percentile_by_rank(df, col, q / 100.0)


def percentile_scalar(df: DataFrame, col: str, q: float, approx: bool = False) -> Column:
    """The global percentile as a scalar subquery column."""
    return percentile_value(df, col, q, approx).select("percentile").scalar()


# A12
def count_above_percentile(df: DataFrame, col: str, q: float = 50.0, approx: bool = False) -> DataFrame:
    thr = percentile_scalar(df, col, q, approx)
    return df.where(F.col(col) > thr).agg(F.count("*").alias("n_above"))


# A13
def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram like ``numpy.histogram(x, bins)``: all bins (also
    empty ones), last bin closed, a constant column spread over [v-0.5, v+0.5].

    ``(bin, bin_start, bin_end, count)``.  The bounds are one scalar subquery
    (a struct) attached as columns once, so every edge expression reads
    columns instead of re-embedding the subquery; the bin index is a
    projection and the count an ordinary partial aggregate.
    """
    vals = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    bounds = vals.agg(F.struct(F.min("_x").alias("mn"), F.max("_x").alias("mx")).alias("b")).scalar()

    def with_bounds(d: DataFrame) -> DataFrame:
        d = d.withColumn("_b", bounds)
        d = d.withColumn("_lo", F.when(F.col("_b.mn") == F.col("_b.mx"), F.col("_b.mn") - 0.5).otherwise(F.col("_b.mn")))
        return d.withColumn("_hi", F.when(F.col("_b.mn") == F.col("_b.mx"), F.col("_b.mx") + 0.5)
                            .otherwise(F.col("_b.mx"))).drop("_b")

    lo, hi = F.col("_lo"), F.col("_hi")
    counts = (with_bounds(vals).select(bin_index(F.col("_x"), lo, hi, bins).alias("bin"))
              .groupBy("bin").agg(F.count("*").alias("count")))
    edges = (with_bounds(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")))
             .select("bin", edge(lo, hi, bins, F.col("bin")).alias("bin_start"),
                     F.when(F.col("bin") == bins - 1, hi).otherwise(edge(lo, hi, bins, F.col("bin") + 1))
                     .alias("bin_end")))
    return (edges.join(counts, "bin", "left")
            .select("bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def edge(lo: Column, hi: Column, bins: int, i: Column) -> Column:
    return lo + i.cast("double") * ((hi - lo) / F.lit(float(bins)))


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy's bin search: scaled floor, clamp, then fix values on either side of an edge."""
    raw = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    i = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    i = F.when(x < edge(lo, hi, bins, i), i - 1).otherwise(i)
    return F.when((x >= edge(lo, hi, bins, i + 1)) & (i != bins - 1), i + 1).otherwise(i)


# A14
def percentile_histogram_report(df: DataFrame, col: str, q: float = 50.0, bins: int = 10) -> DataFrame:
    """Histogram rows with the q-th percentile and the count strictly above it attached."""
    thr = percentile_scalar(df, col, q)
    n_above = df.where(F.col(col) > thr).agg(F.count("*")).scalar()
    return histogram(df, col, bins).withColumn("percentile", thr).withColumn("n_above", n_above)


# A15
def avg_rating_by_location(df: DataFrame, location: str = "location", rating: str = "avg_overall") -> DataFrame:
    out = normalise_country(df.select(location, rating), location, subset=[location, rating])
    return out.groupBy(location).agg(F.avg(rating).alias(rating))


# A16 / M7
def emotion_share_by_score(df: DataFrame, score: str = "score", feel: str = "max_feel",
                           labels: Sequence[str] = L.EMOTIONS) -> DataFrame:
    """Counts score x label (0-filled, fixed label columns) and their % per score row."""
    labels = list(labels)
    counts = df.groupBy(score).pivot(feel, labels).count().na.fill(0, subset=labels)
    total = sum((F.col(c) for c in labels), F.lit(0))
    return counts.select(score, *[(F.col(c) * 100.0 / total).alias(c) for c in labels])


def row_normalise_pct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M7: each column / row sum * 100."""
    total = sum((F.col(c) for c in cols), F.lit(0))
    return df.select(*[c for c in df.columns if c not in cols],
                     *[F.try_divide(F.col(c) * 100.0, total).alias(c) for c in cols])


# A17 / K2 / K4
def top_locations(df: DataFrame, location: str = "location", n: int = 10) -> DataFrame:
    """K2: the n most frequent locations (ties by location)."""
    return (_not_null(df, [location]).groupBy(location).agg(F.count("*").alias("total"))
            .orderBy(F.col("total").desc(), F.col(location).asc()).limit(n))


def emotion_by_location(df: DataFrame, location: str = "location", feel: str = "max_feel", top: int = 10,
                        labels: Sequence[str] = L.EMOTIONS) -> DataFrame:
    """Counts (location x label) for the ``top`` most frequent locations,
    ordered by total desc (K4)."""
    labels = list(labels)
    keep = top_locations(df, location, top)
    sub = df.join(keep.select(location), location, "left_semi")
    from revmine.operators.window import order_by_total

    piv = sub.groupBy(location).pivot(feel, labels).count().na.fill(0, subset=labels)
    return order_by_total(piv, labels)


# A18
def top_locations_by_emotion(df: DataFrame, threshold: int, emotion: str, n: int,
                             location: str = "location", feel: str = "max_feel") -> DataFrame:
    """% of rows with ``emotion`` per location with more than ``threshold`` rows; top n."""
    agg = (_not_null(df, [location]).groupBy(location)
           .agg(F.count("*").alias("total"), F.count_if(F.col(feel) == emotion).alias("hits")))
    return (agg.where((F.col("total") > threshold) & (F.col("hits") > 0))
            .select(location, (F.col("hits") / F.col("total") * 100.0).alias("percentage"))
            .orderBy(F.col("percentage").desc(), F.col(location).asc()).limit(n))


# A22 (+ M5)
def emotion_profile_by_score(df: DataFrame, score: str = "score", cols: Sequence[str] = L.EMOTIONS) -> DataFrame:
    """Mean of each label probability per score, 3-point circular smoothing, / max."""
    from revmine.functions.arrays import circular_triple_smooth

    cols = list(cols)
    means = df.groupBy(score).agg(F.array(*[F.avg(c) for c in cols]).alias("_m"))
    sm = circular_triple_smooth(F.col("_m"))
    return means.select(score, *[F.element_at(sm, i + 1).alias(c) for i, c in enumerate(cols)])


# A24
def neg_pos_review_counts(df: DataFrame, entity: str, label: str = "polarity", negative: str = "negative",
                          min_each: int = 10) -> DataFrame:
    """Per entity total and negative counts; keep entities with both sides > min_each."""
    agg = (_not_null(df, [entity]).groupBy(entity)
           .agg(F.count("*").alias("total"), F.count_if(F.col(label) == negative).alias("bad")))
    return agg.where((F.col("bad") > min_each) & ((F.col("total") - F.col("bad")) > min_each))


# A25
def category_share(df: DataFrame, cols: Sequence[str] = L.CATEGORIES) -> DataFrame:
    """% of words in each list column; all-empty rows give NULL (guarded)."""
    from revmine.functions.text import capitalise  # noqa: F401  (labels are capitalised)

    cols = list(cols)
    total = sum((F.coalesce(F.size(c), F.lit(0)) for c in cols), F.lit(0))
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[F.when(total > 0, F.size(c) * 100.0 / total).alias(c.capitalize())
                              for c in cols])


# A27
def axis_range(dfs: Sequence[DataFrame], col: str) -> DataFrame:
    u = dfs[0].select(col)
    for d in dfs[1:]:
        u = u.unionByName(d.select(col))
    return u.agg(F.min(col).alias("min"), F.max(col).alias("max"))


# A28
def abv_bins(df: DataFrame, col: str, edges: Sequence[float], value: str | None = None) -> DataFrame:
    """Interval bins ``[e_i, e_{i+1})`` and count (+ mean of ``value``).

    Every row is counted: the first bin is open below, the last above, and
    NULL or NaN is a bin of its own (NULL).
    """
    b = F.lit(0)
    for i, e in enumerate(list(edges)[1:-1], 1):
        b = F.when(F.col(col) >= e, F.lit(i)).otherwise(b) if i == 1 else F.when(F.col(col) < e, b).otherwise(F.lit(i))
    b = F.when(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")), b)
    aggs = [F.count("*").alias("count")]
    if value:
        aggs.append(F.avg(value).alias(f"avg_{value}"))
    return df.groupBy(b.alias("bin")).agg(*aggs)


# A29
def distinct_values(df: DataFrame, col: str | Sequence[str]) -> DataFrame:
    return df.select(*_list(col)).distinct()
