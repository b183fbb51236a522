"""Equi-joins of the review workflow.

No broadcast hints on data-sized sides: AQE turns a shuffled join into a
broadcast join when the runtime size of a side is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and splits skewed
partitions otherwise.  Explicit ``broadcast`` is used only for sides whose
size is bounded by construction (fixed lists, per-group scalars of a bounded
group set).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# J1
def attach_location(items: DataFrame, makers: DataFrame, item_key: str = "brewery_id",
                    maker_key: str = "id", location: str = "location") -> DataFrame:
    """items LEFT JOIN makers(id, location) on item_key = maker_key (maker key dropped)."""
    m = makers.select(F.col(maker_key).alias("_mk"), F.col(location))
    return items.join(m, items[item_key] == m["_mk"], "left").drop("_mk")


# J2 (+ A1/A2 in one aggregate)
def enrich_with_review_stats(dim: DataFrame, reviews: DataFrame, by: str, on: str = "overall",
                             count_col: str = "review_count", avg_col: str = "avg_overall") -> DataFrame:
    """INNER JOIN of per-key review count and mean: keys without reviews vanish.

    One scan, one partial+final aggregate, one join (the original scanned twice
    and joined twice).
    """
    stats = reviews.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias(count_col), F.avg(on).alias(avg_col))
    return dim.join(stats, by, "inner")


# J3
def join_aspect_means(items: DataFrame, means: DataFrame, entity: str) -> DataFrame:
    return items.join(means, entity, "inner")


# J4
def join_neg_counts(items: DataFrame, counts: DataFrame, entity: str) -> DataFrame:
    return items.join(counts, entity, "inner")


# J5 / W5
def attach_entity_percentile(df: DataFrame, entity: str, col: str, q: float = 10.0,
                             approx: bool = False, out: str = "percentile", accuracy: int = 10_000) -> DataFrame:
    """Per-entity q-th percentile of ``col`` joined back to the rows (inner join).

    Exact, over counted distinct values.  ``approx=True`` asks for a sketch of
    fixed size instead, with an error of 1 / ``accuracy`` of the rank.
    """
    from revmine.operators.ranks import percentile_by_rank

    base = df.where(F.col(entity).isNotNull())
    if approx:
        thr = base.groupBy(entity).agg(F.percentile_approx(col, q / 100.0, accuracy).cast("double").alias(out))
    else:
        thr = percentile_by_rank(base, col, q / 100.0, [entity], out)
    return df.join(thr, entity, "inner")


# J6
def restrict_to_entities(df: DataFrame, keep: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Membership test as a left-semi join (hash semi-join, never a per-row list scan)."""
    keys = _list(key)
    return df.join(keep.select(*keys).distinct(), keys, "left_semi")


# J7
def ignore_users(df: DataFrame, ignored: DataFrame, user: str) -> DataFrame:
    """Drop rows of ignored users (left-anti join)."""
    return df.join(ignored.select(user).distinct(), user, "left_anti")


# J8
def join_country(world: DataFrame, ratings: DataFrame, world_key: str = "SOVEREIGNT",
                 location: str = "location") -> DataFrame:
    """country dim LEFT JOIN mean rating on world_key = location."""
    r = ratings.withColumnRenamed(location, "_loc")
    return world.join(r, world[world_key] == r["_loc"], "left").drop("_loc")


# J10
def align_by_location(counts: DataFrame, totals: DataFrame, location: str = "location",
                      count_col: str = "count", total_col: str = "total", out: str = "percentage") -> DataFrame:
    """counts / totals * 100 on matching locations (inner join)."""
    return (counts.join(totals, location, "inner")
            .withColumn(out, F.col(count_col) / F.col(total_col) * 100.0))
