"""Ranks, running sums and exact percentiles that no task has to hold or sort as a whole.

Positions and running sums have two levels: range slices of (keys, order),
stored once, and the sums of earlier slices.  Percentiles work on counted
distinct values (a partial aggregate before the shuffle); a group with more
than ``MAX_VALUES`` of them is narrowed first, range by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from revmine.session import cut_lineage


#: distinct values of a group that one task may sort
MAX_VALUES = 1_000_000
#: pieces that a round cuts a group's range into
PIECES = 64


def _list(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence, slices: int | None) -> DataFrame:
    """``df`` dealt to range slices of (keys, order), stored once; ``_slice`` numbers the slices in that order.

    Slices are drawn from a sample, so they are stored before anything is
    counted: work done again would cut them elsewhere.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value, out: str, slices: int | None = None) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in ``order`` (inclusive); a NULL key is a group; without keys over all rows.

    Two levels: sums inside range slices of (keys, order), and before them what
    earlier slices hold of the same key.  A key with a third of all rows is
    sorted in a third of the slices.  Only a slice's first and last key can go
    on in another slice, so at most two sums a slice are added up.  Rows
    with equal keys and order meet in one slice.
    """
    keys, order = _list(keys), _list(order)
    v = F.col(value) if isinstance(value, str) else value
    rows = _sliced(df.withColumn("_v", v), keys, order, slices)
    inside = F.sum("_v").over(Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if keys:
        key = F.struct(*keys)
        ends = rows.groupBy("_slice").agg(F.min(key).alias("a"), F.max(key).alias("b"))
        ends = ends.select(F.explode(F.array("a", "b")).alias("_e")).distinct()  # two keys a slice at most
        mine = rows.select("_slice", "_v", key.alias("_k")).join(F.broadcast(ends), F.col("_k").eqNullSafe(F.col("_e")), "left_semi")
    else:
        mine = rows.select("_slice", "_v", F.lit(0).alias("_k"))
    sums = mine.groupBy("_slice", "_k").agg(F.sum("_v").alias("_n"))
    upto = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_slice").alias("_s"), "_k", F.sum("_n").over(upto).alias("_before")).where("_before is not null")
    same = F.col("_slice") == F.col("_s")
    if keys:
        same = same & F.struct(*keys).eqNullSafe(F.col("_k"))
    placed = rows.withColumn("_sum", inside).join(F.broadcast(before), same, "left")
    total = F.when(F.col("_before").isNull(), F.col("_sum")).when(F.col("_sum").isNull(), F.col("_before")).otherwise(F.col("_sum") + F.col("_before"))
    return placed.select(*df.columns, total.alias(out))


def position_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "position",
                      slices: int | None = None) -> DataFrame:
    """``row_number()`` per key in ``order`` (add a tiebreaker for a stable order); without keys over all rows."""
    placed = running_sum(df, keys, order, F.lit(1).cast("bigint"), "_position", slices)
    kind = "int" if _list(keys) else "bigint"
    return placed.select(*df.columns, F.col("_position").cast(kind).alias(out))


def counted(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., col, _n)``: rows per distinct value, NULL and NaN left out."""
    return (df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
            .groupBy(*_list(by), col).agg(F.count("*").alias("_n")))


def percentile_by_rank(df: DataFrame, col: str, q: float, by: Sequence[str] = (),
                       out: str = "percentile", max_values: int = MAX_VALUES) -> DataFrame:
    """Exact linear-interpolated percentile (numpy / ``quantile_cont``) per ``by`` group.

    Values are counted first, so ``percentile`` merges one entry per distinct
    value of a group, however many rows it has.  A group with more than
    ``max_values`` distinct values is narrowed to the range that holds the rank
    (:func:`_narrowed`) until it has no more than that, all such groups in one
    pass a round; a NULL in ``by`` is a group.
    """
    by = _list(by)
    vals = counted(df, col, by).withColumn("_x", F.col(col).cast("double"))
    groups = [F.col(c) for c in by] or [F.lit(0)]
    keys = [f"_g{i}" for i in range(len(groups))]
    vals = cut_lineage(vals.select(*[g.alias(k) for g, k in zip(groups, keys, strict=True)], "_x", "_n"))
    names = [F.col(k).alias(c) for k, c in zip(keys, by, strict=False)]
    sizes = vals.groupBy(*keys).agg(F.count("*").alias("_d"), F.sum("_n").alias("_rows"))
    large = cut_lineage(sizes.where(F.col("_d") > max_values))  # one row for each max_values values at most
    whole = F.percentile("_x", q, F.col("_n")).alias(out)
    if large.isEmpty():
        return vals.groupBy(*keys[:len(by)]).agg(whole).select(*names, out)
    rest = vals.join(F.broadcast(large.select(*[F.col(k).alias(f"l{k}") for k in keys])), _same(keys, "l"), "left_anti")
    found = _narrowed(vals, large, keys, q, out, max_values)
    return rest.groupBy(*keys).agg(whole).select(*keys, out).unionByName(found.select(*keys, out)).select(*names, out)


def _same(keys: Sequence[str], prefix: str) -> Column:
    """Equal keys, NULL like any other, on the rows of two frames, one with prefixed names."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def _narrowed(vals: DataFrame, large: DataFrame, keys: list[str], q: float, out: str, max_values: int) -> DataFrame:
    """Percentile of each group of ``large`` by repeated refinement of the range that holds its rank.

    A round cuts a group's present range at ``PIECES`` - 1 approximate quantiles
    of its distinct values, counts each piece and goes on with the piece of the
    wanted rank.  If the two values to interpolate between fall in two pieces,
    they are the greatest of one and the least of the next.
    """
    place = (F.col("_rows") - 1) * F.lit(float(q))
    open_ = large.select(*keys, F.floor(place).cast("bigint").alias("_lo"), F.ceil(place).cast("bigint").alias("_hi"), place.alias("_at"),
                         F.lit(None).cast("double").alias("_a"), F.lit(None).cast("double").alias("_b"), F.lit(0).cast("bigint").alias("_below"), "_d")
    found = None
    while True:
        state = open_.select(*[F.col(k).alias(f"s{k}") for k in keys], "_lo", "_hi", "_at", "_a", "_b", "_below", "_d")
        inside = (vals.join(F.broadcast(state), _same(keys, "s"))  # few groups
                  .where((F.col("_a").isNull() | (F.col("_x") >= F.col("_a"))) & (F.col("_b").isNull() | (F.col("_x") <= F.col("_b"))))
                  .select(*keys, "_x", "_n", "_lo", "_hi", "_at", "_below", "_d"))
        cuts = F.percentile_approx("_x", [i / PIECES for i in range(1, PIECES)], 10 * PIECES)
        edges = inside.groupBy(*keys).agg(cuts.alias("_cuts")).select(*[F.col(k).alias(f"e{k}") for k in keys], "_cuts")
        piece = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
        per = (inside.join(F.broadcast(edges), _same(keys, "e")).withColumn("_p", piece)
               .groupBy(*keys, "_p", "_lo", "_hi", "_at", "_below").agg(F.sum("_n").alias("_m"), F.count("*").alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max")))
        upto = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)  # PIECES rows of a group
        per = per.withColumn("_end", F.col("_below") + F.sum("_m").over(upto)).withColumn("_start", F.col("_end") - F.col("_m"))
        holds = lambda rank: (F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_end"))
        hit = per.where(holds("_lo") | holds("_hi")).groupBy(*keys, "_lo", "_hi", "_at").agg(
            F.count("*").alias("_k"), F.max(F.when(holds("_lo"), F.col("_max"))).alias("_left"), F.min(F.when(holds("_hi"), F.col("_min"))).alias("_right"),
            F.min("_min").alias("_a"), F.max("_max").alias("_b"), F.min("_start").alias("_below"), F.max("_c").alias("_d"))
        hit = cut_lineage(hit)
        known = (F.col("_k") == 2) | (F.col("_a") == F.col("_b"))
        done = hit.where(known).select(*keys, _between(F.col("_at"), F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_left")),
                                                       F.when(F.col("_a") == F.col("_b"), F.col("_b")).otherwise(F.col("_right"))).alias(out))
        few = hit.where(~known & (F.col("_d") <= max_values))
        few = few.select(*[F.col(k).alias(f"s{k}") for k in keys], "_lo", "_hi", "_at", "_a", "_b", "_below")
        some = vals.join(F.broadcast(few), _same(keys, "s")).where(F.col("_x").between(F.col("_a"), F.col("_b")))
        within = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)  # max_values rows of a group
        some = some.withColumn("_end", F.col("_below") + F.sum("_n").over(within)).withColumn("_start", F.col("_end") - F.col("_n"))
        pair = some.groupBy(*keys, "_at").agg(F.max(F.when(holds("_lo"), F.col("_x"))).alias("_left"), F.max(F.when(holds("_hi"), F.col("_x"))).alias("_right"))
        part = done.unionByName(pair.select(*keys, _between(F.col("_at"), F.col("_left"), F.col("_right")).alias(out)))
        found = part if found is None else found.unionByName(part)
        open_ = cut_lineage(hit.where(~known & (F.col("_d") > max_values)))
        if open_.isEmpty():
            return found


def _between(at: Column, left: Column, right: Column) -> Column:
    """Value at a fractional rank between two neighbours."""
    low = F.floor(at).cast("double")
    return F.when(left == right, left).otherwise((low + 1.0 - at) * left + (at - low) * right)
