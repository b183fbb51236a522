"""Key-value review files.

Format: ``key: value`` lines, a blank line ends a record.  A line is split at
its *first* ``": "``; a repeated key keeps its last value; several blank lines
are tolerated and a last record without a trailing blank line is kept.  Lines
without ``": "`` (the original raised) are collected in ``_corrupt``.

The file is read with ``lineSep="\\n\\n"``, so each record is one row and the
file splits into tasks on record borders; parsing is a chain of higher-order
functions (no Python).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.functions import text as X

SEP = ": "


def _entries(block: Column) -> Column:
    lines = F.filter(F.split(block, "\n"), lambda ln: ln != "")
    return F.transform(lines, lambda ln: F.struct(
        F.when(F.instr(ln, SEP) > 0, F.substring_index(ln, SEP, 1)).alias("key"),
        F.when(F.instr(ln, SEP) > 0, F.substr(ln, F.instr(ln, SEP) + 2)).alias("value"),
        ln.alias("line")))


def _last_value(entries: Column, key: str) -> Column:
    hits = F.filter(entries, lambda e: e["key"] == key)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["value"])


# S2
def parse_review_block(df: DataFrame, block: str, keys: Sequence[str] | None = None,
                       as_map: str | None = None) -> DataFrame:
    """Parse a text column of blocks.

    ``keys`` -> one string column per key (last occurrence wins; missing ->
    NULL).  ``as_map`` -> also a ``map<string,string>`` column with every key
    (last occurrence wins).  ``_corrupt`` lists lines without separator.
    """
    ent = _entries(F.col(block))
    good = F.filter(ent, lambda e: e["key"].isNotNull())
    out = df.withColumn("_e", ent)
    cols = []
    if keys:
        cols += [_last_value(F.col("_e"), k).alias(k) for k in keys]
    if as_map:
        # keep an entry only if no later entry has the same key -> last wins
        dedup = F.filter(good, lambda e, i: ~F.exists(F.slice(good, i + 2, F.greatest(F.size(good), F.lit(1))),
                                                     lambda x: x["key"] == e["key"]))
        cols.append(F.map_from_entries(F.transform(dedup, lambda e: F.struct(e["key"], e["value"]))).alias(as_map))
    cols.append(F.transform(F.filter(F.col("_e"), lambda e: e["key"].isNull()), lambda e: e["line"]).alias("_corrupt"))
    return out.select("*", *cols).drop("_e")


def _blocks(spark: SparkSession, path: str | list[str], line_end: str) -> DataFrame:
    """``(_block, _file, _pos)``: the non-blank records of text files, with ``\\n`` line ends."""
    raw = spark.read.option("lineSep", line_end * 2).text(path)
    block = F.replace(F.col("value"), F.lit("\r\n"), F.lit("\n")) if line_end == "\r\n" else F.col("value")
    blocks = raw.select(F.regexp_replace(block, r"^\n+", "").alias("_block"),
                        F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_pos"))
    return blocks.where(F.trim("_block") != "")


def _first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each partition; its task reads no further."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = n
        for batch in batches:
            yield batch.slice(0, left)
            left -= batch.num_rows
            if left <= 0:
                return

    return df.mapInArrow(run, df.schema)


def _first_blocks(spark: SparkSession, path: str, line_end: str, n: int) -> DataFrame:
    """The first n records in file order, without reading much beyond them.

    Files are counted in path order, four times as many at a time, until they
    hold n records.  Files that are wanted whole are read whole; of the one that
    holds the n-th record each split is read up to what is still missing.
    """
    files = sorted(spark.read.text(path).inputFiles())
    whole: list[str] = []
    part, left, i, step = None, n, 0, 1
    while i < len(files) and left > 0:
        some = files[i:i + step]
        rows = _blocks(spark, [unquote(f) for f in some], line_end).select("_file")
        if step == 1:
            rows = _first_rows(rows, left + 1)
        counts = {r["_file"]: r["count"] for r in rows.groupBy("_file").count().collect()}  # a row for each file
        for f in some:
            if counts.get(f, 0) > left:
                part = f
                break
            whole.append(f)
            left -= counts.get(f, 0)
        if part is not None:
            break
        i, step = i + step, step * 4
    out = _blocks(spark, [unquote(f) for f in whole], line_end) if whole else None
    if part is not None and left > 0:
        last = _first_rows(_blocks(spark, [unquote(part)], line_end), left).orderBy("_pos").limit(left)
        out = last if out is None else out.unionByName(last)
    return out if out is not None else _blocks(spark, path, line_end).where("false")


# S1
def read_review_blocks(spark: SparkSession, path: str, keys: Sequence[str] | None = None,
                       casts: Mapping[str, str] | None = L.REVIEW_CASTS, max_reviews: int | None = None,
                       as_map: str | None = None, line_end: str = "\n", strict: bool = False) -> DataFrame:
    """Read key-value review records from text files (one row per record).

    ``max_reviews`` keeps the first records in file order (file, then
    position in the file) and reads only the files that hold them.  ``line_end``: ``"\\r\\n"`` for files with Windows
    line ends.  A line without separator lands in ``_corrupt``; ``strict``
    makes it an error instead.
    """
    blocks = _blocks(spark, path, line_end) if max_reviews is None else _first_blocks(spark, path, line_end, max_reviews)
    if keys is None and as_map is None:
        as_map = "fields"
    parsed = parse_review_block(blocks, "_block", keys, as_map).drop("_block")
    if strict:
        bad = F.raise_error(F.concat(F.lit("line without a separator: "), F.get("_corrupt", F.lit(0))))
        parsed = parsed.withColumn("_corrupt", F.when(F.size("_corrupt") > 0, bad.cast("array<string>")).otherwise(F.col("_corrupt")))
    if casts and keys:
        parsed = cast_review_fields(parsed, {k: v for k, v in casts.items() if k in keys})
    return parsed.drop("_file", "_pos")


# S3
def cast_review_fields(df: DataFrame, casts: Mapping[str, str] = L.REVIEW_CASTS, do_cast: bool = True) -> DataFrame:
    """Apply the cast table; ``do_cast=False`` keeps raw strings.

    A value that does not parse becomes NULL (the original raised), float
    "nan" becomes NULL, ``review`` is true only for the text "True", and
    ``date`` (epoch seconds) becomes a timestamp.
    """
    if not do_cast:
        return df
    out = df
    for k, t in casts.items():
        if k not in df.columns:
            continue
        c = F.col(k)
        if t == "boolean":
            v = c == F.lit("True")
        elif t == "double":
            v = _nan_to_null(F.expr(f"try_cast(`{k}` AS DOUBLE)"))
        else:
            v = F.expr(f"try_cast(`{k}` AS {t.upper()})")
        out = out.withColumn(k, v)
    if "date" in casts and "date" in df.columns and casts["date"] in ("bigint", "long", "int"):
        out = out.withColumn("date", F.timestamp_seconds(F.col("date")))
    return out


def _nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# S4
def read_simple_reviews(spark: SparkSession, path: str, n: int | None = None, line_end: str = "\n") -> DataFrame:
    """``review, score, beer_name, user_id`` per record.

    score = Python ``round`` of the rating (half-even) as int; every "text: "
    is removed from the text and the broken apostrophe becomes "'".  ``n``
    keeps the first n records in file order (file, then position in the file)
    and reads only the files that hold them.
    """
    blocks = _blocks(spark, path, line_end) if n is None else _first_blocks(spark, path, line_end, n)
    parsed = parse_review_block(blocks, "_block", ["text", "rating", "beer_name", "user_id"])
    out = parsed.select(
        "_file", "_pos",
        X.fix_mojibake_apostrophe(F.replace(F.concat(F.lit("text: "), F.col("text")), F.lit("text: "), F.lit("")),
                                  "'").alias("review"),
        X.round_half_even(_nan_to_null(F.expr("try_cast(rating AS DOUBLE)"))).try_cast("int").alias("score"),
        F.col("beer_name"),
        F.expr("try_cast(user_id AS BIGINT)").alias("user_id"))
    return out.drop("_file", "_pos")


def render_review_block(cols: Mapping[str, Column]) -> Column:
    """Inverse of the parser: ``key: value`` lines joined by newlines (values
    must not contain a newline)."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}{SEP}"), v.cast("string")) for k, v in cols.items()])
