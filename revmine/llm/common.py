"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revmine.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


#: options of :func:`stored` for rows of megabytes: sizes are looked at with each row, not first after 100 rows, which a
#: task would hold in memory at once; a row group ends at 8 MB or with the row that passes it
LONG_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def stored(df: DataFrame, name: str, compression: str | None = None, **options: int) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Later uses read the files instead of the work before them, also after the
    loss of an executor.  ``compression``: a codec other than the session's;
    ``options``: of Parquet's writer, such as :data:`LONG_ROWS`.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored table of a few narrow columns, to be broadcast if it has ``rows`` rows at most (about 40 MB of two longs as a hash table).

    Beyond that Spark joins it by its own statistics, with a shuffle and the
    split of skewed partitions.
    """
    return F.broadcast(df) if df.count() <= rows else df


def learnable(id_col: str = "doc_id") -> Column:
    """Labels that may be learnt from: crc32 of the id as text is no multiple of 5."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str,
                    train: Column | None, max_rows: int | None = None) -> DataFrame:
    """(label int, text) of all labelled ids, or of at most ``max_rows`` of them, the first by a hash of the id.

    One row for each id, however often ``docs`` or ``labels`` repeat it: the
    rounded mean label and the smallest text.
    """
    lab = labels.where(train) if train is not None else labels
    lab = (lab.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg(label)).cast("int").alias("_label")))
    chosen = lab if max_rows is None else F.broadcast(lab.orderBy(F.xxhash64("_id"), "_id").limit(max_rows))  # max_rows ids and labels
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return (texts.join(chosen, "_id")
            .groupBy("_id").agg(F.min("_text").alias("text"), F.first("_label").alias("label"))
            .select("label", "text"))
