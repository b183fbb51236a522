"""Incremental per-key review statistics (the one streaming extension).

A key-value review file dropped into a folder (or any streaming source) is
parsed record by record and a running count and mean per key is kept in
Structured Streaming state.  Only sums and counts are kept per key, so state
grows with the number of keys, not with the number of reviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.session import ensure_checkpoint_dir
from revmine.sources.reviews import parse_review_block
from revmine.streaming.keyed_table import LEAST_ROWS, KeyedTable


def review_blocks_stream(spark: SparkSession, folder: str, files_per_epoch: int | None = None) -> DataFrame:
    """Stream of review records from text files in ``folder`` (record per row)."""
    reader = spark.readStream.option("lineSep", "\n\n")
    if files_per_epoch:
        reader = reader.option("maxFilesPerTrigger", files_per_epoch)
    raw = reader.text(folder)
    return raw.select(F.regexp_replace("value", r"^\n+", "").alias("_block")).where(F.trim("_block") != "")


def running_stats(stream: DataFrame, by: str, on: str) -> DataFrame:
    """A1 + A2 as a streaming aggregate: ``(by, review_count, avg_on)``."""
    return (stream.where(F.col(by).isNotNull()).groupBy(by)
            .agg(F.count("*").alias("review_count"), F.avg(F.col(on).cast("double")).alias(f"avg_{on}")))


def _write_epochs(stats: DataFrame, path: str):
    """Each epoch's table in a folder of its own: a failure leaves the earlier
    epochs whole, and a retried epoch rewrites the same folder."""
    empty = stats.sparkSession.createDataFrame([], stats.schema)
    empty.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch=-1")

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch_id}")

    return write


def latest_epoch(spark: SparkSession, path: str) -> DataFrame:
    """The table of the last complete epoch (one without a success mark is being written)."""
    all_epochs = spark.read.parquet(path)
    return all_epochs.where(F.col("epoch") == _last(spark, path)).drop("epoch")


def _last(spark: SparkSession, path: str) -> int:
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith("epoch=")]
    child = spark._jvm.org.apache.hadoop.fs.Path
    return max(int(p.getName()[6:]) for p in done if fs.exists(child(p, "_SUCCESS")))


def stream_review_stats(spark: SparkSession, folder: str, by: str = "beer_id", on: str = "overall",
                        *, output_path: str, name: str = "review_stats", checkpoint: str | None = None,
                        available_now: bool = True):
    """Start the query in complete mode; read its table with :func:`latest_epoch`.

    Sink: parquet folders ``epoch=<id>`` below ``output_path``; nothing is
    gathered on the driver.  The checkpoint lives under the cluster's
    ``spark.checkpoint.dir`` so a restarted driver resumes from the committed
    offsets and state.
    """
    blocks = review_blocks_stream(spark, folder)
    parsed = parse_review_block(blocks, "_block", [by, on])
    stats = running_stats(parsed, by, on)
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    writer = (stats.writeStream.outputMode("complete").option("checkpointLocation", ckpt).queryName(name)
              .foreachBatch(_write_epochs(stats, output_path)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stream_review_updates(spark: SparkSession, folder: str, by: str = "beer_id", on: str = "overall", *, output_path: str,
                          name: str = "review_updates", checkpoint: str | None = None, files_per_epoch: int | None = None,
                          least_rows: int = LEAST_ROWS, available_now: bool = True):
    """(query, table): the same statistics in update mode; ``table.read()`` gives them at any time.

    An epoch writes the rows of the keys that it changed and nothing else; the
    sink is a :class:`KeyedTable`, in which a replayed epoch changes nothing.
    """
    stats = running_stats(parse_review_block(review_blocks_stream(spark, folder, files_per_epoch), "_block", [by, on]), by, on)
    sink = KeyedTable(spark, output_path, by, stats.schema, least_rows)
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    writer = (stats.writeStream.outputMode("update").option("checkpointLocation", ckpt).queryName(name).foreachBatch(sink.merge))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(), sink


def table_stats_stream(spark: SparkSession, path: str, schema: str, by: str, on: str, name: str,
                       output_path: str, checkpoint: str | None = None) -> DataFrame:
    """Same running statistics over a parquet file read as a stream; runs to
    the end of the available data and returns the result table."""
    import os

    folder, name_glob = os.path.split(path.rstrip("/"))
    src = spark.readStream.schema(schema).option("pathGlobFilter", name_glob).parquet(folder)
    stats = running_stats(src, by, on)
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    q = (stats.writeStream.outputMode("complete").queryName(name).foreachBatch(_write_epochs(stats, output_path))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_epoch(spark, output_path)
