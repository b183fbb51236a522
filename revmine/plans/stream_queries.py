"""Streaming queries: running per-key statistics (Structured Streaming).

Each run uses fresh checkpoint and result folders under ``spark.checkpoint.dir``,
drains the available input (``availableNow``) and returns the last epoch's
table as a batch DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revmine.plans import catalog as C
from revmine.plans.io_paths import scratch_path
from revmine.plans.registry import register
from revmine.session import ensure_checkpoint_dir
from revmine.sources import reviews as RV
from revmine.streaming import review_stats as RS


def _run_id(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


@register("stream_review_stats", """
SELECT source, count(*) AS review_count, round(avg(CAST(n_chars AS DOUBLE)), 6) AS avg_n_chars
FROM documents WHERE source IS NOT NULL GROUP BY source""")
def q_stream_review_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Stream of review records (text files) -> running count and mean per source."""
    d = C.table(spark, sf, "documents")
    block = RV.render_review_block({"source": F.col("source"), "n_chars": F.col("n_chars")})
    folder = scratch_path(spark, sf, "stream_blocks")
    d.select(F.concat(block, F.lit("\n")).alias("value")).write.mode("overwrite").text(folder)
    name = _run_id("review_stats")
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    result = scratch_path(spark, sf, "review_stats")
    q = RS.stream_review_stats(spark, folder, by="source", on="n_chars", output_path=result, name=name, checkpoint=ckpt)
    q.awaitTermination()
    out = RS.latest_epoch(spark, result)
    return out.select("source", "review_count", F.round("avg_n_chars", 6).alias("avg_n_chars"))


@register("stream_review_updates", """
SELECT source, count(*) AS review_count, round(avg(CAST(n_chars AS DOUBLE)), 6) AS avg_n_chars
FROM documents WHERE source IS NOT NULL GROUP BY source""")
def q_stream_review_updates(spark: SparkSession, sf: str) -> DataFrame:
    """The same in update mode: a file an epoch, changed sources only merged into a keyed table."""
    d = C.table(spark, sf, "documents")
    block = RV.render_review_block({"source": F.col("source"), "n_chars": F.col("n_chars")})
    folder = scratch_path(spark, sf, "stream_blocks")
    d.repartition(4).select(F.concat(block, F.lit("\n")).alias("value")).write.mode("overwrite").text(folder)
    name = _run_id("review_updates")
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    q, sink = RS.stream_review_updates(spark, folder, by="source", on="n_chars", output_path=scratch_path(spark, sf, "review_updates"),
                                       name=name, checkpoint=ckpt, files_per_epoch=1)
    q.awaitTermination()
    return sink.read().select("source", "review_count", F.round("avg_n_chars", 6).alias("avg_n_chars"))


@register("running_stats", """
SELECT event_type, count(*) AS review_count, round(avg(value), 6) AS avg_value FROM events
WHERE event_type IS NOT NULL GROUP BY event_type""")
def q_running_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + A2 as a streaming aggregate over the events table read as a stream."""
    name = _run_id("event_stats")
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    schema = C.table(spark, sf, "events").schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " ")
    out = RS.table_stats_stream(spark, f"{sf.rstrip('/')}/events.parquet", schema, "event_type", "value", name,
                                scratch_path(spark, sf, "event_stats"), ckpt)
    return out.select("event_type", "review_count", F.round("avg_value", 6).alias("avg_value"))
