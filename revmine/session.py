"""Spark session helpers.

The library itself never creates or configures a session: every operator takes
DataFrames and returns lazy DataFrames.  These helpers exist for tests, the
bench and the driver entry points, and for the one piece of session state the
library reads: the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for correctness (UTC timestamps) or for the plans we
# want (AQE re-plans joins from runtime sizes and splits skewed partitions).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "revmine", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (not used by the library)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("REVMINE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _path(p: str | None) -> str:
    p = p or ""
    for scheme in ("file://", "file:"):
        if p.startswith(scheme):
            return p[len(scheme):]
    return p


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this setting names a shared, fault-tolerant folder and we use
    it as given (also making the context checkpoint there).  Only when it is
    unset (a bare local session) do we pick a scratch folder, set on the
    context so every later caller finds it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    in_use = sc.getCheckpointDir()
    if configured:
        # setCheckpointDir adds a unique sub-folder and qualifies local paths
        # with "file:", so compare scheme-less prefixes
        if not _path(in_use).startswith(_path(configured).rstrip("/")):
            sc.setCheckpointDir(configured)
        return configured
    if in_use:
        return in_use
    # unset: a scratch folder does only where all tasks run on this machine
    # (spark.checkpoint.dir is a core setting and cannot be changed at run time)
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="revmine-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used after expensive, reused intermediate tables (token counts) so a lost
    executor recomputes from the checkpoint files instead of re-tokenising the
    whole corpus.  Never a local checkpoint: those die with the executor.  The
    files stay until the folder is cleared, or go with the frame when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
