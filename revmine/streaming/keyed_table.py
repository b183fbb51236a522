"""A table with one row for each key, kept by the changed rows of each epoch.

Layout below a folder: ``delta/epoch=<id>`` holds the rows that an epoch
changed, ``base/upto=<id>`` the whole table as of that epoch.  A folder counts
once Spark has marked it complete, so a failure between two files leaves the
table as it was.  An epoch that is replayed rewrites its own folder, or, if a base
holds it already, is not read at all: nothing changes either way.  A new base
is written when the deltas since the last one have as many rows as it, so all
bytes written stay in proportion to the changed rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: deltas with fewer rows than this are never merged into a new base
LEAST_ROWS = 10_000


class KeyedTable:
    """Rows by ``key`` (one or more columns) below ``path``; ``schema`` of a row as a DDL string or type."""

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str], schema, least_rows: int = LEAST_ROWS):
        self.spark, self.path, self.least_rows = spark, path.rstrip("/"), least_rows
        self.key = [key] if isinstance(key, str) else list(key)
        self.schema = spark.createDataFrame([], schema).schema

    # --- folders -------------------------------------------------------------

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str, name: str) -> list[int]:
        """Numbers of the complete folders of a kind, ascending."""
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        top = path(f"{self.path}/{kind}")
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith(f"{name}=")]
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(path(p, "_SUCCESS")))

    def bases(self) -> list[int]:
        return self._numbers("base", "upto")

    def deltas(self) -> list[int]:
        """Epochs that the newest base does not hold."""
        base = (self.bases() or [-1])[-1]
        return [e for e in self._numbers("delta", "epoch") if e > base]

    # --- rows ----------------------------------------------------------------

    def _part(self, kind: str, name: str, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}/{name}={number}").withColumn("_epoch", F.lit(number).cast("bigint"))

    def read(self, upto: int | None = None) -> DataFrame:
        """The table now, or as of an epoch that the newest base does not go beyond: each key's row of its last epoch."""
        base = self.bases()
        parts = [self._part("base", "upto", base[-1])] if base else []
        parts += [self._part("delta", "epoch", e) for e in self.deltas() if upto is None or e <= upto]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        cols = [c for c in self.schema.fieldNames() if c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*cols), "_epoch").alias("_last"))
        return last.select(*[F.col(c) if c in self.key else F.col(f"_last.{c}").alias(c) for c in self.schema.fieldNames()])

    def merge(self, changed: DataFrame, epoch: int) -> None:
        """Rows that an epoch changed, each key once; merging an epoch again changes nothing."""
        base = self.bases()
        if base and epoch <= base[-1]:
            return
        changed.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/delta/epoch={epoch}")
        held = self._part("base", "upto", base[-1]).count() if base else 0  # from the files' footers
        if sum(self._part("delta", "epoch", e).count() for e in self.deltas()) >= max(self.least_rows, held):
            self.compact()

    def compact(self) -> None:
        """Write the table as a new base; what the base before the last one was made of goes."""
        deltas, old = self.deltas(), self.bases()
        if not deltas:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base/upto={deltas[-1]}")
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        for number in old[:-1]:  # readers of the last base may still be at work
            fs.delete(path(f"{self.path}/base/upto={number}"), True)
        if old:
            for epoch in self._numbers("delta", "epoch"):
                if epoch <= old[-1]:
                    fs.delete(path(f"{self.path}/delta/epoch={epoch}"), True)
