"""Scratch locations for source/sink round trips.

Always under the cluster's shared ``spark.checkpoint.dir`` (never a
machine-local folder); a fresh session without that setting (tests) gets one
from :func:`revmine.session.ensure_checkpoint_dir`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from revmine.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A new folder for each call, so a later call never replaces files under an earlier result."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/revmine-io/{name}-{uuid.uuid4().hex}"
