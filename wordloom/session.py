"""Spark settings the library is tuned for, and the shared folder for tables it writes along the way."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

RECOMMENDED = {
    # Rebalanced writes and skewed joins are split at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hash lists of a request reach the row-group filter as values, not only as a min/max range.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended run-time settings to a session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine that names none gets a temporary folder; on a cluster that is an error, as
    executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return os.path.join(base.rstrip("/"), f"wordloom-{uuid.uuid4().hex}")
