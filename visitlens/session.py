"""Session settings and shared-folder handling, in one place."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Streaming sessions of a hot visitor are merged before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every job relies on to a given session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables.

    In this order: ``spark.checkpoint.dir`` of the session, the checkpoint
    folder already set on the context, a sub-folder of the warehouse. Each is a
    store that the cluster shares; a machine's temporary folder is never used.
    """
    folder = (spark.conf.get("spark.checkpoint.dir", None)
              or spark.sparkContext.getCheckpointDir())
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_visitlens"
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a table folder no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_folder`` named, through Spark's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def enable_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
