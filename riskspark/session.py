"""Spark session settings for the credit-risk operators.

Everything in the library runs on whatever session the caller hands in; this
module only offers a builder with settings that suit the workload (many small
grouped aggregates over one large predictions table) and a helper that finds a
shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "riskspark") -> SparkSession:
    """Create (or reuse) a session with AQE, UTC time and the UI off.

    On a cluster ``master`` stays ``None`` and the submit command decides; the
    shuffle partition count is the cluster's own unless given (AQE merges small
    partitions and splits skewed join partitions, but adds none).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # joins against per-group statistics tables become broadcast joins only
        # when the measured shuffle output is below this size; otherwise they
        # stay sort-merge joins
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RISKSPARK_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder, which is used
    as is; without one this raises, since executors would not see one another's
    files. Local runs (tests, bench) get a fresh scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="riskspark-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path
