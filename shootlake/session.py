"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "shootlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # pixel stages do much work per byte: let small shuffles keep their parallelism
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        # the JVM never compiles a method above 8000 bytes; such stages run faster split up
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only for a local session without any."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder
