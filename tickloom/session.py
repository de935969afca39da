"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even when only the driver's ``sys.path`` knows it."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *have])
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage into the folder that the cluster names; only a session that names none, as in tests, gets a local one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "tickloom-checkpoints"))
    return df.checkpoint()


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_importable(spark)
