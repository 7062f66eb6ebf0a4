"""Session settings used by tests, benchmarks and notebooks; a cluster brings its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "marketloom") -> SparkSession:
    """A local session: UTC, adaptive execution on, as many shuffle partitions as asked for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its rows and their parts fixed by a checkpoint in the folder that ``spark.checkpoint.dir`` names, or in a temporary one where all runs in one process."""
    sc = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="marketloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return df.checkpoint()
