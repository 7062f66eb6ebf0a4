"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: space and the five control characters 9 to 13.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Spark's setting that drops an execution's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and all runs in one process (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="marketloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame, tidy: bool = False) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage is cut, lost executors cost nothing.

    Spark drops the shuffle files of a finished job when the driver's garbage is collected; that is asked for here, as
    otherwise the disks would fill with the shuffles of all steps of an operator. The last step's frame is still held
    then, so its files go one step later; with ``tidy`` Spark drops them as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marketloom-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if tidy:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that ``written`` has returned, when nothing will read it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids count as remainder 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % divisor, F.lit(0))


def held_out(id_col: Column, divisor: int = 3) -> Column:
    return remainder(id_col, divisor) == 1


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def struct_of(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The schema of ``df`` without columns named like ``fields``, then ``fields``."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + list(fields))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*columns: Column) -> Column:
    """A row's number, made of its content: the same in every pass over a table, however the table is split or read."""
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the column ``name``, a number of each row that is the same in every pass.

    A row of a Parquet table is known by a hash of its file and its place in it, however the table is split into tasks.
    Anything but a plain table is written first.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        df = written(df)
    return df.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))
