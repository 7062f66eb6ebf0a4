"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Every row gets a digest of its normalised text and a run number. A run holds its distinct digests in order, each with
its smallest identifier and its row count; it is a sorted sequence of partitions, dealt out by ranges of (run, digest), so
that no run has to fit a task. Runs then merge in rounds, ``fan_in`` at a time: in round r the runs whose numbers agree
after dropping r digits of base ``fan_in`` are sorted into one, where equal digests are neighbours and the smallest
identifier stays. After the last round one entry per digest is left. The entries of groups with more than one row then travel the same
tree downwards, so that a digest held by a third of all rows reaches them through its runs, a few hundred rows at a
time, and never through one task.

A digest entry is the SHA-256, a second 64-bit hash and the byte length: rows merge only where all three agree, at
every level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE_RUN, written

KEY = ["_sha", "_check", "_len"]


def normalised(text: Column) -> Column:
    """Null as empty; every run of white space as one space. Nothing is trimmed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per input row: _id and the digest entry."""
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id",
        F.unhex(F.sha2("_text", 256)).alias("_sha"),
        F.xxhash64("_text").alias("_check"),
        F.octet_length("_text").alias("_len"),
    )


def sorted_runs(entries: DataFrame) -> DataFrame:
    """The entries (_run, digest, _min, _n) as sorted runs: ranges of (run, digest) in order, in order within."""
    return entries.repartitionByRange("_run", *KEY).sortWithinPartitions("_run", *KEY, F.col("_min").asc_nulls_last())


def merged(runs: DataFrame) -> DataFrame:
    """Of equal digests in a sorted run, which are neighbours, the one with the smallest identifier, with the rows of all."""
    equal = W.partitionBy("_run", *KEY).orderBy(F.col("_min").asc_nulls_last())
    return (
        runs.withColumn("_k", F.row_number().over(equal)).withColumn("_all", F.sum("_n").over(equal.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .where("_k = 1").select("_run", *KEY, "_min", F.col("_all").alias("_n"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, run_rows: int = 250_000) -> DataFrame:
    """Per input row: id, keep_id (smallest id among equal texts), group_size, kept, text_sha256.

    Null text equals empty text. A null id never stays if its group has another id; a group of null ids only has a
    null keep_id and none kept. Rows repeated with one id and text count each in group_size and share kept. An empty
    table gives an empty result. Other columns of ``docs`` are not touched; join the result on the id.
    ``run_rows`` sets how many rows a run holds on average, ``fan_in`` how many runs merge in a round.
    """
    base = written(digests(docs, id_col, text_col))
    rounds = max(1, math.ceil(math.log(max(base.count(), 1) / run_rows + 1, fan_in)))
    base = base.withColumn("_run", F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(fan_in**rounds)))

    levels = [sorted_runs(base.groupBy("_run", *KEY).agg(F.min("_id").alias("_min"), F.count("*").alias("_n")))]
    for _ in range(rounds):
        levels.append(merged(sorted_runs(levels[-1].withColumn("_run", F.expr(f"_run div {fan_in}")))))

    known = levels[-1].where(F.col("_n") > 1)
    for level in reversed(levels[:-1]):
        below = level.select("_run", *KEY).withColumn("_up", F.expr(f"_run div {fan_in}"))
        above = known.select(F.col("_run").alias("_up"), *KEY, "_min", "_n")
        known = below.join(above, ["_up", *KEY]).select("_run", *KEY, "_min", "_n")

    joined = base.join(known, ["_run", *KEY], "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_min"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_id") == keep, F.lit(False)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
