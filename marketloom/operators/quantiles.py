"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def group_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each of ``shares``: the interpolated quantile of the group's non-null values.

    The built-in percentile keeps a group's distinct values in one task, however many they are. Here the rows are placed in
    the order of group and value, in as many ranges as they need, a group's first place and size are combined counts, and
    only the rows at the places that a quantile asks for are looked up. A group without values has no row; null keys are a
    group like others.
    """
    placed = numbered(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value)), *keys, value, name="_place")
    groups = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))

    def asked(share: float) -> list:
        at = (F.col("_n") - 1) * F.lit(share)
        return [(F.col("_first") + F.floor(at)).alias("low"), (F.col("_first") + F.ceil(at)).alias("high"), (at - F.floor(at)).alias("part")]

    wanted = groups.select(*keys, F.posexplode(F.array(*[F.struct(*asked(s)) for s in shares.values()])).alias("_k", "_w")).select(*keys, "_k", "_w.*")
    at = lambda name: placed.select(F.col("_place").alias(name), F.col(value).alias(f"_{name}"))
    found = wanted.join(at("low"), "low").join(at("high"), "high").withColumn("_q", F.col("_low") + F.col("part") * (F.col("_high") - F.col("_low")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(name) for k, name in enumerate(shares)])
