"""Data-quality figures and their alerts. A report that cannot be made raises; it never reads as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import active, plausible_priced
from ..functions.rounding import percent_share
from .quantiles import group_quantiles

SLA_DAYS, DEFAULT_SLA = {"A": 4, "N": 4, "R": 6}, 5


def completeness(listings: DataFrame, next_year: int) -> DataFrame:
    rows = listings.where(active())
    missing = {"price": "price_eur", "model": "model_id", "year": "year", "mileage": "mileage_km", "region": "region", "fuel": "fuel", "power": "power_kw"}
    ready = plausible_priced(next_year) & F.col("model_id").isNotNull() & F.col("year").isNotNull() & F.col("mileage_km").isNotNull()
    out = rows.groupBy("source").agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(f"no_{k}") for k, c in missing.items()], F.count_if(ready).alias("ready"))
    return out.select("source", "total", *[percent_share(F.col(f"no_{k}"), F.col("total")).alias(f"{k}_missing_pct") for k in missing], percent_share(F.col("ready"), F.col("total")).alias("ready_pct"))


def health(price: Column, model: Column, region: Column) -> Column:
    return F.when((price >= 60) | (model >= 70), "drift").when((price >= 30) | (region >= 60) | (model >= 50), "warn").otherwise("ok")


def freshness(listings: DataFrame, as_of: Column) -> DataFrame:
    """Share of priced active adverts read within their source's target, and percentiles of the age in days."""
    rows = listings.where(active() & F.col("price_eur").isNotNull())
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("price_checked_at").cast("timestamp"))) / F.lit(86_400_000_000.0)
    table = F.create_map(*[F.lit(x) for kv in SLA_DAYS.items() for x in kv])
    rows = rows.withColumn("age", age).withColumn("sla", F.coalesce(F.try_element_at(table, F.col("source")), F.lit(DEFAULT_SLA)))
    counts = rows.groupBy("source").agg(F.count("*").alias("priced"), F.count_if(F.col("age") <= F.col("sla")).alias("fresh"), F.max("age").alias("oldest"))
    # a source holds a third of all rows or more
    ages = group_quantiles(rows, ["source"], "age", {"p50": 0.5, "p90": 0.9}).withColumnRenamed("source", "_source")
    out = counts.join(ages, F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.select("source", "priced", percent_share(F.col("fresh"), F.col("priced")).alias("fresh_pct"), *[(F.floor(F.col(c) * 100 + 0.5) / 100).alias(f"age_{c}") for c in ("p50", "p90", "oldest")])


def drift_alerts(completeness: DataFrame) -> DataFrame:
    """Sources that are not well, with the first reason that holds."""
    price, model, region = (F.col(f"{k}_missing_pct") for k in ("price", "model", "region"))
    reason = F.when(price >= 60, "price").when(model >= 70, "model").otherwise("several")
    return completeness.select("source", health(price, model, region).alias("health"), reason.alias("reason")).where("health <> 'ok'")


def country_alerts(listings: DataFrame) -> DataFrame:
    """Sources in whose active adverts the country is unknown: an error from 20 %, a warning from 2 %."""
    share = listings.where(active()).groupBy("source").agg(percent_share(F.count_if(F.col("country").isNull()), F.count("*")).alias("missing_pct"))
    return share.where("missing_pct >= 2").select("source", F.when(F.col("missing_pct") >= 20, "error").otherwise("warn").alias("level"), "missing_pct")


def dedup_health(listings: DataFrame) -> DataFrame:
    """One row on the state of the repost clusters.

    A cluster holds its clones; its size counts the head as well. Contradictions: clones of one cluster with differing
    VINs, or with differing models, years more than two apart or prices more than threefold; clones whose head is itself a
    clone. Differing values are found by minimum and maximum, so no group keeps its distinct values.
    """
    clones = listings.where("canonical_listing_id is not null")
    vin = F.when(F.length("vin") == 17, F.col("vin"))
    whole = listings.agg(F.count("*").alias("total"), F.count("canonical_listing_id").alias("clones"), F.count(vin).alias("with_vin"))
    apart = (
        (F.min("model_id") != F.max("model_id")) | F.coalesce(F.max("year") - F.min("year") > 2, F.lit(False))
        | F.coalesce(F.max("price_eur") > 3 * F.nullif(F.min("price_eur"), F.lit(0)), F.lit(False))
    )
    groups = clones.groupBy("canonical_listing_id").agg(F.count("*").alias("n"), (F.min(vin) != F.max(vin)).alias("vins"), apart.alias("apart"))
    clusters = groups.agg(F.max("n").alias("largest"), F.count_if("vins").alias("vin_conflicts"), F.count_if("apart").alias("incoherent"))
    across = listings.where(vin.isNotNull()).groupBy("vin").agg((F.min("source") != F.max("source")).alias("x")).agg(F.count_if("x").alias("cross_source_vins"))
    heads = clones.select(F.col("id").alias("_head"))
    chained = clones.join(heads, F.col("canonical_listing_id") == F.col("_head"), "left_semi").agg(F.count("*").alias("chained"))
    rows = whole
    for part in (clusters, across, chained):
        rows = rows.unionByName(part, allowMissingColumns=True)
    one = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    return one.select(
        "total", (F.col("total") - F.col("clones")).alias("canonical"), "clones", percent_share(F.col("clones"), F.col("total")).alias("repost_pct"), percent_share(F.col("with_vin"), F.col("total")).alias("vin_pct"),
        F.coalesce(F.col("largest") + 1, F.lit(0)).alias("max_cluster"), "cross_source_vins", "vin_conflicts", "incoherent", "chained",
    )


def cluster_alerts(report: DataFrame) -> DataFrame:
    """Contradictions of ``dedup_health`` that occur at all, each with its number."""
    kinds = report.select(F.expr("stack(3, 'vin_conflict', vin_conflicts, 'chained', chained, 'incoherent', incoherent) as (kind, n)"))
    return kinds.where("n > 0")
