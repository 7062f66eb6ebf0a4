"""Weekly cohort snapshots and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import mileage_bucket, year_bucket
from ..functions.predicates import home_market, plausible_priced
from ..functions.rounding import half_up, half_up_to


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(86_400_000_000.0)


def weekly_snapshot(listings: DataFrame, week_start: Column, next_year: int, least: int = 3, sold_least: int = 5) -> DataFrame:
    """Per model, year bucket and mileage bucket: exact price statistics of active adverts, sales of the week and their
    median lifetime. One aggregation; lists of prices are never gathered. Means are summed in whole cents, so that no
    order of rows changes their rounding."""
    rows = listings.where(
        F.col("model_id").isNotNull() & F.col("canonical_listing_id").isNull() & F.col("is_vehicle") & home_market() & F.col("year").isNotNull() & (F.col("mileage_km") >= 0)
    )
    live = F.col("sold_at").isNull() & F.col("removed_at").isNull() & plausible_priced(next_year)
    price = F.when(live & (F.col("price_eur") > 0), F.col("price_eur"))
    sold = F.coalesce(F.col("sold_at") >= week_start, F.lit(False))
    life = days_between(F.coalesce("sold_at", "removed_at"), F.col("first_seen_alive_at"))
    life = F.when(sold & (life >= 0), life)
    out = rows.groupBy("model_id", year_bucket(F.col("year")).alias("year_bucket"), mileage_bucket(F.col("mileage_km")).alias("mileage_bucket")).agg(
        F.count(price).alias("count_active"), (F.sum(half_up(price * 100)) / F.count(price)).alias("cents"), F.percentile(price, 0.5).alias("p50"), F.percentile(price, 0.25).alias("p25"), F.percentile(price, 0.75).alias("p75"),
        F.count_if(sold).alias("count_sold"), F.count(life).alias("lives"), F.percentile(life, 0.5).alias("life"),
    )
    out = out.where(F.col("count_active") >= least)
    return out.select(
        "model_id", "year_bucket", "mileage_bucket", "count_active", (half_up(F.col("cents")) / 100).alias("avg_price_eur"), half_up(F.col("p50")).alias("median_price_eur"),
        half_up(F.col("p25")).alias("p25_price_eur"), half_up(F.col("p75")).alias("p75_price_eur"), "count_sold",
        F.when(F.col("lives") >= sold_least, half_up_to(F.col("life"), 2)).alias("days_to_sell"),
    )


def weighted_median(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of medians weighted by cohort size; sizes of cohorts without a median count in the weight."""
    total = F.sum(F.col("median_price_eur") * F.col("count_active")) / F.nullif(F.sum("count_active"), F.lit(0))
    return snapshots.groupBy(*keys).agg(total.alias("weighted_median"), F.sum("count_active").alias("active"))


def change(now: Column, before: Column, dead_band: float = 0.5) -> Column:
    """Week-over-week percentage; 0 within the dead band, null without a base."""
    pct = F.when(before != 0, (now - before) / before * 100)
    return F.when(F.abs(pct) < dead_band, 0.0).otherwise(pct)


COHORT = ["model_id", "year_bucket", "mileage_bucket"]


def publish(published: DataFrame, computed: DataFrame, week: Column) -> DataFrame:
    """The next version of the published snapshots (with ``captured_on``): this week's cohorts are those computed now, so
    what no longer qualifies goes; other weeks cannot be measured again and stay. Repeating it changes nothing. As a
    table by ``captured_on``, only this week's part is written anew."""
    return published.where(F.col("captured_on") != week).unionByName(computed.withColumn("captured_on", week))


def retired(published: DataFrame, computed: DataFrame, week: Column) -> DataFrame:
    """This week's published cohorts that are no longer computed."""
    return published.where(F.col("captured_on") == week).join(computed.select(*COHORT), COHORT, "left_anti")


def publish_table(computed: DataFrame, path: str, week: Column) -> None:
    """Writes this week's cohorts into the table at ``path``, kept in parts by ``captured_on``; parts of other weeks are not touched.

    The week's part is replaced as a whole by dynamic partition overwrite: rows go to a staging folder first and take the
    old part's place when all tasks are done, so a job that fails leaves the table as it was, and one that runs again
    changes nothing. A week without cohorts gets no part, and the part it had is removed.
    """
    spark = computed.sparkSession
    rows = computed.withColumn("captured_on", week.cast("date"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("captured_on").parquet(path)
    if rows.isEmpty():
        day = spark.range(1).select(F.date_format(week.cast("date"), "yyyy-MM-dd")).first()[0]
        part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/captured_on={day}")
        part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(part, True)
