"""Adverts, photos, watches and users derived from the star-schema tables, and the same as SQL for the comparing engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2025-11-30 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
NEXT_YEAR = 2026


def as_of():  # noqa: ANN201
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advert per line item; nulls are made on purpose where the operators must see them."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    df = df.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    c, years = F.col, F.expr("interval 24 years")
    first_seen = c("o_orderdate") + years
    has_price = ~((c("l_linenumber") == 7) & (c("l_discount") < 0.02))
    gone = (c("l_linestatus") == "F") & (c("l_shipdate") > c("o_orderdate"))
    return df.select(
        (((c("l_orderkey") * 10 + c("l_linenumber")) * 1000000 + c("l_partkey")) * 100000 + c("l_suppkey")).alias("id"),
        c("l_returnflag").alias("source"),
        F.concat(c("l_orderkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string"), F.lit("-"), c("l_partkey").cast("string")).alias("source_id"),
        F.substring("p_brand", 7, 4).cast("int").alias("model_id"),
        c("p_brand").alias("make"), c("p_type").alias("model"),
        F.when(has_price, c("l_extendedprice")).alias("price_eur"),
        (F.floor("l_quantity").cast("int") + 1978).alias("year"),
        F.when(~((c("l_tax") == 0) & (c("l_linenumber") == 6)), F.floor(c("l_extendedprice") * 2)).alias("mileage_km"),
        c("n_name").alias("region"),
        F.when(c("r_name").isin("EUROPE", "AMERICA", "AFRICA"), "SK").when(c("r_name") == "ASIA", None).otherwise("CZ").alias("country"),
        first_seen.alias("first_seen_at"),
        F.when(gone, c("l_shipdate") + years).alias("removed_at"),
        F.lit(None).cast("timestamp_ntz").alias("sold_at"),
        F.when(c("l_tax") < 0.08, first_seen + F.expr("interval 1 day")).alias("first_seen_alive_at"),
        F.when(c("l_linenumber") != 5, first_seen + F.expr("interval 40 days")).alias("price_checked_at"),
        F.lit(None).cast("long").alias("canonical_listing_id"),
        (c("l_discount") < 0.095).alias("is_vehicle"),
        (c("l_tax") >= 0.03).alias("sells"),
        (c("l_discount") >= 0.09).alias("is_featured"),
        F.when(c("p_size") % 7 != 0, c("p_size") * 4 + 40).alias("power_kw"),
        F.when(c("l_linenumber") > 1, c("l_linenumber")).otherwise(0).alias("photo_count"),
        F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "private").when(c("o_orderpriority") != "4-NOT SPECIFIED", "dealer").alias("seller_type"),
        c("s_name").alias("seller"),
        F.when(c("l_partkey") % 3 == 0, "diesel").when(c("l_partkey") % 3 == 1, "gasoline").alias("fuel"),
        F.when(c("l_suppkey") % 2 == 0, "manual").otherwise("automatic").alias("gearbox"),
        F.when(c("l_suppkey") % 4 == 0, F.concat(F.lit("VN"), F.lpad(c("l_partkey").cast("string"), 9, "0"), F.lpad((c("l_orderkey") % 7).cast("string"), 6, "0"))).alias("vin"),
        F.concat(c("p_brand"), F.lit(" "), c("p_type"), F.lit(" "), (F.floor("l_quantity").cast("int") + 1978).cast("string"), F.lit(", "), F.floor("l_extendedprice").cast("string"), F.lit(" €, "), (F.floor(c("l_extendedprice") / 10) * 20).cast("string"), F.lit(" km, diesel")).alias("raw_title"),
    )


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo rows: position 1 is the hero."""
    rows = listings(spark, sf_dir).where("photo_count > 0").select("id", F.explode(F.sequence(F.lit(1), F.least("photo_count", F.lit(3)))).alias("position"))
    return rows.select(F.col("id").alias("listing_id"), "position", F.concat(F.lit("https://img.example.com/p/"), F.col("id").cast("string"), F.lit("-"), F.col("position").cast("string"), F.lit(".jpg")).alias("url"))


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved searches, one per customer; criteria are null for some."""
    c = F.col
    return table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("watch_id"), (c("c_custkey") % 25).cast("int").alias("model_id"),
        F.when(c("c_custkey") % 3 != 0, F.floor(c("c_acctbal").cast("double")) + 20000).alias("price_max"),
        F.when(c("c_custkey") % 4 != 0, (c("c_custkey") % 30 + 1985).cast("int")).alias("year_min"),
        F.when(c("c_mktsegment") == "AUTOMOBILE", 150000).alias("mileage_max"),
        (c("c_custkey") % 11 != 0).alias("enabled"),
    )


LISTINGS_SQL = """listings as (
  select ((l_orderkey*10 + l_linenumber)*1000000 + l_partkey)*100000 + l_suppkey as id, l_returnflag as source,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey as source_id, substr(p_brand, 7)::int as model_id, p_brand as make, p_type as model,
    case when l_linenumber = 7 and l_discount < 0.02 then null else l_extendedprice end as price_eur,
    1978 + floor(l_quantity)::int as year,
    case when l_tax = 0 and l_linenumber = 6 then null else floor(l_extendedprice*2)::bigint end as mileage_km,
    n_name as region, case when r_name in ('EUROPE','AMERICA','AFRICA') then 'SK' when r_name = 'ASIA' then null else 'CZ' end as country,
    o_orderdate + interval 24 years as first_seen_at,
    case when l_linestatus = 'F' and l_shipdate > o_orderdate then l_shipdate + interval 24 years end as removed_at,
    null::timestamp as sold_at, case when l_tax < 0.08 then o_orderdate + interval 24 years + interval 1 day end as first_seen_alive_at,
    case when l_linenumber <> 5 then o_orderdate + interval 24 years + interval 40 days end as price_checked_at,
    null::bigint as canonical_listing_id, l_discount < 0.095 as is_vehicle, l_discount >= 0.09 as is_featured,
    case when p_size % 7 <> 0 then 40 + 4*p_size end as power_kw, case when l_linenumber > 1 then l_linenumber else 0 end as photo_count,
    case when o_orderpriority in ('1-URGENT','2-HIGH') then 'private' when o_orderpriority <> '4-NOT SPECIFIED' then 'dealer' end as seller_type,
    s_name as seller, case l_partkey % 3 when 0 then 'diesel' when 1 then 'gasoline' end as fuel, case when l_suppkey % 2 = 0 then 'manual' else 'automatic' end as gearbox,
    case when l_suppkey % 4 = 0 then 'VN' || lpad(l_partkey::varchar, 9, '0') || lpad((l_orderkey % 7)::varchar, 6, '0') end as vin,
    p_brand || ' ' || p_type || ' ' || (1978 + floor(l_quantity)::int) || ', ' || floor(l_extendedprice)::bigint || ' €, ' || (floor(l_extendedprice/10)*20)::bigint || ' km, diesel' as raw_title
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

PHOTOS_SQL = """photos as (select id as listing_id, k as position, 'https://img.example.com/p/' || id || '-' || k || '.jpg' as url
  from listings, range(1, 4) r(k) where photo_count > 0 and k <= photo_count)"""

WATCHES_SQL = """watches as (select c_custkey as watch_id, (c_custkey % 25)::int as model_id,
  case when c_custkey % 3 <> 0 then floor(c_acctbal)::bigint + 20000 end as price_max, case when c_custkey % 4 <> 0 then (1985 + c_custkey % 30)::int end as year_min,
  case when c_mktsegment = 'AUTOMOBILE' then 150000 end as mileage_max, c_custkey % 11 <> 0 as enabled from customer)"""

# the named row sets, as SQL
PLAUSIBLE_SQL = "(price_eur is null or price_eur between 100 and 500000) and (mileage_km is null or mileage_km between 0 and 1000000) and (year is null or year between 1980 and 2026)"
PRICED_SQL = f"(price_eur is not null and {PLAUSIBLE_SQL})"
REFERENCE_SQL = f"(is_vehicle and country = 'SK' and {PRICED_SQL})"
ACTIVE_SQL = "(canonical_listing_id is null and sold_at is null and removed_at is null)"
YEAR_BUCKET_SQL = "case when year is null then 'unknown' when year >= 2020 then '2020+' when year >= 2015 then '2015-19' when year >= 2010 then '2010-14' else '<2010' end"
KM_BUCKET_SQL = "case when mileage_km is null or mileage_km < 0 then 'unknown' when mileage_km < 50000 then '0-50k' when mileage_km < 100000 then '50-100k' when mileage_km < 150000 then '100-150k' else '150k+' end"
