"""Queries over adverts: scans, predicates, joins, aggregations, windows, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import predicates as P
from ..functions.buckets import mileage_bucket, year_bucket
from ..functions.rounding import half_up
from ..operators import search as S
from ..operators.quality import SLA_DAYS  # noqa: F401  (re-exported for callers of the report)
from ..operators.quantiles import group_quantiles
from . import domain as D
from .registry import query

L = f"with {D.LISTINGS_SQL}"
LP = f"with {D.LISTINGS_SQL}, {D.PHOTOS_SQL}"
WEEK = "2025-05-26 00:00:00"
R2 = lambda c: F.round(c, 2)


@query("scan_parquet", "select * from region")
def scan_parquet(spark, d):  # noqa: ANN001, ANN201
    return D.table(spark, d, "region")


@query("price_history", f"{L} select id, price_eur from listings where source = 'A' and model_id = 3 and price_eur is not null")
def price_history(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).where("source = 'A' and model_id = 3 and price_eur is not null").select("id", "price_eur")


@query("keyset_page", f"{L} select id, price_eur from listings where id > 10000000000000 order by id limit 100")
def keyset_page(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).where("id > 10000000000000").orderBy("id").limit(100).select("id", "price_eur")


@query("modulo_slice", "select c_custkey, c_acctbal from customer where c_custkey % 7 = 3")
def modulo_slice(spark, d):  # noqa: ANN001, ANN201
    return D.table(spark, d, "customer").where(F.pmod("c_custkey", F.lit(7)) == 3).select("c_custkey", "c_acctbal")


def _predicate(name, condition, sql):  # noqa: ANN001, ANN202
    @query(name, f"{L} select id, source from listings where {sql}")
    def run(spark, d):  # noqa: ANN001, ANN202
        return D.listings(spark, d).where(condition()).select("id", "source")


_predicate("plausible_filter", lambda: P.plausible(D.NEXT_YEAR), D.PLAUSIBLE_SQL)
_predicate("plausible_priced", lambda: P.plausible_priced(D.NEXT_YEAR), D.PRICED_SQL)
_predicate("home_market", P.home_market, "country = 'SK'")
_predicate("domestic_only", P.domestic_only, "country is null or country = 'SK'")
_predicate("market_reference", lambda: P.market_reference(D.NEXT_YEAR), D.REFERENCE_SQL)
_predicate("market_reference_nullable", lambda: P.market_reference_nullable(D.NEXT_YEAR), f"is_vehicle and country = 'SK' and {D.PLAUSIBLE_SQL}")
_predicate("active_set", P.active, D.ACTIVE_SQL)
_predicate(
    "search_filters",
    lambda: P.all_of(S.Filters(sources=["A", "R"], price=(5000, 60000), year=(1990, None), mileage=(None, 100000), fuels=["diesel"], gearboxes=["manual"], with_photo=True).conditions()),
    "removed_at is null and source in ('A','R') and price_eur between 5000 and 60000 and year >= 1990 and mileage_km <= 100000 and fuel = 'diesel' and gearbox = 'manual' and photo_count > 0",
)
_predicate("text_search", lambda: P.all_of(S.Filters(text=" eCono ").conditions()), "removed_at is null and (make ilike '%eCono%' or model ilike '%eCono%')")
_predicate("null_safe_diff", lambda: ~F.col("country").eqNullSafe(F.lit("SK")), "country is distinct from 'SK'")

PLACES = "(select c_custkey, case c_custkey % 10 when 0 then 'Bratislava' when 1 then 'BA - Ružinov' when 2 then 'Trnava a okolie' when 3 then 'trenčín' when 4 then 'Trencin' when 5 then 'Žilina' when 6 then 'žilinský kraj' when 7 then 'Banská Bystrica' when 8 then 'Brno' end as place from customer)"


@query("region_ilike", f"select place, c_custkey from {PLACES} where (place ilike '%bratisl%' or place ilike 'BA %' or place ilike 'BA-%' or place ilike '%žilin%')")
def region_ilike(spark, d):  # noqa: ANN001, ANN201
    names = ["Bratislava", "BA - Ružinov", "Trnava a okolie", "trenčín", "Trencin", "Žilina", "žilinský kraj", "Banská Bystrica", "Brno", None]
    place = F.get(F.array(*[F.lit(n).cast("string") for n in names]), (F.col("c_custkey") % 10).cast("int"))
    rows = D.table(spark, d, "customer").select("c_custkey", place.alias("place"))
    return rows.where(P.in_regions("place", ["Bratislavský", "Žilinský", "nowhere"]))


@query("enum_threshold", f"{L}, c as (select id, case when photo_count >= 6 then 'high' when photo_count >= 3 then 'medium' else 'low' end as confidence from listings) select * from c where confidence in ('medium','high')")
def enum_threshold(spark, d):  # noqa: ANN001, ANN201
    n = F.col("photo_count")
    rows = D.listings(spark, d).select("id", F.when(n >= 6, "high").when(n >= 3, "medium").otherwise("low").alias("confidence"))
    return rows.where(P.at_least("confidence", "medium"))


@query("bucketize", f"{L} select {D.YEAR_BUCKET_SQL} as yb, {D.KM_BUCKET_SQL} as kb, count(*) as n from listings group by all")
def bucketize(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).groupBy(year_bucket(F.col("year")).alias("yb"), mileage_bucket(F.col("mileage_km")).alias("kb")).agg(F.count("*").alias("n"))


@query("null_guards", f"{L} select id, coalesce(power_kw, 0) as power, nullif(photo_count, 0) as photos, greatest(price_eur, 1000.0) as g, least(mileage_km, 50000) as l from listings")
def null_guards(spark, d):  # noqa: ANN001, ANN201
    rows = D.listings(spark, d)
    return rows.select("id", F.coalesce("power_kw", F.lit(0)).alias("power"), F.nullif("photo_count", F.lit(0)).alias("photos"), F.greatest("price_eur", F.lit(1000.0)).alias("g"), F.least("mileage_km", F.lit(50000)).alias("l"))


@query("join_inner", "select p_brand, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join part on l_partkey = p_partkey group by p_brand")
def join_inner(spark, d):  # noqa: ANN001, ANN201
    j = D.table(spark, d, "lineitem").join(D.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.count("*").alias("n"), R2(F.sum("l_extendedprice")).alias("total"))


@query("join_left_chain", f"{LP} select l.id, l.make, p.url, w.c_name from listings l left join photos p on p.listing_id = l.id and p.position = 2 left join customer w on w.c_custkey = l.id % 2000")
def join_left_chain(spark, d):  # noqa: ANN001, ANN201
    second = D.photos(spark, d).where("position = 2")
    rows = D.listings(spark, d).join(second, F.col("id") == F.col("listing_id"), "left")
    return rows.join(D.table(spark, d, "customer"), F.col("c_custkey") == F.pmod("id", F.lit(2000)), "left").select("id", "make", "url", "c_name")


@query("hero_photo", f"{LP} select l.id, p.url from listings l left join photos p on p.listing_id = l.id and p.position = 1")
def hero_photo(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).join(D.photos(spark, d).where("position = 1"), F.col("id") == F.col("listing_id"), "left").select("id", "url")


@query("join_semi", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def join_semi(spark, d):  # noqa: ANN001, ANN201
    return D.table(spark, d, "customer").join(D.table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_anti", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_anti(spark, d):  # noqa: ANN001, ANN201
    return D.table(spark, d, "customer").join(D.table(spark, d, "orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("not_in_anti", f"{L} select id from listings where vin is not null and vin not in (select vin from listings where vin is not null and source = 'R')")
def not_in_anti(spark, d):  # noqa: ANN001, ANN201
    rows = D.listings(spark, d).where("vin is not null")
    return rows.join(rows.where("source = 'R'").select("vin").distinct(), "vin", "left_anti").select("id")


@query("join_self", "select a.o_orderkey, b.o_custkey as head_customer from orders a join orders b on b.o_orderkey = a.o_orderkey - a.o_orderkey % 4")
def join_self(spark, d):  # noqa: ANN001, ANN201
    """Every row with its head: the first of four neighbours."""
    rows = D.table(spark, d, "orders")
    heads = rows.select(F.col("o_orderkey").alias("head"), F.col("o_custkey").alias("head_customer"))
    return rows.join(heads, F.col("head") == F.col("o_orderkey") - F.col("o_orderkey") % 4).select("o_orderkey", "head_customer")


@query("first_child", f"{LP} select listing_id, min_by(url, position) as url from photos group by listing_id")
def first_child(spark, d):  # noqa: ANN001, ANN201
    return D.photos(spark, d).groupBy("listing_id").agg(F.min_by("url", "position").alias("url"))


@query("scalar_report", f"{L} select (select count(*) from listings where {D.ACTIVE_SQL}) as active, (select count(distinct vin) from listings) as vins, (select max(photo_count) from listings where country is null) as photos")
def scalar_report(spark, d):  # noqa: ANN001, ANN201
    rows = D.listings(spark, d)
    return rows.agg(F.count_if(P.active()).alias("active"), F.count_distinct("vin").alias("vins"), F.max(F.when(F.col("country").isNull(), F.col("photo_count"))).alias("photos"))


@query("latest_period", "with w as (select date_trunc('week', ts) as wk, value from events), p as (select distinct wk from w order by wk desc limit 2) select strftime(wk, '%Y-%m-%d') as week, count(*) as n from w where wk in (select wk from p) group by wk")
def latest_period(spark, d):  # noqa: ANN001, ANN201
    weeks = D.table(spark, d, "events").groupBy(F.date_trunc("week", "ts").alias("wk")).agg(F.count("*").alias("n"))
    return weeks.orderBy(F.desc("wk")).limit(2).select(F.date_format("wk", "yyyy-MM-dd").alias("week"), "n")


SINCE, UNTIL = "2025-07-15 00:00:00", "2025-07-22 00:00:00"
MATCH_SQL = f"""with {D.LISTINGS_SQL}, {D.WATCHES_SQL}, m as (select watch_id, id, price_eur, l.first_seen_at from watches w join listings l on w.model_id = l.model_id
  where enabled and removed_at is null and canonical_listing_id is null and first_seen_at between timestamp '{SINCE}' and timestamp '{UNTIL}'
  and (price_max is null or price_eur <= price_max) and (year_min is null or year >= year_min) and (mileage_max is null or mileage_km <= mileage_max))"""


def _matches(spark, d):  # noqa: ANN001, ANN202
    since, until = (F.lit(x).cast("timestamp_ntz") for x in (SINCE, UNTIL))
    return S.match_watches(D.watches(spark, d), D.listings(spark, d), since, until)


@query("watch_match", f"{MATCH_SQL} select watch_id, id, price_eur from m")
def watch_match(spark, d):  # noqa: ANN001, ANN201
    return _matches(spark, d).select("watch_id", "id", "price_eur")


@query("topn_per_group", f"{MATCH_SQL} select watch_id, id, rank, extra from (select *, row_number() over (partition by watch_id order by first_seen_at desc, id) as rank, greatest(count(*) over (partition by watch_id) - 10, 0) as extra from m) where rank <= 10")
def topn_per_group(spark, d):  # noqa: ANN001, ANN201
    return S.top_per_group(_matches(spark, d), "watch_id", [F.desc("first_seen_at"), F.col("id")], 10).select("watch_id", "id", "rank", "extra")


# --- aggregations ---------------------------------------------------------------------------------------------------


@query("group_count_topn", f"{L} select make, model, count(*) as n from listings where {D.ACTIVE_SQL} group by all order by n desc, make, model limit 20")
def group_count_topn(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).where(P.active()).groupBy("make", "model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "make", "model").limit(20)


@query("percentile_group", f"{L} select model_id, round(quantile_cont(price_eur, 0.25), 4) as p25, round(quantile_cont(price_eur, 0.5), 4) as p50, round(quantile_cont(price_eur, 0.75), 4) as p75 from listings where {D.REFERENCE_SQL} group by all")
def percentile_group(spark, d):  # noqa: ANN001, ANN201
    q = lambda p: F.round(F.percentile("price_eur", p), 4)
    return D.listings(spark, d).where(P.market_reference(D.NEXT_YEAR)).groupBy("model_id").agg(q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"))


@query("filtered_counts", f"{L} select source, count(*) as total, count(*) filter (price_eur is null) as no_price, count(*) filter (country is null) as no_country, count(*) filter (photo_count = 0) as no_photo, count(*) filter (removed_at is not null and year >= 2000) as gone from listings group by all")
def filtered_counts(spark, d):  # noqa: ANN001, ANN201
    c = F.col
    return D.listings(spark, d).groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(c("price_eur").isNull()).alias("no_price"), F.count_if(c("country").isNull()).alias("no_country"),
        F.count_if(c("photo_count") == 0).alias("no_photo"), F.count_if(c("removed_at").isNotNull() & (c("year") >= 2000)).alias("gone"),
    )


@query("having_filter", f"{L} select model_id, region, count(*) filter ({D.ACTIVE_SQL}) as live from listings group by all having count(*) filter ({D.ACTIVE_SQL}) >= 5")
def having_filter(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).groupBy("model_id", "region").agg(F.count_if(P.active()).alias("live")).where("live >= 5")


@query("first_by_order", f"{L} select seller, arg_min(id, (first_seen_at, id)) as first_id, count(*) as n from listings group by seller")
def first_by_order(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).groupBy("seller").agg(F.min_by("id", F.struct("first_seen_at", "id")).alias("first_id"), F.count("*").alias("n"))


@query("count_distinct_having", f"{L} select vin, count(distinct source) as sources from listings where vin is not null group by vin having count(distinct source) > 1")
def count_distinct_having(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).where("vin is not null").groupBy("vin").agg(F.count_distinct("source").alias("sources")).where("sources > 1")


@query("incoherent_clusters", f"{L} select seller, region, source from listings group by all having count(distinct model_id) > 1 or max(year) - min(year) > 2 or max(price_eur) > 3 * nullif(min(price_eur), 0)")
def incoherent_clusters(spark, d):  # noqa: ANN001, ANN201
    g = D.listings(spark, d).groupBy("seller", "region", "source").agg(
        F.count_distinct("model_id").alias("m"), (F.max("year") - F.min("year")).alias("y"), F.max("price_eur").alias("hi"), F.nullif(F.min("price_eur"), F.lit(0)).alias("lo")
    )
    return g.where("m > 1 or y > 2 or hi > 3 * lo").select("seller", "region", "source")


@query("weighted_mean", f"{L}, s as (select model_id, region, median(price_eur) as m, count(*) as n from listings group by all) select model_id, round(sum(m * n) / nullif(sum(n), 0), 4) as wm from s group by model_id")
def weighted_mean(spark, d):  # noqa: ANN001, ANN201
    s = D.listings(spark, d).groupBy("model_id", "region").agg(F.median("price_eur").alias("m"), F.count("*").alias("n"))
    return s.groupBy("model_id").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), 4).alias("wm"))


@query("weekly_rollup", "select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, event_type, count(*) as n, floor(sum(floor(value * 100 + 0.5)::bigint) * 100 / count(*) + 0.5) / 10000 as mean, sum(floor(value * 100 + 0.5)::bigint) / 100 as total from events group by all")
def weekly_rollup(spark, d):  # noqa: ANN001, ANN201
    e = D.table(spark, d, "events")
    return e.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), "event_type").agg(F.count("*").alias("n"), F.sum(half_up(F.col("value") * 100)).alias("c")).select("week", "event_type", "n", (half_up(F.col("c") * 100 / F.col("n")) / 10000).alias("mean"), (F.col("c") / 100).alias("total"))


@query("overview_kpi", f"{L}, m as (select model_id, count(*) as n, median(price_eur) as med from listings where {D.ACTIVE_SQL} group by all) select sum(n)::bigint as active, round(avg(med), 4) as mean_median, count(*) as models from m")
def overview_kpi(spark, d):  # noqa: ANN001, ANN201
    m = D.listings(spark, d).where(P.active()).groupBy("model_id").agg(F.count("*").alias("n"), F.median("price_eur").alias("med"))
    return m.agg(F.sum("n").alias("active"), F.round(F.avg("med"), 4).alias("mean_median"), F.count("*").alias("models"))


@query("max_cluster", f"{L} select max(n) + 1 as largest from (select vin, count(*) - 1 as n from listings where vin is not null group by vin)")
def max_cluster(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).where("vin is not null").groupBy("vin").agg((F.count("*") - 1).alias("n")).agg((F.max("n") + 1).alias("largest"))


@query("distinct_values", f"{L} select distinct make, model from listings where removed_at is null")
def distinct_values(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).where("removed_at is null").select("make", "model").distinct()


@query("coverage_counts", f"{L} select source, count(*) as total, count(price_eur) as price, count(mileage_km) as km, count(power_kw) as power, count(vin) as vin, count(country) as country, count(seller_type) as seller_type from listings group by source")
def coverage_counts(spark, d):  # noqa: ANN001, ANN201
    names = {"price": "price_eur", "km": "mileage_km", "power": "power_kw", "vin": "vin", "country": "country", "seller_type": "seller_type"}
    return D.listings(spark, d).groupBy("source").agg(F.count("*").alias("total"), *[F.count(c).alias(k) for k, c in names.items()])


@query("run_summary", f"select count(*) filter (event_type <> 'error') as succeeded, count(*) filter (event_type = 'error') as failed, coalesce(sum(floor(value)) filter (event_type <> 'error'), 0)::bigint as added from events where ts >= timestamp '{D.EVENTS_AS_OF}' - interval 2 days")
def run_summary(spark, d):  # noqa: ANN001, ANN201
    e = D.table(spark, d, "events").where(F.col("ts") >= F.lit(D.EVENTS_AS_OF).cast("timestamp_ntz") - F.expr("interval 2 days"))
    ok = F.col("event_type") != "error"
    return e.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.floor("value"))), F.lit(0)).alias("added"))


@query("age_percentiles", f"{L}, a as (select source, epoch(timestamp '{D.AS_OF}' - price_checked_at) / 86400.0 as age from listings where price_checked_at is not null) select source, round(quantile_cont(age, 0.5), 4) as p50, round(quantile_cont(age, 0.9), 4) as p90, round(max(age), 4) as oldest from a group by source")
def age_percentiles(spark, d):  # noqa: ANN001, ANN201
    age = F.unix_micros(D.as_of().cast("timestamp")) - F.unix_micros(F.col("price_checked_at").cast("timestamp"))
    rows = D.listings(spark, d).where("price_checked_at is not null").select("source", (age / 86_400_000_000.0).alias("age"))
    ages = group_quantiles(rows, ["source"], "age", {"p50": 0.5, "p90": 0.9, "oldest": 1.0})
    return ages.select("source", *[F.round(c, 4).alias(c) for c in ("p50", "p90", "oldest")])


@query("region_counts", "with g as (select count(*) filter (n_name ilike '%_1%') as a, count(*) filter (n_name ilike '%2%') as b, count(*) filter (n_name ilike 'NATION_%') as c from supplier join nation on s_nationkey = n_nationkey) unpivot g on a, b, c into name region value n")
def region_counts(spark, d):  # noqa: ANN001, ANN201
    rows = D.table(spark, d, "supplier").join(D.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    one = rows.agg(*[F.count_if(F.col("n_name").ilike(p)).alias(k) for k, p in (("a", "%_1%"), ("b", "%2%"), ("c", "NATION_%"))])
    return one.select(F.expr("stack(3, 'a', a, 'b', b, 'c', c) as (region, n)"))


# --- windows --------------------------------------------------------------------------------------------------------


@query("first_value_window", f"{L} select id, first_value(id) over (partition by vin order by first_seen_at, id) as head from listings where vin is not null")
def first_value_window(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).where("vin is not null").select("id", F.first_value("id").over(W.partitionBy("vin").orderBy("first_seen_at", "id")).alias("head"))


@query("count_window", f"{L} select id, count(*) over (partition by vin) as n from listings where vin is not null")
def count_window(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).where("vin is not null").select("id", F.count("*").over(W.partitionBy("vin")).alias("n"))


@query("dedup_keep_first", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id) as k from events) where k = 1")
def dedup_keep_first(spark, d):  # noqa: ANN001, ANN201
    from ..operators.lifecycle import keep_first

    return keep_first(D.table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("systematic_sample", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) where k % 5 = 1")
def systematic_sample(spark, d):  # noqa: ANN001, ANN201
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return D.table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k % 5 = 1").select("o_custkey", "o_orderkey")


# --- sorts ----------------------------------------------------------------------------------------------------------


@query("sort_modes", f"{L} select id, price_eur from listings where removed_at is null order by price_eur desc nulls first, id desc limit 150")
def sort_modes(spark, d):  # noqa: ANN001, ANN201
    return S.page(D.listings(spark, d).where("removed_at is null"), "price_desc", 1, 150).select("id", "price_eur")


@query("paginate", f"{L} select id, mileage_km from listings where removed_at is null order by mileage_km asc nulls last, id desc limit 200 offset 400")
def paginate(spark, d):  # noqa: ANN001, ANN201
    return S.page(D.listings(spark, d).where("removed_at is null"), "mileage_asc", 3, 500).select("id", "mileage_km")


@query("trend_sort", f"{L}, g as (select model_id, count(*) as n, round(median(price_eur), 2) as med from listings group by all) select * from g order by med desc nulls last, model_id limit 10")
def trend_sort(spark, d):  # noqa: ANN001, ANN201
    g = D.listings(spark, d).groupBy("model_id").agg(F.count("*").alias("n"), R2(F.median("price_eur")).alias("med"))
    modes = {"price": F.col("med").desc_nulls_last(), "count": F.col("n").desc_nulls_last()}
    return g.orderBy(modes["price"], "model_id").limit(10)


@query("topk_expr", f"{L} select id, price_eur / power_kw as ratio from listings where power_kw > 0 and price_eur is not null order by ratio, id limit 25")
def topk_expr(spark, d):  # noqa: ANN001, ANN201
    rows = D.listings(spark, d).where("power_kw > 0 and price_eur is not null").select("id", (F.col("price_eur") / F.col("power_kw")).alias("ratio"))
    return rows.orderBy("ratio", "id").limit(25)


@query("effective_plan", "select o_custkey, o_orderkey as plan_order, o_orderstatus as state from (select *, row_number() over (partition by o_custkey order by case when o_orderstatus in ('O','P') then 0 else 1 end, o_orderdate desc, o_orderkey) as k from orders) where k = 1")
def effective_plan(spark, d):  # noqa: ANN001, ANN201
    w = W.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderstatus").isin("O", "P"), 0).otherwise(1), F.desc("o_orderdate"), "o_orderkey")
    rows = D.table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k = 1")
    return rows.select("o_custkey", F.col("o_orderkey").alias("plan_order"), F.col("o_orderstatus").alias("state"))


@query("stalest_first", f"{L} select id from listings where removed_at is null order by price_checked_at asc nulls first, id limit 120")
def stalest_first(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).where("removed_at is null").orderBy(F.col("price_checked_at").asc_nulls_first(), "id").limit(120).select("id")


@query("compare_models", f"""{L}, k as (select model_id, quantile_cont(price_eur, 0.5) as p50, avg(year) as y, avg(mileage_km) as km, count(*) as n from listings where {D.ACTIVE_SQL} and model_id in (3, 4) group by all)
 select a.model_id as a, b.model_id as b, a.p50 < b.p50 as cheaper, a.y > b.y as newer, a.km < b.km as fewer_km, a.n > b.n as more from k a, k b where a.model_id = 3 and b.model_id = 4""")
def compare_models(spark, d):  # noqa: ANN001, ANN201
    k = D.listings(spark, d).where(P.active() & F.col("model_id").isin(3, 4)).groupBy("model_id").agg(F.percentile("price_eur", 0.5).alias("p50"), F.avg("year").alias("y"), F.avg("mileage_km").alias("km"), F.count("*").alias("n"))
    # two rows of one row each: pivoted in one aggregation
    at = lambda c, m: F.max(F.when(F.col("model_id") == m, F.col(c)))
    return k.agg(F.lit(3).alias("a"), F.lit(4).alias("b"), (at("p50", 3) < at("p50", 4)).alias("cheaper"), (at("y", 3) > at("y", 4)).alias("newer"), (at("km", 3) < at("km", 4)).alias("fewer_km"), (at("n", 3) > at("n", 4)).alias("more"))


@query("model_kpi", f"{L} select make, model, count(*) as n, round(quantile_cont(price_eur, 0.25), 4) as p25, round(quantile_cont(price_eur, 0.5), 4) as p50, round(quantile_cont(price_eur, 0.75), 4) as p75, floor(avg(year) + 0.5)::bigint as avg_year, floor(avg(mileage_km) + 0.5)::bigint as avg_km from listings where {D.ACTIVE_SQL} and is_vehicle and {D.PLAUSIBLE_SQL} and country = 'SK' group by all")
def model_kpi(spark, d):  # noqa: ANN001, ANN201
    q = lambda p: F.round(F.percentile("price_eur", p), 4)
    rows = D.listings(spark, d).where(P.active() & P.market_reference_nullable(D.NEXT_YEAR))
    return rows.groupBy("make", "model").agg(F.count("*").alias("n"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), half_up(F.avg("year")).alias("avg_year"), half_up(F.avg("mileage_km")).alias("avg_km"))
