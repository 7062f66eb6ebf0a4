"""Queries of the batch analytics: cohorts, deals, snapshots, trends, clusters, merges, sales, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scoring
from ..functions.rounding import half_up, half_up_to, percent_share
from ..operators import cohorts as C
from ..operators import identity as I
from ..operators import lifecycle as M
from ..operators import quality as Q
from ..operators import snapshots as N
from . import domain as D
from .registry import query

L = f"with {D.LISTINGS_SQL}"
NOW = f"timestamp '{D.AS_OF}'"
DAY = "%Y-%m-%d"

# --- cohorts and deals ----------------------------------------------------------------------------------------------

POOL_SQL = f"pool as (select * from listings where {D.ACTIVE_SQL} and is_vehicle and {D.PRICED_SQL} and mileage_km is not null)"
COHORT_SQL = f"""{L}, {POOL_SQL}, ref as (select * from listings where {D.ACTIVE_SQL} and {D.REFERENCE_SQL} and mileage_km is not null),
cohort as (select p.id, quantile_cont(r.price_eur, 0.5) as median, quantile_cont(r.price_eur, 0.25) as p25, count(*) as cohort_size,
    bool_and(r.power_kw is not null) and any_value(p.power_kw) is not null as power_matched, min(r.first_seen_at) as oldest_seen
  from pool p join ref r on r.model_id = p.model_id and r.id <> p.id and r.year between p.year - 2 and p.year + 2 and r.mileage_km between p.mileage_km - 25000 and p.mileage_km + 25000
    and (p.power_kw is null or r.power_kw is null or r.power_kw between p.power_kw * 0.8 and p.power_kw * 1.2) group by p.id),
deal as (select p.*, median, p25, cohort_size, power_matched, oldest_seen, epoch({NOW} - p.first_seen_at) / 86400.0 as days, epoch({NOW} - oldest_seen) / 86400.0 as oldest_days,
    greatest(0, (median - p.price_eur) / median) as disc
  from cohort c join pool p using (id) where cohort_size >= 5 and median > 0 and p.price_eur < p25),
scored as (select *, floor(100 * (0.5 * least(1, disc / 0.4) + 0.2 * least(1, sqrt(cohort_size) / sqrt(50.0)) + 0.1 * (case seller_type when 'private' then 1.0 when 'dealer' then 0.5 else 0.6 end)
    + 0.1 * least(1, photo_count / 10.0) + 0.1 * (case when days <= 14 then 1 when days >= 60 then 0 else 1 - (days - 14) / 46.0 end)) + 0.5)::bigint as score,
    case when cohort_size >= 20 and oldest_days <= 14 then 'high' when cohort_size >= 10 and oldest_days <= 30 then 'medium' else 'low' end as confidence,
    floor(median - price_eur - 800 - floor(median * 0.05 + 0.5) + 0.5)::bigint as est_profit from deal)"""


def scored_sets(spark, d) -> tuple:  # noqa: ANN001
    """All adverts, the condition of the scored ones and that of the reference."""
    known = P.active() & F.col("mileage_km").isNotNull()
    return D.listings(spark, d), known & F.col("is_vehicle") & P.plausible_priced(D.NEXT_YEAR), known & P.market_reference(D.NEXT_YEAR)


@query("flip_opportunities", f"""{COHORT_SQL} select id, floor(median + 0.5)::bigint as median_eur, floor(p25 + 0.5)::bigint as p25_eur, cohort_size, power_matched, floor(disc * 10000 + 0.5) / 100 as discount_pct, score, confidence, est_profit from scored""")
def flip_opportunities(spark, d):  # noqa: ANN001, ANN201
    return C.flip_opportunities(*scored_sets(spark, d), D.as_of())


@query("cohort_stats", f"{COHORT_SQL} select id, round(median, 4) as median, round(p25, 4) as p25, cohort_size, power_matched, strftime(oldest_seen, '{DAY}') as oldest from cohort")
def cohort_stats(spark, d):  # noqa: ANN001, ANN201
    c = C.cohorts_within(*scored_sets(spark, d))
    return c.select("id", F.round("median", 4).alias("median"), F.round("p25", 4).alias("p25"), "cohort_size", "power_matched", F.date_format("oldest_seen", "yyyy-MM-dd").alias("oldest"))


@query("cohort_band_join", f"{COHORT_SQL} select cohort_size, count(*) as n from cohort group by cohort_size")
def cohort_band_join(spark, d):  # noqa: ANN001, ANN201
    return C.cohorts_within(*scored_sets(spark, d)).groupBy("cohort_size").agg(F.count("*").alias("n"))


@query("deal_filter", f"{COHORT_SQL} select id, price_eur, cohort_size from deal")
def deal_filter(spark, d):  # noqa: ANN001, ANN201
    return C.below_quartile(*scored_sets(spark, d)).select("id", "price_eur", "cohort_size")


@query("top_deals", f"{COHORT_SQL} select id, score, est_profit from scored where country is null or country = 'SK' order by score desc, est_profit desc, id limit 50")
def top_deals(spark, d):  # noqa: ANN001, ANN201
    scored = C.flip_opportunities(*scored_sets(spark, d), D.as_of(), ("country",))
    return scored.where(P.domestic_only()).orderBy(F.desc("score"), F.desc("est_profit"), "id").limit(50).select("id", "score", "est_profit")


SHOWN_SQL = "floor(median + 0.5)::bigint as median_eur, floor(floor(disc * 10000 + 0.5) / 100 * 10 + 0.5) / 10 as discount_pct"


@query("deal_list", f"""{COHORT_SQL}, r as (select *, floor(floor(median + 0.5) - price_eur + 0.5)::bigint as gain_eur, floor(disc * 10000 + 0.5) / 100 as pct from scored where price_eur <= 60000)
 select 'gain' as sort, * from (select id, {SHOWN_SQL}, gain_eur, floor(price_eur + 0.5)::bigint as price_eur, confidence from r where gain_eur >= 500 and pct >= 5 order by gain_eur desc, id limit 40)
 union all select 'discount', * from (select id, {SHOWN_SQL}, gain_eur, floor(price_eur + 0.5)::bigint, confidence from r order by pct desc, id limit 25)""")
def deal_list(spark, d):  # noqa: ANN001, ANN201
    """The first form of the deal list, by both orders."""
    deals = C.flip_opportunities(*scored_sets(spark, d), D.as_of(), ("price_eur", "model_id", "region"))
    by_gain = C.deal_list(deals, "gain", 40, discount=5, gain=500, price=60000)
    parts = [rows.select(F.lit(sort).alias("sort"), "id", "median_eur", "discount_pct", "gain_eur", "price_eur", "confidence") for sort, rows in (("gain", by_gain), ("discount", C.deal_list(deals, "discount", 25, price=60000)))]
    return parts[0].unionByName(parts[1])


@query("deal_lookup", f"{COHORT_SQL} select id, score, {SHOWN_SQL}, est_profit, cohort_size, confidence from scored where id % 3 = 0")
def deal_lookup(spark, d):  # noqa: ANN001, ANN201
    """Deals as the pages of a third of all adverts show them."""
    deals = C.flip_opportunities(*scored_sets(spark, d), D.as_of(), ("price_eur",))
    return C.deals_of(deals, D.listings(spark, d).where("id % 3 = 0")).select("id", "score", "median_eur", "discount_pct", "est_profit", "cohort_size", "confidence")


@query("confidence", "select k, case when c_custkey % 40 >= 20 and k <= 14 then 'high' when c_custkey % 40 >= 10 and k <= 30 then 'medium' else 'low' end as c, count(*) as n from customer, range(0, 40, 7) r(k) group by all")
def confidence(spark, d):  # noqa: ANN001, ANN201
    rows = D.table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(35).cast("long"), F.lit(7).cast("long"))).alias("k"))
    return rows.groupBy("k", scoring.confidence(F.col("size"), F.col("k")).alias("c")).agg(F.count("*").alias("n"))


SCORE_IN = "l_extendedprice as price, l_extendedprice * (0.6 + l_quantity / 40) as median, floor(l_quantity)::int as size, case l_returnflag when 'A' then 'private' when 'R' then 'dealer' end as seller, l_linenumber as photos, l_tax * 1000 as days"


def _score_input(spark, d) -> DataFrame:  # noqa: ANN001
    c = F.col
    return D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_extendedprice").alias("price"), (c("l_extendedprice") * (0.6 + c("l_quantity") / 40)).alias("median"), F.floor("l_quantity").cast("int").alias("size"),
        F.when(c("l_returnflag") == "A", "private").when(c("l_returnflag") == "R", "dealer").alias("seller"), c("l_linenumber").alias("photos"), (c("l_tax") * 1000).alias("days"),
    )


@query("deal_score", f"""with i as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {SCORE_IN} from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey,
 floor(100 * (0.5 * least(1, greatest(0, (median - price) / median) / 0.4) + 0.2 * least(1, sqrt(size) / sqrt(50.0)) + 0.1 * (case seller when 'private' then 1.0 when 'dealer' then 0.5 else 0.6 end) + 0.1 * least(1, photos / 10.0)
 + 0.1 * (case when days <= 14 then 1 when days >= 60 then 0 else 1 - (days - 14) / 46.0 end)) + 0.5)::bigint as score from i""")
def deal_score(spark, d):  # noqa: ANN001, ANN201
    rows = _score_input(spark, d)
    parts = scoring.components(*[F.col(x) for x in ("price", "median", "size", "seller", "photos", "days")])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scoring.deal_score(parts).alias("score"))


@query("est_profit", f"with i as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {SCORE_IN} from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(median - price - 800 - floor(median * 0.05 + 0.5) + 0.5)::bigint as profit from i")
def est_profit(spark, d):  # noqa: ANN001, ANN201
    return _score_input(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scoring.profit(F.col("price"), F.col("median")).alias("profit"))


@query("cost_calc", f"with i as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {SCORE_IN} from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, (floor(median - price - 500 - floor(size / 30.0 * 100 + 0.5) - floor(median * 0.05 + 0.5) + 0.5))::bigint as gain from i")
def cost_calc(spark, d):  # noqa: ANN001, ANN201
    held = half_up(F.col("size") / 30.0 * 100)
    return _score_input(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scoring.profit(F.col("price"), F.col("median"), F.lit(500) + held).alias("gain"))


@query("explainer", f"""{COHORT_SQL} select id, floor((median - price_eur) / median * 100 + 0.5)::bigint || '% pod mediánom ' || year || ' ' || make || ' ' || model || ' v regióne ' || region || ' (cohort n=' || cohort_size || '). '
 || case seller_type when 'private' then 'Súkromný predajca' when 'dealer' then 'Predajca' else 'Predajca neznámy' end || '. Inzerát vystavený pred ' || floor(days + 0.5)::bigint || ' dňami.' as text from deal""".replace("else 'Predajca neznámy' end", "else 'Predajca neznámy' end"))
def explainer(spark, d):  # noqa: ANN001, ANN201
    rows = C.below_quartile(*scored_sets(spark, d), ("seller_type", "first_seen_at", "year", "make", "model", "region"))
    days = N.days_between(D.as_of(), F.col("first_seen_at"))
    name = F.concat_ws(" ", F.col("year").cast("string"), "make", "model")
    return rows.select("id", scoring.explainer(F.col("price_eur"), F.col("median"), F.col("cohort_size"), F.col("seller_type"), days, name, F.col("region")).alias("text"))


@query("effective_score", "select c_custkey, coalesce(case when c_custkey % 3 = 0 then (c_custkey % 101)::int end, least(100, greatest(0, floor(c_acctbal / 70 * 1.5 + 0.5)::int))) as score from customer")
def effective_score(spark, d):  # noqa: ANN001, ANN201
    kept = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 101)
    fallback = F.least(F.lit(100), F.greatest(F.lit(0), half_up(F.col("c_acctbal") / 70 * 1.5)))
    return D.table(spark, d, "customer").select("c_custkey", F.coalesce(kept, fallback).cast("int").alias("score"))


# --- snapshots and trends -------------------------------------------------------------------------------------------

SOLD_SQL = f"{L.replace('null::timestamp as sold_at', 'case when l_linestatus = ' + chr(39) + 'F' + chr(39) + ' and l_shipdate > o_orderdate and l_tax >= 0.03 then l_shipdate + interval 24 years end as sold_at')}"
WEEK = "2025-05-26 00:00:00"
SNAP_SQL = f"""{SOLD_SQL}, s as (select model_id, {D.YEAR_BUCKET_SQL} as year_bucket, {D.KM_BUCKET_SQL} as mileage_bucket, price_eur, sold_at, coalesce(sold_at >= timestamp '{WEEK}', false) as sold,
   case when sold_at >= timestamp '{WEEK}' and sold_at >= first_seen_alive_at then epoch(sold_at - first_seen_alive_at) / 86400.0 end as life, sold_at is null and removed_at is null and {D.PRICED_SQL} and price_eur > 0 as live
   from listings where is_vehicle and country = 'SK' and mileage_km >= 0),
 snap as (select model_id, year_bucket, mileage_bucket, count(*) filter (live) as count_active, floor(sum(floor(price_eur * 100 + 0.5)::bigint) filter (live) / count(*) filter (live) + 0.5) / 100 as avg_price_eur, floor(quantile_cont(price_eur, 0.5) filter (live) + 0.5)::bigint as median_price_eur,
   floor(quantile_cont(price_eur, 0.25) filter (live) + 0.5)::bigint as p25_price_eur, floor(quantile_cont(price_eur, 0.75) filter (live) + 0.5)::bigint as p75_price_eur, count(*) filter (sold) as count_sold,
   case when count(life) >= 5 then floor(quantile_cont(life, 0.5) * 100 + 0.5) / 100 end as days_to_sell from s group by 1, 2, 3 having count(*) filter (live) >= 3)"""


def with_sales(spark, d) -> DataFrame:  # noqa: ANN001
    """Adverts of which some removals count as sales."""
    return D.listings(spark, d).withColumn("sold_at", F.when(F.col("sells"), F.col("removed_at")))


def snapshot(spark, d) -> DataFrame:  # noqa: ANN001
    return N.weekly_snapshot(with_sales(spark, d), F.lit(WEEK).cast("timestamp_ntz"), D.NEXT_YEAR)


@query("weekly_snapshot", f"{SNAP_SQL} select * from snap")
def weekly_snapshot(spark, d):  # noqa: ANN001, ANN201
    return snapshot(spark, d)


@query("snapshot_stats", f"{SNAP_SQL} select year_bucket, sum(count_active)::bigint as active, sum(count_sold)::bigint as sold, count(days_to_sell) as timed from snap group by 1")
def snapshot_stats(spark, d):  # noqa: ANN001, ANN201
    return snapshot(spark, d).groupBy("year_bucket").agg(F.sum("count_active").alias("active"), F.sum("count_sold").alias("sold"), F.count("days_to_sell").alias("timed"))


@query("iso_week", "select event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') as monday from events")
def iso_week(spark, d):  # noqa: ANN001, ANN201
    return D.table(spark, d, "events").select("event_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("monday"))


@query("trending_models", f"""{SNAP_SQL}, a as (select model_id, sum(median_price_eur * count_active) / nullif(sum(count_active), 0) as m, sum(count_active) as n from snap where count_active >= 5 group by 1),
 live as (select model_id, quantile_cont(price_eur, 0.5) as m, count(*) as n from listings where sold_at is null and removed_at is null and {D.REFERENCE_SQL} group by 1 having count(*) >= 5)
 select l.model_id, round(coalesce(a.m, l.m), 4) as median, coalesce(a.n, l.n)::bigint as active from live l left join a using (model_id)""")
def trending_models(spark, d):  # noqa: ANN001, ANN201
    snap = N.weighted_median(snapshot(spark, d).where("count_active >= 5"), ["model_id"])
    live = with_sales(spark, d).where(P.active() & P.market_reference(D.NEXT_YEAR)).groupBy("model_id").agg(F.percentile("price_eur", 0.5).alias("m"), F.count("*").alias("n")).where("n >= 5")
    j = live.join(snap, "model_id", "left")
    return j.select("model_id", F.round(F.coalesce("weighted_median", "m"), 4).alias("median"), F.coalesce("active", "n").alias("active"))


@query("coalesce_fallback", f"""{SNAP_SQL}, a as (select model_id, max(median_price_eur) as s from snap where year_bucket = '2020+' group by 1), b as (select model_id, median(price_eur) as m from listings group by 1)
 select model_id, coalesce(s, floor(m + 0.5)::bigint) as price from b left join a using (model_id)""")
def coalesce_fallback(spark, d):  # noqa: ANN001, ANN201
    a = snapshot(spark, d).where("year_bucket = '2020+'").groupBy("model_id").agg(F.max("median_price_eur").alias("s"))
    b = D.listings(spark, d).groupBy("model_id").agg(F.median("price_eur").alias("m"))
    return b.join(a, "model_id", "left").select("model_id", F.coalesce("s", half_up(F.col("m"))).alias("price"))


WOW_SQL = """with w as (select event_type, date_trunc('week', ts) as wk, sum(value) as v from events group by all), p as (select distinct wk from w order by wk desc limit 2),
 now as (select * from w where wk = (select max(wk) from p)), before as (select * from w where wk = (select min(wk) from p))
 select n.event_type, case when b.v <> 0 then round(case when abs((n.v - b.v) / b.v * 100) < 0.5 then 0 else (n.v - b.v) / b.v * 100 end, 4) end as pct from now n left join before b using (event_type)"""


@query("wow_change", WOW_SQL)
def wow_change(spark, d):  # noqa: ANN001, ANN201
    w = D.table(spark, d, "events").groupBy("event_type", F.date_trunc("week", "ts").alias("wk")).agg(F.sum("value").alias("v"))
    # the globally last two weeks, whatever a type skips
    last = w.select("wk").distinct().orderBy(F.desc("wk")).limit(2).agg(F.max("wk").alias("now"), F.min("wk").alias("before"))
    rows = w.join(F.broadcast(last), F.col("wk").isin(F.col("now"), F.col("before")))
    one = rows.groupBy("event_type").agg(F.max(F.when(F.col("wk") == F.col("now"), F.col("v"))).alias("n"), F.max(F.when(F.col("wk") == F.col("before"), F.col("v"))).alias("b"))
    return one.where("n is not null").select("event_type", F.round(N.change(F.col("n"), F.col("b")), 4).alias("pct"))


@query("trajectory", f"with w as (select event_type, date_trunc('week', ts) as wk, count(*) as n, median(value) as m from events where ts >= timestamp '{D.EVENTS_AS_OF}' - interval 84 days group by all) select strftime(wk, '{DAY}') as week, sum(n)::bigint as active, round(avg(m), 4) as mean_median from w group by 1")
def trajectory(spark, d):  # noqa: ANN001, ANN201
    e = D.table(spark, d, "events").where(F.col("ts") >= F.lit(D.EVENTS_AS_OF).cast("timestamp_ntz") - F.expr("interval 84 days"))
    w = e.groupBy("event_type", F.date_trunc("week", "ts").alias("wk")).agg(F.count("*").alias("n"), F.median("value").alias("m"))
    return w.groupBy(F.date_format("wk", "yyyy-MM-dd").alias("week")).agg(F.sum("n").alias("active"), F.round(F.avg("m"), 4).alias("mean_median"))


@query("rolling_lookback", f"select event_type, count(*) as n from events where ts > timestamp '{D.EVENTS_AS_OF}' - interval 10 days group by 1")
def rolling_lookback(spark, d):  # noqa: ANN001, ANN201
    return D.table(spark, d, "events").where(F.col("ts") > F.lit(D.EVENTS_AS_OF).cast("timestamp_ntz") - F.expr("interval 10 days")).groupBy("event_type").agg(F.count("*").alias("n"))


# --- identity -------------------------------------------------------------------------------------------------------

FP_SQL = f"""{L}, keyed as (select *, sha256(make || '|' || model || '|' || year || '|' || case when mileage_km is null then 'unknown' else (floor(mileage_km / 5000) * 5000)::bigint::varchar end
   || '|' || trim(regexp_replace(lower(region), '[^a-z0-9-]+', '-', 'g'), '-') || '|' || trim(regexp_replace(lower(seller), '[^a-z0-9]+', '-', 'g'), '-') || '|no-photo') as fingerprint, first_seen_at + interval 60 days as last_seen_at from listings)"""


def keyed(spark, d) -> DataFrame:  # noqa: ANN001
    none = F.lit(None).cast("string")
    fp = I.fingerprint(F.col("make"), F.col("model"), F.col("year"), F.col("mileage_km"), F.col("region"), F.col("seller"), none)
    return D.listings(spark, d).withColumn("fingerprint", fp).withColumn("last_seen_at", F.col("first_seen_at") + F.expr("interval 60 days"))


@query("fingerprint", f"{FP_SQL} select id, fingerprint from keyed")
def fingerprint(spark, d):  # noqa: ANN001, ANN201
    return keyed(spark, d).select("id", "fingerprint")


@query("km_floor_bucket", f"{L} select case when mileage_km is null or mileage_km < 0 then 'unknown' else (floor(mileage_km / 5000) * 5000)::bigint::varchar end as b, count(*) as n from listings group by 1")
def km_floor_bucket(spark, d):  # noqa: ANN001, ANN201
    from ..functions.buckets import mileage_floor

    return D.listings(spark, d).groupBy(mileage_floor(F.col("mileage_km")).alias("b")).agg(F.count("*").alias("n"))


@query("photo_identity", "select page_id, case when b = '' then null when strpos(b, page_id::varchar) > 0 then null else 's:' || b end as photo from (select page_id, regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '(?i)^[a-z]+://[^/]+(/[^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '\\.[A-Za-z0-9]{1,5}$', '') as b from pages)")
def photo_identity(spark, d):  # noqa: ANN001, ANN201
    return D.table(spark, d, "pages").select("page_id", I.photo_identity(F.lit("s"), F.col("url"), F.col("page_id").cast("string")).alias("photo"))


VIN_SQL = f"{FP_SQL}, v as (select *, case when length(vin) = 17 and count(*) over (partition by vin) > 1 then first_value(id) over (partition by vin order by first_seen_at, id) end as head from keyed), vc as (select * exclude (canonical_listing_id), case when head <> id then head end as canonical_listing_id from v)"
# recent enough relative to the derived data
RECENT = "2025-09-30 00:00:00"
CLUSTER_SQL = f"""{VIN_SQL}, conf as (select fingerprint from vc where vin is not null and fingerprint is not null group by 1 having count(distinct vin) > 1), heads as (select distinct canonical_listing_id as id from vc where canonical_listing_id is not null),
 cand as (select * from vc where fingerprint is not null and canonical_listing_id is null and photo_count > 0 and last_seen_at >= timestamp '{RECENT}' - interval 90 days and fingerprint not in (select fingerprint from conf) and id not in (select id from heads)),
 grp as (select fingerprint, arg_min(id, (first_seen_at, id)) as h from cand group by 1 having count(*) > 1),
 fc as (select vc.* exclude (canonical_listing_id), coalesce(case when cand.id is not null and grp.h <> vc.id then grp.h end, vc.canonical_listing_id) as canonical_listing_id from vc left join cand on cand.id = vc.id left join grp on grp.fingerprint = cand.fingerprint)"""


def clustered(spark, d) -> DataFrame:  # noqa: ANN001
    return I.cluster_by_fingerprint(I.cluster_by_vin(keyed(spark, d)), F.lit(RECENT).cast("timestamp_ntz"))


@query("vin_cluster", f"{VIN_SQL} select id, canonical_listing_id as head from vc where canonical_listing_id is not null")
def vin_cluster(spark, d):  # noqa: ANN001, ANN201
    return I.cluster_by_vin(keyed(spark, d)).where("canonical_listing_id is not null").select("id", F.col("canonical_listing_id").alias("head"))


@query("fp_cluster", f"{CLUSTER_SQL} select id, canonical_listing_id as head from fc where canonical_listing_id is not null")
def fp_cluster(spark, d):  # noqa: ANN001, ANN201
    return clustered(spark, d).where("canonical_listing_id is not null").select("id", F.col("canonical_listing_id").alias("head"))


CHAIN_SQL = "with f as (select o_orderkey as id, case when o_orderkey % 3 > 0 then o_orderkey - 1 end as h from orders)"


@query("flatten_chains", f"{CHAIN_SQL} select a.id, case when b.h is null then a.h end as head from f a left join f b on b.id = a.h")
def flatten_chains(spark, d):  # noqa: ANN001, ANN201
    rows = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") - 1).alias("canonical_listing_id"))
    return I.flatten_chains(rows).select("id", F.col("canonical_listing_id").alias("head"))


UNMERGE_SQL = "with f as (select o_orderkey as id, case when o_orderkey % 9 = 1 then -o_orderkey when o_orderkey % 4 > 0 then o_orderkey - o_orderkey % 4 end as h, case when o_orderkey % 5 > 1 then 'v' || (o_orderkey // 4 % 2 + o_orderkey % 2) end as vin, 'f' || (o_orderkey // 4) as fp from orders)"


@query("unmerge", f"{UNMERGE_SQL} select a.id, case when coalesce(a.vin = b.vin, false) or (coalesce(a.fp = b.fp, false) and not coalesce(a.vin <> b.vin, false)) then a.h end as head from f a left join f b on b.id = a.h")
def unmerge(spark, d):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey")
    quarter = F.expr("o_orderkey div 4")
    rows = D.table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 9 == 1, -k).when(k % 4 > 0, k - k % 4).alias("canonical_listing_id"), F.when(k % 5 > 1, F.concat(F.lit("v"), (quarter % 2 + k % 2).cast("string"))).alias("vin"), F.concat(F.lit("f"), quarter.cast("string")).alias("fingerprint")
    )
    return I.unmerge(rows).select("id", F.col("canonical_listing_id").alias("head"))


@query("refresh_fp", f"{FP_SQL}, o as (select id, case when id % 5 = 0 then null when id % 7 = 0 then 'stale' else fingerprint end as old, fingerprint as new from keyed) select count(*) filter (old is distinct from new) as changed, count(*) filter (new is null and old is not null) as cleared from o")
def refresh_fp(spark, d):  # noqa: ANN001, ANN201
    new = F.col("fingerprint")
    old = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, "stale").otherwise(new)
    return keyed(spark, d).agg(F.count_if(~old.eqNullSafe(new)).alias("changed"), F.count_if(new.isNull() & old.isNotNull()).alias("cleared"))


@query("reset_canonical", f"{CLUSTER_SQL} select count(*) filter (canonical_listing_id is not null) as to_reset, count(*) filter (canonical_listing_id is null and removed_at is null and sold_at is null and fingerprint is not null) as heads from fc")
def reset_canonical(spark, d):  # noqa: ANN001, ANN201
    return clustered(spark, d).agg(F.count_if(F.col("canonical_listing_id").isNotNull()).alias("to_reset"), F.count_if(P.active() & F.col("fingerprint").isNotNull()).alias("heads"))


@query("catalog_merge", "with m as (select p_partkey as model_id, min(p_partkey) over (partition by p_brand, lower(p_name)) as canonical from part) select l_returnflag, canonical as model_id, count(*) as n from lineitem join m on model_id = l_partkey group by all")
def catalog_merge(spark, d):  # noqa: ANN001, ANN201
    models = D.table(spark, d, "part").select(F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("make"), F.lower("p_name").alias("bare_slug"))
    facts = D.table(spark, d, "lineitem").select(F.col("l_partkey").alias("model_id"), "l_returnflag")
    return I.merge_catalog(facts, models).groupBy("l_returnflag", "model_id").agg(F.count("*").alias("n"))


# --- versions of tables ---------------------------------------------------------------------------------------------

MERGE_SQL = f"""{FP_SQL}, o as (select *, 'Levice' as locality, 3 as view_count, 'u1' as url, 'j1' as raw_json, case when id % 3 = 0 then 'p1' end as seller_phone from keyed where id % 10 < 8), n as (select source, source_id, case when id % 4 = 0 then null else price_eur * 0.9 end as price_eur, case when id % 3 = 0 then null else year end as year, mileage_km + 10 as mileage_km, null::varchar as fuel, gearbox, region, null::varchar as country, case when id % 3 = 1 then 'Nitra' end as locality, case when id % 4 > 1 then 7 end as view_count, 'u2' as url, case when id % 2 = 0 then '{{}}' end as raw_json, 'p2' as seller_phone, model_id, 'new ' || raw_title as raw_title, is_featured and id % 2 = 0 as is_featured, 'x' as fingerprint from keyed where id % 10 > 5)
 select source, source_id, round(case when n.source is not null then n.price_eur else o.price_eur end, 4) as price_eur, coalesce(n.year, o.year) as year, coalesce(n.mileage_km, o.mileage_km) as mileage_km, coalesce(n.fuel, o.fuel) as fuel, coalesce(n.country, o.country) as country,
  coalesce(n.raw_title, o.raw_title) as raw_title, coalesce(o.is_featured, false) or coalesce(n.is_featured, false) as is_featured, coalesce(o.fingerprint, n.fingerprint) as fingerprint,
  coalesce(n.locality, o.locality) as locality, coalesce(n.view_count, o.view_count) as view_count, case when n.source is not null then n.url else o.url end as url, case when n.source is not null then n.raw_json else o.raw_json end as raw_json, coalesce(o.seller_phone, n.seller_phone) as seller_phone,
  strftime(case when o.source is not null and n.source is not null then coalesce(o.first_seen_alive_at, {NOW}) else o.first_seen_alive_at end, '{DAY}') as alive, strftime(case when n.source is null then o.price_checked_at when o.source is not null or n.price_eur is not null then {NOW} end, '{DAY}') as checked,
  strftime(case when n.source is not null then {NOW} else o.last_seen_at end, '{DAY}') as last_seen, case when o.source is null then 'added' when n.source is null then 'same' else 'updated' end as change
 from o full join n using (source, source_id)"""


@query("upsert_merge", MERGE_SQL)
def upsert_merge(spark, d):  # noqa: ANN001, ANN201
    rows, k = keyed(spark, d), F.col("id")
    new = rows.where(k % 10 > 5).select(
        "source", "source_id", F.when(k % 4 != 0, F.col("price_eur") * 0.9).alias("price_eur"), F.when(k % 3 != 0, F.col("year")).alias("year"), (F.col("mileage_km") + 10).alias("mileage_km"),
        F.lit(None).cast("string").alias("fuel"), "gearbox", "region", F.lit(None).cast("string").alias("country"), F.when(k % 3 == 1, "Nitra").alias("locality"), F.when(k % 4 > 1, 7).alias("view_count"), F.lit("u2").alias("url"),
        F.when(k % 2 == 0, "{}").alias("raw_json"), F.lit("p2").alias("seller_phone"), "model_id", F.concat(F.lit("new "), "raw_title").alias("raw_title"),
        (F.col("is_featured") & (k % 2 == 0)).alias("is_featured"), F.lit("x").alias("fingerprint"),
    )
    old = rows.where(k % 10 < 8).withColumns({"locality": F.lit("Levice"), "view_count": F.lit(3), "url": F.lit("u1"), "raw_json": F.lit("j1"), "seller_phone": F.when(k % 3 == 0, "p1")})
    out = M.merge_observations(old, new, D.as_of())
    day = lambda c, name: F.date_format(c, "yyyy-MM-dd").alias(name)
    return out.select("source", "source_id", F.round("price_eur", 4).alias("price_eur"), "year", "mileage_km", "fuel", "country", "raw_title", "is_featured", "fingerprint", *M.OVERWRITE[1:], "locality", "view_count", "seller_phone", day("first_seen_alive_at", "alive"), day("price_checked_at", "checked"), day("last_seen_at", "last_seen"), "change")


DETAIL_SQL = f"""{L}, s as (select id, case when id % 4 <> 0 then (case when id % 2 = 0 then 'SK-' else 'CZ-' end) || region end as region, year, mileage_km, fuel, country, price_eur, price_checked_at, id % 3 = 0 as has from listings)
select id, case when id % 2 = 0 then 'Old' when has then 'Town' end as locality, case when has then coalesce(mileage_km, 77000) else mileage_km end as mileage_km, case when has then coalesce(fuel, 'lpg') else fuel end as fuel,
  case when has and (region is null or left(region, 2) <> 'SK') then 'SK-Town' else region end as region, case when has and id % 5 = 0 then null when has then coalesce(country, 'SK') else country end as country,
  case when has and id % 7 > 0 then coalesce(price_eur, 1234.0) else price_eur end as price_eur, strftime(case when has and id % 7 > 0 then coalesce(price_checked_at, {NOW}) else price_checked_at end, '{DAY}') as checked from s"""


@query("detail_merge", DETAIL_SQL)
def detail_merge(spark, d):  # noqa: ANN001, ANN201
    k = F.col("id")
    rows = D.listings(spark, d).withColumn("region", F.when(k % 4 != 0, F.concat(F.when(k % 2 == 0, "SK-").otherwise("CZ-"), "region")))
    details = rows.where(k % 3 == 0).select(
        "id", F.lit(2001).alias("year"), F.lit(77000).cast("bigint").alias("mileage_km"), F.lit("lpg").alias("fuel"), F.lit("manual").alias("gearbox"), F.lit(1).alias("model_id"), F.lit("t").alias("raw_title"),
        F.when(k % 7 > 0, 1234.0).alias("price_eur"), F.lit("SK-Town").alias("region"), F.lit("SK").alias("country"), (k % 5 == 0).alias("abroad"), F.lit("Town").alias("locality"),
    )
    out = M.merge_details(rows.withColumn("locality", F.when(k % 2 == 0, F.lit("Old"))), details, D.as_of())
    return out.select("id", "locality", "mileage_km", "fuel", "region", "country", "price_eur", F.date_format("price_checked_at", "yyyy-MM-dd").alias("checked"))


@query("append_if_absent", "select o_orderkey, o_custkey from orders where o_orderkey % 3 = 0 and not (o_orderkey % 2 = 0)")
def append_if_absent(spark, d):  # noqa: ANN001, ANN201
    rows = D.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return M.append_absent(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@query("update_from_join", "select c_custkey, case when n.o_custkey is not null then 'buyer' else c_mktsegment end as segment from customer left join (select distinct o_custkey from orders where o_totalprice > 400000) n on o_custkey = c_custkey")
def update_from_join(spark, d):  # noqa: ANN001, ANN201
    big = D.table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey").distinct()
    return D.table(spark, d, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.when(F.col("o_custkey").isNotNull(), "buyer").otherwise(F.col("c_mktsegment")).alias("segment"))


@query("purge_stale", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def purge_stale(spark, d):  # noqa: ANN001, ANN201
    return D.table(spark, d, "orders").join(D.table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("replace_children", f"with {D.LISTINGS_SQL}, {D.PHOTOS_SQL} select * from photos where listing_id % 4 <> 1 or listing_id % 3 = 0 union all select listing_id, position, left(url || repeat('x', 1990), 2000) from photos where listing_id % 4 = 1 and listing_id % 3 <> 0")
def replace_children(spark, d):  # noqa: ANN001, ANN201
    old = D.photos(spark, d)
    # of every third re-read advert all places are out of bounds: its photos stay
    new = old.where("listing_id % 4 = 1").withColumns({"url": F.concat("url", F.repeat(F.lit("x"), F.lit(1990))), "position": F.when(F.col("listing_id") % 3 == 0, F.col("position") + 100).otherwise(F.col("position"))})
    return M.replace_children(old, new, "listing_id", "position")


@query("apply_liveness", f"{FP_SQL}, c as (select id, case id % 6 when 0 then 404 when 1 then 410 when 2 then 200 when 3 then 301 when 4 then 500 end as s from keyed) select id, strftime(case when s in (404, 410) then coalesce(removed_at, {NOW}) else removed_at end, '{DAY}') as removed, strftime(case when s between 200 and 399 then {NOW} else last_seen_at end, '{DAY}') as seen, strftime(case when s between 200 and 399 then coalesce(first_seen_alive_at, {NOW}) else first_seen_alive_at end, '{DAY}') as alive from keyed join c using (id)")
def apply_liveness(spark, d):  # noqa: ANN001, ANN201
    rows, k = keyed(spark, d), F.col("id") % 6
    status = F.when(k == 0, 404).when(k == 1, 410).when(k == 2, 200).when(k == 3, 301).when(k == 4, 500)
    out = M.apply_liveness(rows, rows.where(k < 5).select("id", status.alias("status")), D.as_of())
    day = lambda c, name: F.date_format(c, "yyyy-MM-dd").alias(name)
    return out.select("id", day("removed_at", "removed"), day("last_seen_at", "seen"), day("first_seen_alive_at", "alive"))


SOLD_IN = f"{L}, s as (select *, seller || model_id as fingerprint from listings)"
SOLD_ANTI = f"""{SOLD_IN} select id, strftime(removed_at, '{DAY}') as sold from s a where removed_at is not null and first_seen_alive_at is not null and not exists (select 1 from s b where b.fingerprint = a.fingerprint and b.source = a.source and b.id <> a.id
 and b.first_seen_at > a.first_seen_at and b.first_seen_at between a.removed_at - interval 30 days and a.removed_at + interval 30 days)"""


@query("detect_sold", SOLD_ANTI)
def detect_sold(spark, d):  # noqa: ANN001, ANN201
    rows = D.listings(spark, d).withColumn("fingerprint", F.concat("seller", F.col("model_id").cast("string")))
    return M.detect_sold(rows).select("id", F.date_format("sold_at", "yyyy-MM-dd").alias("sold"))


@query("sold_interval_anti", f"{SOLD_ANTI.replace('select id, strftime(removed_at, ' + chr(39) + DAY + chr(39) + ') as sold', 'select source, count(*) as sold')} group by source")
def sold_interval_anti(spark, d):  # noqa: ANN001, ANN201
    rows = D.listings(spark, d).withColumn("fingerprint", F.concat("seller", F.col("model_id").cast("string")))
    return M.detect_sold(rows).groupBy("source").agg(F.count("*").alias("sold"))


@query("daily_snapshot", f"{L} select id as listing_id, '2025-08-10' as day, price_eur from listings where price_eur is not null and removed_at is null and price_checked_at >= timestamp '2025-08-10' - interval 7 days and id % 10 <> 0")
def daily_snapshot(spark, d):  # noqa: ANN001, ANN201
    rows, day = D.listings(spark, d), F.lit("2025-08-10 00:00:00").cast("timestamp_ntz")
    history = rows.where("id % 10 = 0").select(F.col("id").alias("listing_id"), F.to_date(day).alias("recorded_on"))
    return M.daily_prices(rows, history, day).select("listing_id", F.date_format("recorded_on", "yyyy-MM-dd").alias("day"), "price_eur")


@query("backfill_null", f"{L} select id, coalesce(case when id % 3 = 0 then null else year end, list_filter(list_transform(regexp_extract_all(raw_title, '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda x: x::int), lambda x: x between 1980 and 2100)[1]) as year, coalesce(mileage_km, regexp_extract(raw_title, '([0-9]+) km', 1)::bigint) as km from listings")
def backfill_null(spark, d):  # noqa: ANN001, ANN201
    from ..functions import text as X

    title = F.col("raw_title")
    known = F.when(F.col("id") % 3 != 0, F.col("year"))
    return D.listings(spark, d).select("id", F.coalesce(known, X.plausible_year(title, 2100)).alias("year"), F.coalesce("mileage_km", X.km_in_text(title)).alias("km"))


@query("enrich_worklist", f"with {D.LISTINGS_SQL}, {D.PHOTOS_SQL} select id from listings l where removed_at is null and not exists (select 1 from photos p where p.listing_id = l.id) order by first_seen_at desc, id limit 200")
def enrich_worklist(spark, d):  # noqa: ANN001, ANN201
    rows = D.listings(spark, d).where("removed_at is null").join(D.photos(spark, d), F.col("listing_id") == F.col("id"), "left_anti")
    return rows.orderBy(F.desc("first_seen_at"), "id").limit(200).select("id")


# --- quality --------------------------------------------------------------------------------------------------------

PCT = lambda x, n="count(*)": f"case when {n} > 0 then floor({x} * 1000 / {n} + 0.5) / 10 else 0 end"
COMPLETE_SQL = f"""{L}, q as (select source, count(*) as total, {', '.join(f"{PCT(f'(count(*) - count({c}))::double')} as {k}_missing_pct" for k, c in (('price', 'price_eur'), ('model', 'model_id'), ('year', 'year'), ('mileage', 'mileage_km'), ('region', 'region'), ('fuel', 'fuel'), ('power', 'power_kw')))},
 {PCT(f"(count(*) filter ({D.PRICED_SQL} and mileage_km is not null))::double")} as ready_pct from listings where {D.ACTIVE_SQL} group by source)"""


def complete(spark, d) -> DataFrame:  # noqa: ANN001
    return Q.completeness(D.listings(spark, d), D.NEXT_YEAR)


@query("dq_completeness", f"{COMPLETE_SQL} select * from q")
def dq_completeness(spark, d):  # noqa: ANN001, ANN201
    return complete(spark, d)


HEALTH_SQL = "case when p >= 60 or m >= 70 then 'drift' when p >= 30 or r >= 60 or m >= 50 then 'warn' else 'ok' end"


@query("dq_health", f"select c_custkey, {HEALTH_SQL} as health from (select c_custkey, c_custkey % 101 as p, c_custkey * 7 % 101 as m, c_custkey * 13 % 101 as r from customer)")
def dq_health(spark, d):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    return D.table(spark, d, "customer").select("c_custkey", Q.health(k % 101, k * 7 % 101, k * 13 % 101).alias("health"))


@query("dq_enrichment", f"with {D.LISTINGS_SQL}, {D.PHOTOS_SQL}, p as (select listing_id, count(*) as n from photos group by 1) select source, count(*) as total, count(n) as with_photo, {PCT('count(n)::double')} as photo_pct, {PCT('count(vin)::double')} as vin_pct from listings left join p on listing_id = id where {D.ACTIVE_SQL} group by source")
def dq_enrichment(spark, d):  # noqa: ANN001, ANN201
    p = D.photos(spark, d).groupBy("listing_id").agg(F.count("*").alias("n"))
    rows = D.listings(spark, d).where(P.active()).join(p, F.col("listing_id") == F.col("id"), "left")
    g = rows.groupBy("source").agg(F.count("*").alias("total"), F.count("n").alias("with_photo"), F.count("vin").alias("v"))
    return g.select("source", "total", "with_photo", percent_share(F.col("with_photo"), F.col("total")).alias("photo_pct"), percent_share(F.col("v"), F.col("total")).alias("vin_pct"))


@query("dq_scores", f"{COHORT_SQL} select count(*) as scored, count(*) filter (score >= 70) as good, round(avg(score), 4) as mean, count(*) filter (confidence = 'high') as high from scored")
def dq_scores(spark, d):  # noqa: ANN001, ANN201
    s = C.flip_opportunities(*scored_sets(spark, d), D.as_of())
    return s.agg(F.count("*").alias("scored"), F.count_if(F.col("score") >= 70).alias("good"), F.round(F.avg("score"), 4).alias("mean"), F.count_if(F.col("confidence") == "high").alias("high"))


@query("dq_dedup", f"""{CLUSTER_SQL}, n as (select canonical_listing_id, count(*) as n from fc where canonical_listing_id is not null group by 1)
 select {PCT('count(canonical_listing_id)::double')} as repost_pct, {PCT('count(vin)::double')} as vin_pct, (select coalesce(max(n), 0) + 1 from n) as max_cluster, (select count(*) from (select vin from fc where vin is not null group by 1 having count(distinct source) > 1)) as cross_source from fc""")
def dq_dedup(spark, d):  # noqa: ANN001, ANN201
    rows = clustered(spark, d)
    share = rows.agg(percent_share(F.count("canonical_listing_id"), F.count("*")).alias("repost_pct"), percent_share(F.count("vin"), F.count("*")).alias("vin_pct"))
    largest = rows.where("canonical_listing_id is not null").groupBy("canonical_listing_id").agg(F.count("*").alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) + 1).alias("max_cluster"))
    cross = rows.where("vin is not null").groupBy("vin").agg(F.count_distinct("source").alias("s")).where("s > 1").agg(F.count("*").alias("cross_source"))
    # one row each
    return share.crossJoin(largest).crossJoin(cross)


FRESH_SQL = f"""{L}, a as (select source, epoch(timestamp '2025-09-01' - price_checked_at) / 86400.0 as age, case source when 'A' then 4 when 'N' then 4 when 'R' then 6 else 5 end * 100 as sla from listings where {D.ACTIVE_SQL} and price_eur is not null),
 f as (select source, count(*) as priced, {PCT('(count(*) filter (age <= sla / 100))::double')} as fresh_pct, floor(quantile_cont(age, 0.5) * 100 + 0.5) / 100 as age_p50, floor(quantile_cont(age, 0.9) * 100 + 0.5) / 100 as age_p90, floor(max(age) * 100 + 0.5) / 100 as age_oldest from a group by source)"""


def fresh(spark, d) -> DataFrame:  # noqa: ANN001
    return Q.freshness(D.listings(spark, d), F.lit("2025-09-01 00:00:00").cast("timestamp_ntz"))


@query("dq_freshness", f"{FRESH_SQL} select * from f")
def dq_freshness(spark, d):  # noqa: ANN001, ANN201
    return fresh(spark, d)


@query("dq_alerts", f"{FRESH_SQL} select source, case when fresh_pct < 80 then 'error' else 'warn' end as level from f where fresh_pct < 95")
def dq_alerts(spark, d):  # noqa: ANN001, ANN201
    return fresh(spark, d).where("fresh_pct < 95").select("source", F.when(F.col("fresh_pct") < 80, "error").otherwise("warn").alias("level"))


@query("dq_drift_alerts", f"{COMPLETE_SQL} select source, case when price_missing_pct >= 60 or model_missing_pct >= 70 then 'drift' else 'warn' end as health, case when price_missing_pct >= 60 then 'price' when model_missing_pct >= 70 then 'model' else 'several' end as reason from q where price_missing_pct >= 30 or region_missing_pct >= 60 or model_missing_pct >= 50")
def dq_drift_alerts(spark, d):  # noqa: ANN001, ANN201
    return Q.drift_alerts(complete(spark, d))


@query("dq_country_alerts", f"{L}, c as (select source, {PCT('(count(*) filter (country is null))::double')} as missing_pct from listings where {D.ACTIVE_SQL} group by source) select source, case when missing_pct >= 20 then 'error' else 'warn' end as level, missing_pct from c where missing_pct >= 2")
def dq_country_alerts(spark, d):  # noqa: ANN001, ANN201
    return Q.country_alerts(D.listings(spark, d))


@query("dq_public", f"{COMPLETE_SQL}, h as (select case when price_missing_pct >= 60 or model_missing_pct >= 70 then 2 when price_missing_pct >= 30 or region_missing_pct >= 60 or model_missing_pct >= 50 then 1 else 0 end as k from q) select coalesce(case max(k) when 0 then 'ok' when 1 then 'warn' when 2 then 'drift' end, 'unknown') as health from h")
def dq_public(spark, d):  # noqa: ANN001, ANN201
    health = Q.health(F.col("price_missing_pct"), F.col("model_missing_pct"), F.col("region_missing_pct"))
    rank = F.when(health == "drift", 2).when(health == "warn", 1).otherwise(0)
    return complete(spark, d).agg(F.coalesce(F.max_by(health, rank), F.lit("unknown")).alias("health"))


@query("null_keeping_discount", f"{L} select id, floor(price_eur * 10 + 0.5) / 10 as p from listings")
def null_keeping_discount(spark, d):  # noqa: ANN001, ANN201
    return D.listings(spark, d).select("id", half_up_to(F.col("price_eur"), 1).alias("p"))
