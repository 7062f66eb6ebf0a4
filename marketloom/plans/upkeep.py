"""Queries of the table's upkeep: work lists, publishing, the catalogue, cluster health, and what detail pages say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import identity as I
from ..operators import lifecycle as M
from ..operators import quality as Q
from ..operators import search as S
from ..operators import snapshots as N
from ..sources import cards as G
from ..sources import details as T2
from ..sources import tree as T
from . import domain as D
from .analytics import FP_SQL, NOW, PCT, SNAP_SQL, WEEK, keyed, snapshot
from .lists import UNTIL
from .registry import query
from .sources import text_of

L = f"with {D.LISTINGS_SQL}"

# --- work lists -----------------------------------------------------------------------------------------------------

WORK_SQL = f"""{L}, l as (select * exclude (model_id), case when id % 13 <> 0 then model_id end as model_id, case when id % 6 <> 0 then region end as locality from listings where source = 'A' and id % 3 = 1),
 dt as (select id as listing_id, case when id % 5 <> 0 then 'd' end as description from listings where id % 7 > 1), a as (select * from l where {D.ACTIVE_SQL} and id > 4000000000000)"""
WORK = {
    "unenriched": "l where id not in (select listing_id from dt) order by id", "unenriched-newest": "l where id not in (select listing_id from dt) order by first_seen_at desc, id",
    "null-description": "a where id in (select listing_id from dt where description is null) order by id", "null-price": "a where price_eur is null order by id", "null-model": "a where model_id is null order by id",
    "null-locality": "a where locality is null order by id", "null-country": "a where country is null order by id",
}


@query("enrich_modes", WORK_SQL + " " + " union all ".join(f"(select '{k}' as mode, id from {v} limit 60)" for k, v in WORK.items()))
def enrich_modes(spark, d):  # noqa: ANN001, ANN201
    """The next 60 adverts of every mode, for one of three callers of one source."""
    k = F.col("id")
    rows = D.listings(spark, d)
    details = rows.where(k % 7 > 1).select(k.alias("listing_id"), F.when(k % 5 != 0, "d").alias("description"))
    rows = rows.withColumns({"model_id": F.when(k % 13 != 0, F.col("model_id")), "locality": F.when(k % 6 != 0, F.col("region"))})
    out = None
    for mode in M.MODES:
        part = M.worklist(rows, details, mode, 60, source="A", after_id=4_000_000_000_000, share=(1, 3)).select(F.lit(mode).alias("mode"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("detail_tombstones", f"{L} select id as listing_id, strftime({NOW}, '%Y-%m-%d') as detailed, '[GONE]' as description from listings where id % 6 < 4 and id % 4 <> 0 union all select id, '2025-01-01', null from listings where id % 4 = 0")
def detail_tombstones(spark, d):  # noqa: ANN001, ANN201
    """The detail table after a round of checks: what was found gone has a row."""
    k = F.col("id")
    rows = D.listings(spark, d)
    details = rows.where(k % 4 == 0).select(k.alias("listing_id"), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("detailed_at"), F.lit(None).cast("string").alias("description"))
    checks = rows.select("id", F.get(F.array(*[F.lit(s) for s in (404, 410, 403, 302, 200, 500)]), (k % 6).cast("int")).alias("status"))
    return details.unionByName(M.tombstones(details, checks, D.as_of())).select("listing_id", F.date_format("detailed_at", "yyyy-MM-dd").alias("detailed"), "description")


@query("detail_rows", f"""{L}, one as (select distinct id from listings), old as (select id as listing_id, 'old' as description, id % 90 as power_kw, '2025-01-01' as detailed from one where id % 3 = 0),
 gone as (select id from one where id % 6 < 4), new as (select id as listing_id, case when id % 5 > 0 then 'new' end as description, null::bigint as power_kw, '2025-11-30' as detailed from one where id % 4 = 0 and id not in (select * from gone))
 select * from old where listing_id not in (select listing_id from new) union all select * from new union all select id, '[GONE]', null, '2025-11-30' from gone where id not in (select listing_id from old)""")
def detail_rows(spark, d):  # noqa: ANN001, ANN201
    """The detail table after a round of reading: rows replaced whole, gone pages marked."""
    k = F.col("id")
    rows = D.listings(spark, d).select("id").distinct()
    old = rows.where(k % 3 == 0).select(k.alias("listing_id"), F.lit("old").alias("description"), (k % 90).alias("power_kw"), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("detailed_at"))
    new = rows.where(k % 4 == 0).select(k.alias("listing_id"), F.when(k % 5 > 0, "new").alias("description"), F.lit(None).cast("long").alias("power_kw"))
    statuses = rows.select("id", F.get(F.array(*[F.lit(s) for s in (404, 410, 403, 302, 200, 500)]), (k % 6).cast("int")).alias("status"))
    return M.upsert_details(old, new, statuses, D.as_of()).select("listing_id", "description", "power_kw", F.date_format("detailed_at", "yyyy-MM-dd").alias("detailed"))


@query("refresh_write", f"""{FP_SQL}, o as (select *, case when id % 5 = 0 then null when id % 7 = 0 then 'stale' else fingerprint end as old, case when id % 11 = 0 then timestamp '2025-09-01' end as detailed_at from keyed)
 select id, case when old is null or price_checked_at > timestamp '2025-09-05' - interval 8 days or detailed_at > timestamp '2025-09-05' - interval 8 days then fingerprint else old end as fingerprint from o""")
def refresh_write(spark, d):  # noqa: ANN001, ANN201
    k = F.col("id")
    rows = keyed(spark, d).withColumns({"computed": F.col("fingerprint"), "fingerprint": F.when(k % 5 == 0, None).when(k % 7 == 0, "stale").otherwise(F.col("fingerprint")), "detailed_at": F.when(k % 11 == 0, F.lit("2025-09-01 00:00:00").cast("timestamp_ntz"))})
    return I.refresh_fingerprints(rows, F.col("computed"), F.lit("2025-09-05 00:00:00").cast("timestamp_ntz")).select("id", "fingerprint")


END = f"timestamp '{UNTIL}'"
OWN_SQL = f"""with {D.LISTINGS_SQL}, {D.WATCHES_SQL}, w as (select *, greatest(coalesce(case when watch_id % 3 = 0 then {END} - to_days((watch_id % 5)::int) end, {END} - to_days((watch_id % 12)::int)), {END} - interval 7 days) as since from watches)
 select watch_id, id, price_eur from w join listings l on w.model_id = l.model_id where enabled and removed_at is null and canonical_listing_id is null and first_seen_at between since and {END}
  and (price_max is null or price_eur <= price_max) and (year_min is null or year >= year_min) and (mileage_max is null or mileage_km <= mileage_max)"""


@query("watch_window", OWN_SQL)
def watch_window(spark, d):  # noqa: ANN001, ANN201
    until, k = F.lit(UNTIL).cast("timestamp_ntz"), F.col("watch_id")
    back = lambda n: until - F.make_dt_interval(n.cast("int"))
    rows = D.watches(spark, d).withColumns({"last_notified_at": F.when(k % 3 == 0, back(k % 5)), "created_at": back(k % 12)})
    return S.match_since_notified(rows, D.listings(spark, d), until).select("watch_id", "id", "price_eur")


# --- lists ----------------------------------------------------------------------------------------------------------

ORDERS = {"newest": "first_seen_at desc, id desc", "oldest": "first_seen_at, id", "price_asc": "price_eur asc nulls last, id desc", "price_desc": "price_eur desc nulls first, id desc"}


@query("sort_all_modes", f"{L} " + " union all ".join(f"(select '{k}' as mode, id, price_eur from listings where removed_at is null order by {v} limit 80 offset 80)" for k, v in ORDERS.items()))
def sort_all_modes(spark, d):  # noqa: ANN001, ANN201
    rows = D.listings(spark, d).where(P.listed())
    out = None
    for mode in ORDERS:
        part = S.page(rows, mode, 2, 80).select(F.lit(mode).alias("mode"), "id", "price_eur")
        out = part if out is None else out.unionByName(part)
    return out


TOWNS = ["Bratislava", "BA - Ružinov", "Trnava a okolie", "trenčín", "Nitra", "Žilina", "SK-Žilina", "Banská Bystrica", "Prešov", "Košice", "Brno", "Levice pri Nitre a Trnave", None]
TOWN_SQL = "case c_custkey % 13 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(TOWNS) if v) + " end"
GROUPS_SQL = " union all ".join(f"select '{name}' as region, count(*) filter ({' or '.join(f"place ilike '{p}'" for p in patterns)}) as n from t" for name, patterns in P.REGION_PATTERNS.items())


@query("region_groups", f"with t as (select {TOWN_SQL} as place from customer) {GROUPS_SQL}")
def region_groups(spark, d):  # noqa: ANN001, ANN201
    """Adverts of each of the eight regions, in one pass; a place may count in several."""
    place = F.get(F.array(*[F.lit(v).cast("string") for v in TOWNS]), (F.col("c_custkey") % 13).cast("int"))
    rows = D.table(spark, d, "customer").select(place.alias("place"))
    names = list(P.REGION_PATTERNS)
    one = rows.agg(*[F.count_if(F.coalesce(P.in_regions("place", [n]), F.lit(False))).alias(f"n{i}") for i, n in enumerate(names)])
    return one.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', n{i}" for i, n in enumerate(names)) + ") as (region, n)"))


# --- snapshots ------------------------------------------------------------------------------------------------------

PUB_SQL = f"""{SNAP_SQL}, old as (select model_id, year_bucket, mileage_bucket, count_active, median_price_eur, '2025-05-19' as captured_on from snap where model_id % 2 = 0
 union all select model_id, year_bucket, mileage_bucket, count_active, median_price_eur + 1, '2025-05-26' from snap where model_id % 3 = 0 union all select model_id, 'retired', mileage_bucket, count_active, median_price_eur, '2025-05-26' from snap where model_id % 5 = 0)"""
PUB_COLS = ["model_id", "year_bucket", "mileage_bucket", "count_active", "median_price_eur"]


def published(spark, d) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """What is published (an earlier week, this week's run before, cohorts that are gone), and what is computed now."""
    now = snapshot(spark, d).select(*PUB_COLS)
    day, k = lambda v: F.to_date(F.lit(v)), F.col("model_id")
    old = now.where(k % 2 == 0).withColumn("captured_on", day("2025-05-19"))
    old = old.unionByName(now.where(k % 3 == 0).withColumns({"median_price_eur": F.col("median_price_eur") + 1, "captured_on": day(WEEK)}))
    return old.unionByName(now.where(k % 5 == 0).withColumns({"year_bucket": F.lit("retired"), "captured_on": day(WEEK)})), now


@query("snapshot_publish", f"{PUB_SQL} select * from old where captured_on <> '2025-05-26' union all select model_id, year_bucket, mileage_bucket, count_active, median_price_eur, '2025-05-26' from snap")
def snapshot_publish(spark, d):  # noqa: ANN001, ANN201
    old, now = published(spark, d)
    return N.publish(old, now, F.to_date(F.lit(WEEK))).select(*PUB_COLS, F.col("captured_on").cast("string").alias("captured_on"))


@query("snapshot_retired", f"{PUB_SQL} select model_id, year_bucket, mileage_bucket from old anti join snap using (model_id, year_bucket, mileage_bucket) where captured_on = '2025-05-26'")
def snapshot_retired(spark, d):  # noqa: ANN001, ANN201
    old, now = published(spark, d)
    return N.retired(old, now, F.to_date(F.lit(WEEK))).select(*N.COHORT)


# --- clusters -------------------------------------------------------------------------------------------------------

HEALTH_SQL = f"""with t as (select o_orderkey as id, case when o_orderkey % 4 > 0 then o_orderkey - o_orderkey % 4 when o_orderkey % 40 = 4 then o_orderkey - 4 end as head, case when o_orderkey % 5 > 1 then 'WVWZZZ1KZAW' || lpad((o_orderkey // 3)::varchar, 6, '0') when o_orderkey % 5 = 1 then 'short' end as vin,
  o_orderstatus as source, case when o_orderkey % 50 = 1 then 2 else 1 end as model_id, 2000 + o_orderkey // 4 % 10 + case when o_orderkey % 60 = 1 then 3 else 0 end as year, o_totalprice as price from orders),
 g as (select head, count(*) as n, count(distinct vin) filter (length(vin) = 17) > 1 as v, count(distinct model_id) > 1 or max(year) - min(year) > 2 or coalesce(max(price) > 3 * nullif(min(price), 0), false) as i from t where head is not null group by 1),
 r as (select count(*) as total, count(*) - count(head) as canonical, count(head) as clones, {PCT('count(head)::double')} as repost_pct, {PCT('(count(*) filter (length(vin) = 17))::double')} as vin_pct, (select coalesce(max(n) + 1, 0) from g) as max_cluster,
  (select count(*) from (select vin from t where length(vin) = 17 group by 1 having count(distinct source) > 1)) as cross_source_vins, (select count(*) from g where v) as vin_conflicts, (select count(*) from g where i) as incoherent,
  (select count(*) from t a join t b on b.id = a.head where b.head is not null) as chained from t)"""


def cluster_report(spark, d) -> DataFrame:  # noqa: ANN001
    k = F.col("o_orderkey")
    rows = D.table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 4 > 0, k - k % 4).when(k % 40 == 4, k - 4).alias("canonical_listing_id"), F.when(k % 5 > 1, F.concat(F.lit("WVWZZZ1KZAW"), F.lpad(F.expr("o_orderkey div 3").cast("string"), 6, "0"))).when(k % 5 == 1, "short").alias("vin"),
        F.col("o_orderstatus").alias("source"), F.when(k % 50 == 1, 2).otherwise(1).alias("model_id"), (F.expr("o_orderkey div 4") % 10 + 2000 + F.when(k % 60 == 1, 3).otherwise(0)).alias("year"), F.col("o_totalprice").alias("price_eur"),
    )
    return Q.dedup_health(rows)


@query("dq_clusters", f"{HEALTH_SQL} select * from r")
def dq_clusters(spark, d):  # noqa: ANN001, ANN201
    return cluster_report(spark, d)


@query("dq_cluster_alerts", f"{HEALTH_SQL} select * from (select 'vin_conflict' as kind, vin_conflicts as n from r union all select 'chained', chained from r union all select 'incoherent', incoherent from r) where n > 0")
def dq_cluster_alerts(spark, d):  # noqa: ANN001, ANN201
    return Q.cluster_alerts(cluster_report(spark, d))


# --- catalogue ------------------------------------------------------------------------------------------------------

# makes under their own name, under an alias, and words that are no make
CATALOG_SQL = """with p as (select p_partkey + case when p_partkey % 3 = 0 then 1000000 else 0 end as model_id, substr(p_brand, 7)::int as b, p_partkey % 7 as v, case when p_partkey % 4 = 0 then 'brand-' || substr(p_brand, 7) || '-' else '' end || lower(p_type) || '-' || p_size as slug from part),
 models as (select model_id, b + case v when 0 then 2000000 when 1 then 1000000 else 0 end as make_id, slug from p), makes as (select distinct b + case v when 0 then 2000000 when 1 then 1000000 else 0 end as make_id, case v when 0 then 'predam-' when 1 then 'b' else 'brand-' end || b as slug from p),
 m as (select make_id, slug as make, case when slug like 'brand-%' then slug when regexp_matches(slug, '^b[0-9]+$') then 'brand-' || substr(slug, 2) end as brand from makes),
 home as (select brand, min(make_id) as home from m where brand is not null group by 1),
 x as (select models.*, brand, case when brand is not null and starts_with(slug, brand || '-') then substr(slug, length(brand) + 2) when starts_with(slug, make || '-') then substr(slug, length(make) + 2) else slug end as bare from models join m using (make_id)),
 y as (select x.*, home, case when brand is not null then min(model_id) over (partition by brand, bare) end as first, exists (select 1 from models t where t.make_id = home and t.slug = bare) as taken from x left join home using (brand)),
 a as (select model_id, case when brand is null then 'junk' when first <> model_id then 'remap' when home <> make_id and not taken then 'move' else 'keep' end as action, first, home, slug, bare from y),
 actions as (select model_id, action, case action when 'remap' then first when 'move' then home end as target, case action when 'move' then bare else slug end as slug from a)"""


def catalog(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    b, v = F.substring("p_brand", 7, 4).cast("int"), F.col("p_partkey") % 7
    rows = D.table(spark, d, "part").select(
        model_key(F.col("p_partkey")).alias("model_id"), (b + F.when(v == 0, 2_000_000).when(v == 1, 1_000_000).otherwise(0)).alias("make_id"),
        F.concat(F.when(v == 0, "predam-").when(v == 1, "b").otherwise("brand-"), b.cast("string")).alias("make"),
        F.concat(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("brand-"), b.cast("string"), F.lit("-"))).otherwise(F.lit("")), F.lower("p_type"), F.lit("-"), F.col("p_size").cast("string")).alias("slug"),
    )
    models, makes = rows.drop("make"), rows.select("make_id", F.col("make").alias("slug")).distinct()
    brand = lambda c: F.when(c.startswith("brand-"), c).when(c.rlike("^b[0-9]+$"), F.concat(F.lit("brand-"), F.substring(c, 2, 10)))
    return models, makes, I.catalog_actions(models, makes, brand)


def model_key(part: Column) -> Column:
    return part + F.when(part % 3 == 0, I.MINTED).otherwise(0)


@query("catalog_actions", f"{CATALOG_SQL} select * from actions")
def catalog_actions(spark, d):  # noqa: ANN001, ANN201
    return catalog(spark, d)[2]


FACTS_SQL = f"{CATALOG_SQL}, f as (select case action when 'remap' then target when 'junk' then null else model_id end as model_id from lineitem join actions on model_id = l_partkey + case when l_partkey % 3 = 0 then 1000000 else 0 end)"


@query("catalog_facts", f"{FACTS_SQL} select model_id, count(*) as n from f group by 1")
def catalog_facts(spark, d):  # noqa: ANN001, ANN201
    facts = D.table(spark, d, "lineitem").select(model_key(F.col("l_partkey")).alias("model_id"))
    return I.apply_catalog(facts, catalog(spark, d)[2]).groupBy("model_id").agg(F.count("*").alias("n"))


@query("catalog_orphans", f"""{FACTS_SQL}, gone as (select model_id from models where model_id >= 1000000 and model_id not in (select model_id from f where model_id is not null)),
 left_over as (select coalesce(case when action = 'move' then target end, make_id) as make_id from models join actions using (model_id) where model_id not in (select * from gone))
 select 'model' as kind, model_id as id from gone union all select 'make', make_id from makes where make_id >= 1000000 and make_id not in (select make_id from left_over)""")
def catalog_orphans(spark, d):  # noqa: ANN001, ANN201
    models, makes, actions = catalog(spark, d)
    facts = D.table(spark, d, "lineitem").select(model_key(F.col("l_partkey")).alias("model_id"))
    return I.catalog_orphans(models, makes, actions, [I.apply_catalog(facts, actions)])


# --- pages ----------------------------------------------------------------------------------------------------------


@query("card_flags", f"""{L} select id, case when id % 3 = 0 then id % 2000 end as views, case when id % 3 <> 2 then id % 900 end as views_b, case when is_featured then true end as featured from listings""")
def card_flags(spark, d):  # noqa: ANN001, ANN201
    """Views and marks of cards in both layouts."""
    k = F.col("id")
    a = text_of('<div class="card"><span class="small10">', F.when(k % 3 == 0, text_of(k % 2000, " ×")).otherwise(F.lit("Nitra")), '</span><b class="', F.when(F.col("is_featured"), "toplogo").otherwise("logo"), '">', F.when(k % 2 == 0, "TOP").otherwise("pro 1"), "</b></div>")
    b = text_of("<li>", F.when(k % 3 == 0, text_of('<i class="ViewCount">', k % 900, "</i>")).when(k % 3 == 1, text_of("Zobrazení: ", k % 900)).otherwise(F.lit("žiadne")), "</li>")
    rows = T.with_tree(T.with_tree(D.listings(spark, d).select("id", a.alias("a"), b.alias("b")), "a", "x"), "b", "y")
    x, y = F.col("x"), F.col("y")
    texts = lambda page, nodes: F.transform(nodes, lambda n: T.text_of(page, n))
    views = G.views(texts(x, T.found(x["nodes"], ["span"], ["small10", "small11"])))
    named = G.named_views(texts(y, F.filter(y["nodes"], lambda n: n["class"].rlike("(?i)view|zobrazen"))), y["text"])
    return rows.select("id", views.alias("views"), named.alias("views_b"), G.marked(texts(x, T.found(x["nodes"], ["b", "span"], ["toplogo", "toplabel"]))).alias("featured"))


PROSE_SQL = f"""{L} select id, vin, power_kw, case when year between 1980 and 2026 then year end as year, case when mileage_km between 1000 and 2000000 then mileage_km end as mileage_km, case when floor(price_eur) between 100 and 500000 then floor(price_eur)::bigint end as price_eur, fuel, gearbox, case when id % 4 = 0 then 'Nemecko' else region end as locality, id % 4 = 0 as abroad,
 case when id % 4 <> 0 then 'SK-' || region end as region, case when id % 2 = 0 then 'dealer' else 'private' end as seller_type, make || ' ' || model as raw_title, 1 as photos from listings"""


@query("detail_prose", PROSE_SQL)
def detail_prose(spark, d):  # noqa: ANN001, ANN201
    """Detail pages made of all adverts, with a neighbour's labels and price beside them, read back."""
    c = F.col
    fuel, gear = F.when(c("fuel") == "diesel", "nafta").when(c("fuel") == "gasoline", "benzín"), F.when(c("gearbox") == "manual", "manuálna").otherwise("automat")
    html = text_of(
        "<html><body><h1> ", c("make"), " ", c("model"), " </h1><aside>Rok výroby: 2003, Farba: žltá <span>77 €</span></aside><b class=\"price\">", F.when(c("price_eur").isNotNull(), text_of(F.floor("price_eur").cast("bigint"), " €")).otherwise(F.lit("dohodou")), '</b><div class="text">Karoséria: kombi, ',
        "Farba: modrá, VIN: ", c("vin"), ", Výkon: ", c("power_kw"), " kW, Rok výroby: ", c("year"), ", Najazdené: ", c("mileage_km"), " km, Palivo: ", fuel, ", Prevodovka: ", gear, ", Lokalita: ", F.when(c("id") % 4 == 0, "Nemecko").otherwise(c("region")), ", koniec</div><p>",
        F.when(c("id") % 2 == 0, "Firma").otherwise("Súkromný predaj"), '</p><img src="https://img.example.com/', c("id"), '/1.jpg?a=1"><img src="https://img.example.com/', c("id"), '/1.jpg?a=2"><img src="https://img.example.com/x/2.jpg"></body></html>',
    )
    pages = D.listings(spark, d).select("id", c("id").cast("string").alias("source_id"), html.alias("html"))
    read = T2.prose_details(pages, T2.Prose("img\\.example\\.com/", ["text"], ["price"]), D.NEXT_YEAR)
    keep = ["vin", "power_kw", "year", "mileage_km", "price_eur", "fuel", "gearbox", "locality", "abroad", "region", "seller_type", "raw_title"]
    return read.select("id", *[F.col(f"detail.{k}").alias(k) for k in keep], F.size("detail.photos").alias("photos"))


SHEET_SQL = f"""{L} select id, vin, power_kw, case when year between 1980 and 2026 then year end as year, case when mileage_km between 1 and 1999999 then mileage_km end as mileage_km, case when floor(price_eur) between 100 and 500000 then floor(price_eur)::bigint end as price_eur, fuel, gearbox, 'kombi' as body_type, case when id % 2 = 0 then seller end as seller_name,
 case when id % 2 = 0 then 'dealer' when id % 3 = 0 then 'private' end as seller_type, 2 as equipment, 220 as described, 1 as photos from listings"""


@query("detail_sheet", SHEET_SQL)
def detail_sheet(spark, d):  # noqa: ANN001, ANN201
    c = F.col
    fuel, gear = F.when(c("fuel") == "diesel", "Diesel").when(c("fuel") == "gasoline", "Benzín"), F.when(c("gearbox") == "manual", "Manuálna").otherwise("Automatická")
    html = text_of(
        '<html><body><div class="p-amount">', F.when(c("price_eur").isNotNull(), text_of(F.floor("price_eur").cast("bigint"), " €")).otherwise(F.lit("Cena dohodou")), "</div><p>Akontácia 2 576 €</p>\n<dl>Karoséria: kombi\nVIN: ", c("vin"), "\nVýkon: ", c("power_kw"), " kW\nRok výroby: ", c("year"), "\nNajazdené: ", c("mileage_km"), " km\nPalivo: ", fuel,
        "\nPrevodovka: ", gear, "\n</dl>", F.when(c("id") % 2 == 0, text_of('<a href="https://dealer-', c("id"), '.cars.example/">', c("seller"), "</a>")).when(c("id") % 3 == 0, "Súkromný predajca"),
        "<ul><li>Airbag</li><li>Airbag</li><li>ABS</li><li>4 dvere</li><li>x</li></ul><p>krátky</p><p>", F.repeat(F.lit("dlhý text "), 22), '.</p><a href="https://img.example.com/foto/1.jpg"></a><img src="https://img.example.com/thumb/1.jpg"></body></html>',
    )
    read = T2.sheet_details(D.listings(spark, d).select("id", html.alias("html")), T2.Sheet("img\\.example\\.com", "cars\\.example"), D.NEXT_YEAR)
    keep = ["vin", "power_kw", "year", "mileage_km", "price_eur", "fuel", "gearbox", "body_type", "seller_name", "seller_type"]
    return read.select("id", *[F.col(f"detail.{k}").alias(k) for k in keep], F.size("detail.equipment").alias("equipment"), (F.length("detail.description") - 1).alias("described"), F.size("detail.photos").alias("photos"))


@query("detail_record", f"""{L} select id, vin, power_kw, case when year between 1980 and 2026 then year end as year, case when mileage_km > 0 then mileage_km end as mileage_km, case when floor(price_eur + 0.5) >= 100 then floor(price_eur + 0.5)::bigint end as price_eur, fuel, replace(lower(make), '#', '-') as make, region as locality, seller as seller_name,
 case when id % 2 = 0 then 'dealer' else 'private' end as seller_type, 2 as equipment, 2 as photos from listings""")
def detail_record(spark, d):  # noqa: ANN001, ANN201
    c = F.col
    record = F.to_json(F.struct(F.struct(F.struct(
        F.lower("vin").alias("vin"), "year", F.col("mileage_km").alias("mileage"), F.when(c("id") % 3 == 0, c("price_eur")).alias("finalPrice"), c("price_eur").alias("price"), F.when(c("fuel") == "diesel", "Nafta").when(c("fuel") == "gasoline", "Benzín").alias("fuelValue"),
        F.col("make").alias("brandValue"), F.col("power_kw").alias("enginePower"), F.lit("Airbag, , ABS").alias("otherEquipment"), F.struct(c("seller").alias("displayName"), F.when(c("id") % 2 == 0, 17).alias("idFirm")).alias("user"), F.struct(c("region").alias("name")).alias("location"),
        F.array(F.lit("https://img.example.com/1.jpg"), F.lit("https://img.example.com/1.jpg"), F.lit("https://img.example.com/2.jpg")).alias("images"),
    ).alias("record")).alias("props")))
    pages = D.listings(spark, d).select("id", text_of('<html><script id="data" type="application/json">', record, "</script></html>").alias("html"))
    read = T2.record_details(pages, T2.Record("data", ["$.props.advert", "$.props.record"]), D.NEXT_YEAR)
    keep = ["vin", "power_kw", "year", "mileage_km", "price_eur", "fuel", "make", "locality", "seller_name", "seller_type"]
    return read.select("id", *[F.col(f"detail.{k}").alias(k) for k in keep], F.size("detail.equipment").alias("equipment"), F.size("detail.photos").alias("photos"))
