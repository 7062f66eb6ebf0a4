"""Queries of text extraction, event handling and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from . import domain as D
from .registry import query

L = f"with {D.LISTINGS_SQL}"


def _sample(values: list[str | None]):  # noqa: ANN202
    """One of the texts for every customer, in turn."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("c_custkey") % len(values)).cast("int"))


def _sample_sql(values: list[str | None]) -> str:
    cases = " ".join(f"when {k} then '" + v.replace("'", "''") + "'" for k, v in enumerate(values) if v is not None)
    return f"(select c_custkey, case c_custkey % {len(values)} {cases} end as s from customer)"


def _on_samples(name: str, values: list[str | None], make, sql: str) -> None:  # noqa: ANN001
    """One of the sample texts for every customer, so that the expression runs over a whole table."""

    @query(name, f"select c_custkey, s, {sql} as out from {_sample_sql(values)}")
    def run(spark, d) -> DataFrame:  # noqa: ANN001
        rows = D.table(spark, d, "customer").select("c_custkey", _sample(values).alias("s"))
        return rows.withColumn("out", make(F.col("s")))


def _case(pairs: dict[str, str], key: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items()) + " end"


_on_samples("dict_lookup", [" Benzín ", "NAFTA", "plug-in hybrid", "steam", "", None], lambda c: X.lookup(c, X.FUELS), _case(X.FUELS, "lower(trim(s))"))
_on_samples("digits_only", ["14.990,00 EUR", "0", "", "abc", "12 500 €", None], lambda c: X.digits_only(c, 1), "case when try_cast(regexp_replace(s, '[^0-9]', '', 'g') as bigint) >= 1 then try_cast(regexp_replace(s, '[^0-9]', '', 'g') as bigint) end")
_on_samples(
    "fx_fixed", ["450 000 Kč", "312 CZK", "9 990 €", "12510", None], lambda c: X.to_euro(X.crowns(c)),
    "case when regexp_matches(lower(s), 'k[čc]|czk') or s not like '%€%' then floor(nullif(try_cast(regexp_replace(s, '[^0-9]', '', 'g') as bigint), 0) / 25.0 + 0.5)::bigint end",
)
_on_samples("year_first", ["r. 2015/6", "1968cm3", "2099", "r.v. 1999", "x", None], lambda c: X.first_year(c, 2026), "case when try_cast(regexp_extract(s, '([0-9]{4})', 1) as int) between 1980 and 2026 then try_cast(regexp_extract(s, '([0-9]{4})', 1) as int) end")
_on_samples("slugify", ["Škoda Octavia", "Land Rover  Discovery!", "Citroën C4-", "ŽLTÝ kôň", "", None], X.slug, "regexp_replace(regexp_replace(strip_accents(lower(s)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')")
_on_samples(
    "text_amounts", ["Cena 12 500 € dohodou", "385 000 Kč", "99 €", "km 120 000 km", "nič", None],
    lambda c: F.concat_ws("/", *[F.coalesce(f(c).cast("string"), F.lit("-")) for f in (X.euro_in_text, X.crowns_in_text, X.km_in_text)]),
    "concat_ws('/', coalesce(case when try_cast(replace(regexp_extract(s, '([0-9][0-9 ]{1,12}) *€', 1), ' ', '') as bigint) between 100 and 9999999 then replace(regexp_extract(s, '([0-9][0-9 ]{1,12}) *€', 1), ' ', '') end, '-'), coalesce(case when try_cast(replace(regexp_extract(s, '([0-9][0-9 ]{1,12}) *[Kk][čc]', 1), ' ', '') as bigint) between 1000 and 99999999 then replace(regexp_extract(s, '([0-9][0-9 ]{1,12}) *[Kk][čc]', 1), ' ', '') end, '-'), coalesce(case when try_cast(replace(regexp_extract(s, '([0-9][0-9 ]{1,8}) *km', 1), ' ', '') as bigint) between 0 and 1999999 then replace(regexp_extract(s, '([0-9][0-9 ]{1,8}) *km', 1), ' ', '') end, '-'))",
)
_on_samples("year_from_text", ["1968 a 2015", "20155", "2099 1999", "rok 1979", None], lambda c: X.plausible_year(c, 2026), "list_filter(list_transform(regexp_extract_all(s, '\\b((?:19|20)[0-9]{2})\\b', 1), lambda x: x::int), lambda x: x between 1980 and 2026)[1]")
_on_samples("hint_order", ["diesel aj benzin", "Plug-in HYBRID", "elektro", "para", None], lambda c: X.first_hint(c, X.FUEL_HINTS), "coalesce(" + ", ".join(f"case when contains(lower(s), '{h}') then '{h}' end" for h in X.FUEL_HINTS) + ")")
_on_samples("region_prefix", ["Žilina", " SK-Žilina", "CZ-Brno", "  ", None], lambda c: F.concat_ws("|", X.prefixed_region(c, "SK"), X.shown_region(c)), "concat_ws('|', case when trim(s) = '' then null when regexp_matches(trim(s), '^[A-Z]{2}-') then trim(s) else 'SK-' || trim(s) end, case when trim(s) = '' then null else regexp_replace(trim(s), '^[A-Z]{2}-', '') end)")
_on_samples("badge_fuel", ["2.0 TDI DSG", "1.4 tsi", "TDI TSI", "1.5 T-GDI", "xtdix", None], X.fuel_of_badge, f"case when regexp_matches(lower(s), '\\b({'|'.join(X.DIESEL_BADGES)})\\b') then 'diesel' when regexp_matches(lower(s), '\\b({'|'.join(X.PETROL_BADGES)})\\b') then 'gasoline' end")
_on_samples("region_code", ["auto NR kraj", "XX kraj Košický", "Prešovský kraj", "nikde", None], X.region_of_code, f"coalesce({_case(X.REGION_CODES, chr(114) + chr(101) + 'gexp_extract(s, ' + chr(39) + '([A-ZŽ]{2}) +kraj' + chr(39) + ', 1)')}, " + ", ".join(f"case when contains(s, '{n}') then '{n}' end" for n in X.REGION_CODES.values()) + ")")
_on_samples("label_value", ["Palivo: nafta, rok 2015", "palivo - benzin  ABC", "Palivo", "x", None], lambda c: X.labelled(c, "palivo"), "nullif(trim(regexp_extract(s, '(?i)palivo[ :.\\-]*([^\\n,;]+?)(?:  |\\n|,|;|$)', 1)), '')")
_on_samples("vin_valid", ["tmbjj7ne8g0123456", "TMBJJ7NE8I0123456", "SHORT", " WVWZZZ1KZAW000001 ", None], X.vin, "case when regexp_matches(upper(trim(s)), '^[A-HJ-NPR-Z0-9]{17}$') then upper(trim(s)) end")
_on_samples("phone_extract", ["tel +421 905 123 456 volajte", "0905 123 456", "12345", None], X.phone, "nullif(left(trim(regexp_replace(regexp_extract(s, '(\\+421 ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}|\\b0[0-9]{2,3} ?[0-9]{3} ?[0-9]{3,4}\\b)', 1), ' +', ' ', 'g')), 32), '')")
STEMS = "|".join(X.PART_STEMS)
_on_samples(
    "part_classifier",
    ["Škoda Octavia 5-dverová", "Nárazník Golf", "ALU disky 5x112 R17", "BMW X3, 20\" DISKY, WEBASTO", "zimné 205/55 R16", "Renault Trafic", "Ráfiky", "", None, "Jaguar XK 4.2 X150", "Kúpim auto"],
    X.is_vehicle,
    f"case when coalesce(s, '') = '' then true when regexp_matches(strip_accents(lower(s)), '\\b[0-9]{{3}} */ *[0-9]{{2}} *r *[0-9]{{2}}\\b|\\b[456] *x *1[0-3][0-9]([.,][0-9])?\\b') or regexp_matches(strip_accents(lower(s)), '\\brafik') then false when regexp_matches(strip_accents(lower(s)), '(1[3-9]|2[0-4]) *[\"″'']? *disk') then true else not regexp_matches(strip_accents(lower(s)), '{STEMS}') end",
)
_on_samples("url_basename", ["https://a.b/x/y/photo1.JPG?w=3", "https://a.b/", "not a url", "https://a.b/img/", None], X.photo_basename, "coalesce(nullif(regexp_replace(regexp_extract(regexp_replace(regexp_extract(s, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '\\.[A-Za-z0-9]{1,5}$', ''), ''), 'no-photo')")
_on_samples("slug_title", ["https://a.b/inzerat/skoda-octavia-combi.html", "https://a.b/x/bmw-x3/", None], X.title_of_slug, "array_to_string(list_transform(string_split(regexp_replace(regexp_extract(regexp_replace(regexp_extract(s, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '\\.[a-z]+$', ''), '-'), lambda w: upper(w[1]) || w[2:]), ' ')")
_on_samples("clamp_null", ["short", "exactly ten", "x", None], lambda c: X.clamped(c, 5), "case when length(s) <= 5 then s end")


@query("fnv1a", "select s_suppkey, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(s_name, ''), lambda x: ascii(x)::bigint)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) as h, 1000000 + (list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(s_name, ''), lambda x: ascii(x)::bigint)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) & 8388607) as id from supplier")
def fnv1a(spark, d):  # noqa: ANN001, ANN201
    h = X.fnv1a(F.col("s_name"))
    return D.table(spark, d, "supplier").select("s_suppkey", h.alias("h"), (h.bitwiseAND(F.lit(8388607)) + 1000000).alias("id"))


@query("tree_country", "select n_nationkey, case when n_regionkey in (0, 1, 3) then case when n_nationkey % 5 = 0 then null else 'SK' end when n_regionkey = 2 then 'CZ' end as country, case when n_nationkey % 3 = 0 then n_name else r_name end as region from nation join region on r_regionkey = n_regionkey")
def tree_country(spark, d):  # noqa: ANN001, ANN201
    """The last ancestor names the country unless the language contradicts it; the second to last names the region."""
    rows = D.table(spark, d, "nation").join(D.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    country = F.when(F.col("n_regionkey") == 2, "CZ").when(F.col("n_regionkey") != 4, "SK").otherwise("?")
    lang = F.when((F.col("n_nationkey") % 5 == 0) & (country == "SK"), "cs").when(country == "CZ", "cs").otherwise("sk")
    alone = F.col("n_nationkey") % 3 == 0
    rows = rows.select("n_nationkey", "n_name", lang.alias("lang"), F.when(alone, F.array(country)).otherwise(F.array(F.lit("x"), F.col("r_name"), country)).alias("names"))
    last = F.element_at("names", -1)
    known = F.when((last == "SK") & (F.col("lang") == "sk"), "SK").when((last == "CZ") & (F.col("lang") == "cs"), "CZ")
    region = F.when(F.size("names") == 1, F.col("n_name")).otherwise(F.try_element_at("names", F.lit(-2)))
    return rows.select("n_nationkey", known.alias("country"), region.alias("region"))


@query("tree_region", "select n_nationkey, case when n_nationkey % 2 = 0 then r_name else n_name end as region from nation join region on r_regionkey = n_regionkey")
def tree_region(spark, d):  # noqa: ANN001, ANN201
    rows = D.table(spark, d, "nation").join(D.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    names = F.when(F.col("n_nationkey") % 2 == 0, F.array("r_name", F.lit("country"))).otherwise(F.array(F.lit("country")))
    return rows.select("n_nationkey", F.when(F.size(names) >= 2, F.element_at(names, -2)).otherwise(F.col("n_name")).alias("region"))


@query("price_choice", f"{L} select id, coalesce(case when id % 3 = 0 and price_eur > 0 then price_eur end, case when country = 'SK' then coalesce(case when id % 3 = 1 then price_eur end, price_eur + 100) end) as price from listings")
def price_choice(spark, d):  # noqa: ANN001, ANN201
    final = F.when((F.col("id") % 3 == 0) & (F.col("price_eur") > 0), F.col("price_eur"))
    asked = F.coalesce(F.when(F.col("id") % 3 == 1, F.col("price_eur")), F.col("price_eur") + 100)
    return D.listings(spark, d).select("id", F.coalesce(final, F.when(F.col("country") == "SK", asked)).alias("price"))


# --- events ---------------------------------------------------------------------------------------------------------


@query("backstop_anti", f"select c_custkey from customer where c_custkey not in (select user_id from events where ts > timestamp '{D.EVENTS_AS_OF}' - interval 44 hours)")
def backstop_anti(spark, d):  # noqa: ANN001, ANN201
    recent = D.table(spark, d, "events").where(F.col("ts") > F.lit(D.EVENTS_AS_OF).cast("timestamp_ntz") - F.expr("interval 44 hours"))
    return D.table(spark, d, "customer").join(recent, F.col("user_id") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("clock_slot", "select event_id, (floor(epoch(ts) / 3600)::bigint % 3)::int as slot from events")
def clock_slot(spark, d):  # noqa: ANN001, ANN201
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return D.table(spark, d, "events").select("event_id", F.pmod(hour, F.lit(3)).cast("int").alias("slot"))


@query("rate_window", "select user_id, epoch(time_bucket(interval 1 hour, ts))::bigint as w, count(*) as n from events group by all having count(*) > 1")
def rate_window(spark, d):  # noqa: ANN001, ANN201
    w = F.window(F.col("ts"), "1 hour")
    g = D.table(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).where("n > 1")
    return g.select("user_id", F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("w"), "n")


@query("rate_verdict", "select event_id, row_number() over (partition by user_id, epoch(time_bucket(interval 1 hour, ts)) order by ts, event_id) <= 2 as allowed from events")
def rate_verdict(spark, d):  # noqa: ANN001, ANN201
    """Whether each event is within a limit of two a user and hour; the counter starts anew with every window."""
    hour = F.window(F.col("ts"), "1 hour")
    place = F.row_number().over(W.partitionBy("user_id", hour).orderBy("ts", "event_id"))
    return D.table(spark, d, "events").select("event_id", (place <= 2).alias("allowed"))


# --- accounts -------------------------------------------------------------------------------------------------------

# fixed values: how many texts a month each plan allows; negative: any number
PLAN_LIMITS = {"FURNITURE": 0, "MACHINERY": 3, "BUILDING": 20, "HOUSEHOLD": 60, "AUTOMOBILE": -1}


@query("monthly_usage", "select user_id, count(*) as used from events where ts >= date_trunc('month', timestamp '2024-01-20') and event_type = 'purchase' group by 1")
def monthly_usage(spark, d):  # noqa: ANN001, ANN201
    start = F.date_trunc("month", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return D.table(spark, d, "events").where((F.col("ts") >= start) & (F.col("event_type") == "purchase")).groupBy("user_id").agg(F.count("*").alias("used"))


LIMIT_SQL = "case c_mktsegment " + " ".join(f"when '{k}' then {v}" for k, v in PLAN_LIMITS.items()) + " end"


@query("quota_verdict", f"with u as (select user_id, count(*) as used from events where event_type = 'purchase' group by 1) select c_custkey, {LIMIT_SQL} < 0 or coalesce(used, 0) < {LIMIT_SQL} as allowed from customer left join u on user_id = c_custkey")
def quota_verdict(spark, d):  # noqa: ANN001, ANN201
    used = D.table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("used"))
    limits = F.create_map(*[F.lit(x) for kv in PLAN_LIMITS.items() for x in kv])
    rows = D.table(spark, d, "customer").join(used, F.col("user_id") == F.col("c_custkey"), "left").withColumn("most", F.try_element_at(limits, F.col("c_mktsegment")))
    return rows.select("c_custkey", ((F.col("most") < 0) | (F.coalesce("used", F.lit(0)) < F.col("most"))).alias("allowed"))


@query("plan_rank", "select c_custkey, case c_mktsegment when 'FURNITURE' then 0 when 'MACHINERY' then 1 when 'BUILDING' then 2 when 'HOUSEHOLD' then 3 else 4 end >= 2 as includes_alerts from customer")
def plan_rank(spark, d):  # noqa: ANN001, ANN201
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(PLAN_LIMITS) for x in (k, i)])
    return D.table(spark, d, "customer").select("c_custkey", (F.try_element_at(ranks, F.col("c_mktsegment")) >= 2).alias("includes_alerts"))


@query("user_lists", "select c_custkey, o_orderkey, n_name from customer join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey and o_orderstatus = 'O'")
def user_lists(spark, d):  # noqa: ANN001, ANN201
    rows = D.table(spark, d, "customer").join(D.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = D.table(spark, d, "orders").where("o_orderstatus = 'O'")
    return rows.join(own, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey", "n_name")


@query("latest_event", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def latest_event(spark, d):  # noqa: ANN001, ANN201
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return D.table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_type", "event_id")
