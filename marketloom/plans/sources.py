"""Queries of page parsers and stateful replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vehicles as V
from ..operators import lifecycle as M
from ..operators import minting as N
from ..operators import numbering as O
from ..sources import cards as C
from ..sources import details as T
from ..sources import pages as S
from ..sources import registry as R
from ..streaming import events as E
from ..streaming import rates as L
from . import domain as D
from .registry import query


def text_of(*parts) -> Column:  # noqa: ANN002
    """Literals and columns as one text; nulls are empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


#: The three layouts, on hosts that do not exist.
FLAT = R.FlatSource("flat", C.Flat("flat", "https://flat.example"), T.Prose("img\\.example\\.com/"))
WRAPPED = R.WrappedSource("wrapped", C.Wrapped("wrapped", "https://wrapped.example", r"wrapped\.example"), T.Sheet("img\\.example\\.com", "cars\\.example"))
EMBEDDED = R.EmbeddedSource("embedded", C.Embedded("embedded", "https://embedded.example"), T.Record("data", ["$.props.advert", "$.props.record"]))
SOURCES = R.Sources(FLAT, WRAPPED, EMBEDDED)

PAGE_ID = "id div 1000000000000"


def fuel_word() -> Column:
    return F.when(F.col("fuel") == "diesel", "nafta").when(F.col("fuel") == "gasoline", "benzín")


def gear_word() -> Column:
    return F.when(F.col("gearbox") == "manual", "manuálna").otherwise("automat")


def _paged(spark, d, card: Column, head: str, tail: str) -> DataFrame:  # noqa: ANN001
    """List pages made of all adverts, one page for each order, so of seven cards or so."""
    rows = D.listings(spark, d).select(F.expr(PAGE_ID).alias("page_id"), F.struct("id", card.alias("card")).alias("x"))
    cards = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["card"]), "\n")
    return rows.groupBy("page_id").agg(F.concat(F.lit(head), cards, F.lit(tail)).alias("html"))


def flat_pages(spark, d) -> DataFrame:  # noqa: ANN001
    """Cards flow without a wrapper; blocks nest; each page ends with another advert's price in its footer."""
    c = F.col
    price = F.when(c("price_eur").isNotNull(), text_of(F.floor("price_eur").cast("bigint"), " €")).otherwise(F.lit("Dohodou"))
    card = text_of(
        '<div class="x inzeratynadpis"><a href="/inzerat/', c("id"), '/auto.php"><img class="obrazek" src="https://img.example.com/', c("id"), '.jpg" alt="foto"></a></div><h2 class="nadpis"><a>', c("make"), " <b>", c("model"), "</b></a></h2>",
        '<div class="popis">[20.5. 2025] <div>r.v.: 3/', c("year"), "</div> <span>najazdené ", c("mileage_km"), " km</span>, ", fuel_word(), ", ", gear_word(), '</div><div class="inzeratycena"><b><span translate="no">', price,
        '</span></b></div><span class="velikost10">', F.when(c("id") % 3 == 0, text_of(c("id") % 2000, " ×")).otherwise(F.lit("Nitra")), '</span><b class="', F.when(c("is_featured"), "toplogo").otherwise("logo"), '">TOP</b> tel. 0901 234 ', F.lpad((c("id") % 1000).cast("string"), 3, "0"),
    )
    return _paged(spark, d, card, '<html><body><div class="main">', '</div><div class="inzeratycena">1 €</div><footer>Cena 77 € 0900 111 222</footer></body></html>')


def wrapped_pages(spark, d) -> DataFrame:  # noqa: ANN001
    """Each advert in nested wrappers; titles in an attribute, the link, an image or the address; equipment behind the price."""
    c = F.col
    price = F.when(c("price_eur").isNotNull(), text_of(F.floor("price_eur").cast("bigint"), " €")).otherwise(F.lit("dohodou"))
    name = text_of(c("make"), " ", c("model"))
    link = text_of('<a href="', F.when(c("id") % 2 == 0, "https://www.wrapped.example"), "/", c("id"), '/skoda-octavia-2015/"', F.when(c("id") % 4 == 0, text_of(' title="', name, '"')), ">", F.when(c("id") % 4 == 1, name), "</a>", F.when(c("id") % 4 == 2, text_of('<img alt=" ', name, ' ">')))  # between blocks stands a line end, as pages have it
    card = text_of('<li class="box"><div class="item', F.when(c("is_featured"), " vip"), '"><p>', link, "</p>\n<div>", c("year"), " · ", gear_word(), " · ", c("mileage_km"), " km · ", fuel_word(), " · NR kraj</div>\n<div>", price, "</div>\n<ul><li>manuálna klimatizácia</li><li>hybrid</ul></div></li>")
    return _paged(spark, d, card, '<html><body><ul class="list">', '</ul><a href="/o-nas/">O nás</a><p>2001, 1 km 5 €</p></body></html>')


def embedded_pages(spark, d) -> DataFrame:  # noqa: ANN001
    """A page's adverts as JSON, by the query's path or by another; every thirteenth page's JSON is broken, others have none."""
    c = F.col
    at_home = c("country") == "SK"
    place = F.struct(c("region").alias("name"), F.array(F.lit("1"), F.when(at_home, "100000000").when(c("country") == "CZ", "200000000").otherwise("300000000")).alias("parents"), F.when(at_home, "sk").when(c("country") == "CZ", "cs").alias("defaultLang"))
    row = F.struct(
        c("id"), F.struct(c("id").cast("string").alias("id"), c("raw_title").alias("title"), c("make").alias("brandValue"), c("model").alias("carModelValue"), F.when(c("id") % 3 == 0, c("price_eur")).otherwise(0).alias("finalPrice"), c("price_eur").alias("price"),
        c("year"), c("mileage_km").alias("mileage"), F.initcap(fuel_word()).alias("fuelValue"), F.initcap(gear_word()).alias("gearboxValue"), (c("id") % 50).alias("views"), c("is_featured").alias("isPremium"), place.alias("location")).alias("r"),
    )
    pages = D.listings(spark, d).select(F.expr(PAGE_ID).alias("page_id"), row.alias("x")).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("rs"))
    k = c("page_id") % 13
    rs = F.to_json("rs")
    body = F.when(k < 5, text_of('{"props":{"pageProps":{"trpcState":{"queries":[{"state":{"data":null}},{"state":{"data":{"data":', rs, "}}}]}}}}")).when(k < 9, text_of('{"props":{"pageProps":{"searchRecords":{"data":', rs, "}}}}")).when(k < 12, text_of('{"props":{"pageProps":{"searchRecords":', rs, "}}}"))
    body = F.when(k == 12, "{broken").otherwise(body)
    return pages.select("page_id", text_of('<html><script id="__NEXT_DATA__" type="application/json">', body, "</script></html>").alias("html"))


ORDINAL_SQL = "row_number() over (partition by id // 1000000000000 order by id) - 1"
# an id given twice counts once, for the card that stands first
ONCE_SQL = "(select * from listings qualify row_number() over (partition by id order by {}) = 1)"
FLAT_SQL = f"""select id // 1000000000000 as page_id, {ORDINAL_SQL} as ordinal, 'flat' as source, id::varchar as source_id, 'https://flat.example/inzerat/' || id || '/auto.php' as url, make || ' ' || model as raw_title,
  case when floor(price_eur) >= 100 then floor(price_eur)::bigint end as price_eur, coalesce(case when year between 1980 and 2026 then year end, case when mileage_km between 1980 and 2024 then mileage_km end) as year, case when mileage_km between 100 and 1999999 then mileage_km end as mileage_km, fuel, gearbox, null as region, 'SK' as country, null as locality,
  'https://img.example.com/' || id || '.jpg' as thumbnail, case when id % 3 = 0 then id % 2000 end as view_count, case when is_featured then true end as is_featured, '0901 234 ' || lpad((id % 1000)::varchar, 3, '0') as seller_phone from {ONCE_SQL.format("year, mileage_km || ' '")}"""
WRAPPED_SQL = f"""select id // 1000000000000 as page_id, {ORDINAL_SQL} as ordinal, 'wrapped' as source, id::varchar as source_id, 'https://wrapped.example/' || id || '/skoda-octavia-2015/' as url, case when id % 4 = 3 then 'Skoda Octavia 2015' else make || ' ' || model end as raw_title,
  case when floor(price_eur) >= 100 then floor(price_eur)::bigint end as price_eur, 
  -- where no year is plausible, another number of the same look is taken for one, also the price's
  coalesce(case when year between 1980 and 2026 then year end, case when mileage_km between 1980 and 2026 then mileage_km end, case when floor(price_eur) between 1980 and 2026 then floor(price_eur)::bigint end) as year, case when mileage_km between 10 and 1999999 then mileage_km end as mileage_km,
  -- without a price nothing parts the equipment from the rest
  case when price_eur is null then coalesce(fuel, 'hybrid') else fuel end as fuel, case when price_eur is null then 'manual' else gearbox end as gearbox, 'SK-Nitriansky' as region, 'SK' as country, null as locality,
  null as thumbnail, null::bigint as view_count, case when is_featured then true end as is_featured, null as seller_phone from {ONCE_SQL.format("is_featured desc, year, mileage_km || ' '")}"""
EMBEDDED_SQL = f"""select id // 1000000000000 as page_id, {ORDINAL_SQL} as ordinal, 'embedded' as source, id::varchar as source_id, 'https://embedded.example/detail/x/' || id || '/' as url, raw_title,
  case when price_eur > 0 and (id % 3 = 0 or country = 'SK') then floor(price_eur + 0.5)::bigint end as price_eur, year, mileage_km, fuel, gearbox, country || '-' || region as region, country, region as locality,
  null as thumbnail, id % 50 as view_count, case when is_featured then true end as is_featured, null as seller_phone from {ONCE_SQL.format('raw_title')} where (id // 1000000000000) % 13 <> 12"""
SHOWN = [c for c in C.OBSERVATION if c not in ("make", "model")]


@query("parse_list_cards", f"with {D.LISTINGS_SQL} {FLAT_SQL}")
def parse_list_cards(spark, d):  # noqa: ANN001, ANN201
    return FLAT.parse_list(flat_pages(spark, d), D.NEXT_YEAR).select(*SHOWN)


@query("parse_list_cards_b", f"with {D.LISTINGS_SQL} {WRAPPED_SQL}")
def parse_list_cards_b(spark, d):  # noqa: ANN001, ANN201
    return WRAPPED.parse_list(wrapped_pages(spark, d), D.NEXT_YEAR).select(*SHOWN)


@query("parse_record_list", f"with {D.LISTINGS_SQL} {EMBEDDED_SQL}")
def parse_record_list(spark, d):  # noqa: ANN001, ANN201
    return EMBEDDED.parse_list(embedded_pages(spark, d), D.NEXT_YEAR).select(*SHOWN)


@query("source_registry", f"with {D.LISTINGS_SQL}, u as ({FLAT_SQL} union all {WRAPPED_SQL} union all {EMBEDDED_SQL}) select source, count(*) as adverts, count(distinct page_id) as pages, count(price_eur) as priced, sum(price_eur)::bigint as prices, count(region) as placed from u group by source")
def source_registry(spark, d):  # noqa: ANN001, ANN201
    """Pages of three sources in one table, each read by the parser of its name."""
    made = [(FLAT, flat_pages), (WRAPPED, wrapped_pages), (EMBEDDED, embedded_pages)]
    pages = [make(spark, d).withColumn("source", F.lit(s.name)) for s, make in made]
    rows = SOURCES.parse_lists(pages[0].unionByName(pages[1]).unionByName(pages[2]), D.NEXT_YEAR)
    return rows.groupBy("source").agg(F.count("*").alias("adverts"), F.countDistinct("page_id").alias("pages"), F.count("price_eur").alias("priced"), F.sum("price_eur").alias("prices"), F.count("region").alias("placed"))


@query("page_elements", r"""select page_id, len(regexp_extract_all(html, '(?i)<p[\s>]')) as paragraphs, len(regexp_extract_all(html, '(?i)<a[\s>]')) as links, len(regexp_extract_all(html, '(?i)<li[\s>]')) as items from pages""".replace("\\\\", "\\"))
def page_elements(spark, d):  # noqa: ANN001, ANN201
    """All pages through the table function, in SQL."""
    R.register(spark)
    return spark.sql(
        "select p.page_id, count_if(e.tag = 'p') as paragraphs, count_if(e.tag = 'a') as links, count_if(e.tag = 'li') as items from {pages} p, lateral page_elements(p.html) e group by p.page_id",
        pages=D.table(spark, d, "pages"),
    )


@query("parse_embedded_json", "select event_id, props->>'$.k' as k from events")
def parse_embedded_json(spark, d):  # noqa: ANN001, ANN201
    page = F.concat(F.lit('<html><script id="data" type="application/json">'), "props", F.lit("</script></html>"))
    return D.table(spark, d, "events").select("event_id", S.embedded_json(page, "data", ["$.missing.k", "$.k"]).alias("k"))


@query("parse_detail", "select page_id, nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') as title, nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '') as heading, regexp_extract(html, '(?i)<html[^>]*lang=\"([a-z-]+)\"', 1) as language, len(regexp_extract_all(html, '<p>')) as paragraphs from pages")
def parse_detail(spark, d):  # noqa: ANN001, ANN201
    parts = S.detail(F.col("html"))
    return D.table(spark, d, "pages").select("page_id", *[parts[k].alias(k) for k in ("title", "heading", "language", "paragraphs")])


@query("parse_sitemap", "select page_id, url as loc, 2 as images from pages")
def parse_sitemap(spark, d):  # noqa: ANN001, ANN201
    address = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    xml = F.concat(F.lit("<urlset><url><loc> "), address, F.lit(" </loc><image:loc>a&amp;b</image:loc><image:loc>c</image:loc></url></urlset>"))
    rows = D.table(spark, d, "pages").select("page_id", F.explode(S.sitemap(xml)).alias("e"))
    return rows.select("page_id", F.col("e.loc").alias("loc"), F.size("e.images").alias("images"))


@query("robots_match", "select page_id, case when regexp_matches(p, '^/en/.*\\.html$') then true when regexp_matches(p, '^/en') then false else true end as allowed from (select page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) as p from pages)")
def robots_match(spark, d):  # noqa: ANN001, ANN201
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    return D.table(spark, d, "pages").select("page_id", S.robots_allowed(path, ["/en/*.html$"], ["/en"]).alias("allowed"))


@query("page_outcome", "select c_custkey, case when s = 404 then 'end' when s >= 400 then 'failed' when n = 0 and k + 1 >= 3 then 'end' when n = 0 then 'empty' else 'ok' end as outcome from (select c_custkey, 200 + c_custkey % 3 * 102 as s, c_custkey % 4 as n, c_custkey % 5 as k from customer)")
def page_outcome(spark, d):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    return D.table(spark, d, "customer").select("c_custkey", S.outcome(k % 3 * 102 + 200, k % 4, k % 5).alias("outcome"))


MAKE_SQL = "(case p_partkey % 5 when 0 then 'Predám VW Golf 1.6 TDI' when 1 then 'Mercedes C 220' when 2 then 'Ľavé dvere Land Rover Discovery Sport' when 3 then 'Škoda Octavia Combi 2.0' else 'Predám ' || p_brand || ' ' || p_type || ' 2.0 TDI' end)"


@query("make_model", """select p_partkey, case p_partkey % 5 when 0 then 'volkswagen' when 1 then 'mercedes-benz' when 2 then 'land-rover' when 3 then 'skoda' else lower(replace(p_brand, '#', '-')) end as make,
  case p_partkey % 5 when 0 then 'golf' when 1 then null when 2 then 'discovery-sport' when 3 then 'octavia-combi' else case when p_type = 'PROMO' then null else lower(p_type) end end as model from part""")
def make_model(spark, d):  # noqa: ANN001, ANN201
    brands = {f"brand-{k}": ["economy", "small", "medium", "standard", "large"] for k in range(26)}
    brands |= {"volkswagen": ["golf", "passat"], "mercedes-benz": ["c-class"], "land-rover": ["discovery", "discovery-sport"], "rover": ["75"], "skoda": ["octavia", "octavia-combi"]}
    rows = D.table(spark, d, "part").select("p_partkey", F.expr(MAKE_SQL).alias("title"))
    return V.make_model(rows, brands).select("p_partkey", "make", "model")


@query("year_label", """with t as (select c_custkey, c_custkey % 8 as v, 1980 + c_custkey % 46 as y from customer)
select c_custkey, case v when 0 then 2000 + c_custkey % 27 when 1 then null when 7 then case when y - 5 >= 1980 then y - 5 end else y end as year from t""")
def year_label(spark, d):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    year, two = (k % 46 + 1980).cast("string"), F.lpad((k % 27).cast("string"), 2, "0")
    texts = [
        F.concat(F.lit("1598cm3, r.v.: "), (k % 12 + 1).cast("string"), F.lit("/"), two, F.lit(", objem 1598cm³, 85kW")), F.lit("r.v.: 17/23"), F.concat(F.lit("MODEL "), year), F.concat(F.lit("Malé mestské auto, rocnik "), year, F.lit(", trojdverové")),
        F.concat(F.lit("Prvá evidencia "), year), F.concat(F.lit("1. evidencia: 9/"), year), F.concat(F.lit("★Rok výroby: 7.31."), year), F.lit("servisné intervaly, Objem: 1998cm³"),
    ]
    text = F.get(F.array(*texts), (k % 8).cast("int"))
    title = F.when(k % 8 == 7, F.concat(F.lit("Auto "), (k % 46 + 1975).cast("string")))
    return D.table(spark, d, "customer").select("c_custkey", V.labelled_year(text, title, D.NEXT_YEAR).cast("long").alias("year"))


@query("km_label", """select c_custkey, case c_custkey % 7 when 0 then 1000 + c_custkey when 1 then (1 + c_custkey % 100) * 1000 when 2 then 100000 + c_custkey when 3 then 1000 + c_custkey when 4 then 201300 when 5 then null else (1 + c_custkey % 100) * 1000 end as km from customer""")
def km_label(spark, d):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    plain, few = (k + 1000).cast("string"), (k % 100 + 1).cast("string")
    texts = [
        F.concat(F.lit("Najazdené: "), plain, F.lit(" km")), F.concat(F.lit("Rok vyroby - 2015 Najazdenych - "), few, F.lit(" tisic km")), F.concat(F.lit("výkon 66 kW ★ "), F.replace(F.format_number(k + 100000, 0), F.lit(","), F.lit(" ")), F.lit(" km")),
        F.concat(F.lit("RV:6/2014 KW:103 KM:"), plain, F.lit(" klíma")), F.lit("ROK 2013 201 300 KM 110 KW"), F.lit("spotreba okolo 6.1 lit. /100 km"), F.concat(F.lit("rv. 08/2011, najazdené "), few, F.lit("tis. km")),
    ]
    return D.table(spark, d, "customer").select("c_custkey", V.odometer(F.get(F.array(*texts), (k % 7).cast("int"))).alias("km"))


@query("locality", "select n_nationkey, case when n_nationkey % 4 = 0 then 'Nemecko' else n_name end as locality, n_nationkey % 4 = 0 as abroad from nation")
def locality(spark, d):  # noqa: ANN001, ANN201
    place = F.when(F.col("n_nationkey") % 4 == 0, "Nemecko").otherwise(F.col("n_name"))
    parts = V.locality(F.concat(F.lit("Predám auto. Lokalita: "), place, F.lit(", cena 5000")))
    return D.table(spark, d, "nation").select("n_nationkey", parts["locality"].alias("locality"), parts["abroad"].alias("abroad"))


CURSOR_SQL = """with recursive r as (select 's' || (user_id % 20) as source, (event_id % 90 + 1)::int as last_page, event_id % 97 = 0 as finished, event_type = 'error' as failed, row_number() over (partition by user_id % 20 order by event_id) as k from events),
 w as (select source, 0::bigint as k, 1 as next_page, null::int as max_known, 0 as cycle, 0 as failures from (select distinct source from r)
  union all select w.source, r.k, case when not failed then case when finished or last_page + 1 > 80 then 1 else last_page + 1 end when failures + 1 >= 3 then greatest(next_page, last_page) + 1 else next_page end,
   case when finished and not failed then greatest(1, last_page) else max_known end, cycle + case when not failed and (finished or last_page + 1 > 80) then 1 else 0 end, case when failed and failures + 1 < 3 then failures + 1 else 0 end
  from w join r on r.source = w.source and r.k = w.k + 1)
 select source, next_page, 80 as page_space, max_known, cycle, failures from w qualify row_number() over (partition by source order by k desc) = 1"""


@query("cursor_next", CURSOR_SQL)
def cursor_next(spark, d):  # noqa: ANN001, ANN201
    k = F.col("event_id")
    runs = D.table(spark, d, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("source"), k.alias("run_id"), (k % 90 + 1).cast("int").alias("last_page"), (k % 97 == 0).alias("end"), (F.col("event_type") == "error").alias("failed")
    )
    return E.replay_cursors(runs, 80)


# --- state and order ------------------------------------------------------------------------------------------------

FIRST_HIT_SQL = """with recursive e as (select event_id, user_id % 300 as who, ts from events), w as (select who, min(ts) as opened from e group by who
  union all select w.who, min(e.ts) from w join e on e.who = w.who and e.ts >= w.opened + interval 6 hours group by w.who, w.opened),
 placed as (select e.event_id, max(w.opened) as opened from e join w on w.who = e.who and w.opened <= e.ts group by e.event_id)
 select event_id, row_number() over (partition by who, opened order by ts, event_id) <= 2 as allowed, greatest(0, 2 - row_number() over (partition by who, opened order by ts, event_id))::int as remaining, floor(epoch(opened))::bigint as opened
 from placed join e using (event_id)"""


@query("rate_first_hit", FIRST_HIT_SQL)
def rate_first_hit(spark, d):  # noqa: ANN001, ANN201
    """Two events in six hours for each of 300 keys, windows opening at the first."""
    hits = D.table(spark, d, "events").select("event_id", (F.col("user_id") % 300).alias("who"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    rows = L.first_hit_verdicts(hits, "who", "ts", "event_id", 2, 6 * 3600)
    return rows.select("event_id", "allowed", "remaining", F.unix_seconds(F.col("window_start").cast("timestamp")).alias("opened"))


@query("every_nth", f"with {D.LISTINGS_SQL} select id from (select id, row_number() over (order by id) as k from listings) where k % 7 = 1")
def every_nth(spark, d):  # noqa: ANN001, ANN201
    """Every seventh of all adverts."""
    return O.every_nth(D.listings(spark, d).select("id"), 7, "id")


MINT_SPACE = 8191


def _minted_sql() -> str:
    """Five attempts, each as three named steps."""
    start = "list_prepend(2166136261::bigint, list_transform(string_split(name || '-{k}', ''), lambda x: ascii(x)::bigint))"
    place = f"1000000 + (list_reduce({start}, lambda h, x: (xor(h, x) * 16777619) & 4294967295) & {MINT_SPACE})"
    steps = ["names as (select distinct p_brand || '-' || p_partkey as name from part)", "t0 as (select 1000000 + p_partkey * 3 as id from part where p_partkey <= 1000 or p_size < 5)", "p0 as (select name from names)"]
    for k in range(5):
        steps += [f"c{k} as (select name, {place.format(k=k)} as id from p{k})", f"w{k} as (select min(name) as name, id from c{k} where id not in (select id from t{k}) group by id)", f"t{k + 1} as (select id from t{k} union select id from w{k})", f"p{k + 1} as (select name from p{k} where name not in (select name from w{k}))"]
    return f"with {', '.join(steps)} select name, id::bigint as id from (" + " union all ".join(f"select name, id from w{k}" for k in range(5)) + ") union all select name, null from p5"


@query("minted_ids", _minted_sql())
def minted_ids(spark, d):  # noqa: ANN001, ANN201
    """Ids for all parts' names in a space so small that most collide and some find no place."""
    part = D.table(spark, d, "part")
    taken = part.where("p_partkey <= 1000 or p_size < 5").select(F.lit("taken").alias("name"), (F.col("p_partkey") * 3 + 1_000_000).alias("id"))
    return N.mint_ids(part.select(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("name")), taken, space=MINT_SPACE)


TYPES = ["economy", "small", "medium", "standard", "large"]
NAME_SQL = "lower(replace(make, '#', '-')) || '-' || lower(model)"
KNOWN_SQL = f"({NAME_SQL} in (select 'brand-' || k || '-' || t from range(0, 26, 2) b(k), (values {', '.join(f"('{t}')" for t in TYPES)}) m(t)))"
HASH_SQL = f"1000000 + (list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({NAME_SQL} || '-0', ''), lambda x: ascii(x)::bigint)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) & 8388607)"


@query("backfill_models", f"""with {D.LISTINGS_SQL} select id, case when id % 3 > 0 then model_id when not ({D.ACTIVE_SQL}) or model = 'PROMO' then null
 when {KNOWN_SQL} then ('0x' || left(md5({NAME_SQL}), 5))::bigint else {HASH_SQL} end as model_id, is_vehicle from listings""")
def backfill_models(spark, d):  # noqa: ANN001, ANN201
    """A third of all adverts lack a model; brands of even numbers are in the catalogue, ids of the others are minted."""
    brands = {f"brand-{k}": TYPES for k in range(26)}
    names = [(f"brand-{k}-{t}",) for k in range(0, 26, 2) for t in TYPES]
    catalogue = spark.createDataFrame(names, "name string").select("name", F.conv(F.substring(F.md5("name"), 1, 5), 16, 10).cast("long").alias("id"))
    rows = D.listings(spark, d).withColumn("model_id", F.when(F.col("id") % 3 > 0, F.col("model_id")).cast("long"))
    return M.backfill_models(rows, brands, catalogue).select("id", "model_id", "is_vehicle")


@query("flag_parts", f"with {D.LISTINGS_SQL} select id, is_vehicle and id % 5 > 1 as is_vehicle from listings")
def flag_parts(spark, d):  # noqa: ANN001, ANN201
    """Two in five titles are made those of parts; adverts that are no vehicles already stay so."""
    part = F.when(F.col("id") % 5 == 0, text_of("Nárazník ", F.col("raw_title"))).when(F.col("id") % 5 == 1, text_of("Zimné 205/55 R16 ", F.col("raw_title")))
    titled = D.listings(spark, d).withColumn("raw_title", F.coalesce(part, F.col("raw_title")))
    return M.flag_parts(titled).select("id", "is_vehicle")
