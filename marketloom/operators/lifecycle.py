"""Re-observed rows, liveness, sales and daily prices: every step yields the next full version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.predicates import active
from ..functions.text import is_vehicle
from ..functions.vehicles import make_model
from .minting import mint_ids

#: Facts that keep their old value where the new one is missing.
KEEP_OLD = ["year", "mileage_km", "fuel", "gearbox", "region", "country", "locality", "model_id", "raw_title", "view_count"]
#: What a re-read replaces whatever it says.
OVERWRITE = ["price_eur", "url", "raw_json"]
#: What the first reading settles.
KEEP_FIRST = ["fingerprint", "seller_phone"]


def keep_first(batch: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key in the batch's own order."""
    w = W.partitionBy(*keys).orderBy(ordinal)
    return batch.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def merge_observations(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The next version of the advert table, keyed by (source, source_id), with ``change`` (added, updated, same).

    Incoming prices, addresses and raw records win even when missing; facts keep their old value where the new one is
    missing; fingerprint and phone stay as first read; featured is sticky; first evidence of life is kept; a first insert
    has no evidence of life yet and a price check only if priced.
    """
    key = ["source", "source_id"]
    cols = [*KEEP_OLD, *OVERWRITE, *KEEP_FIRST, "is_featured"]
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in cols], F.col("first_seen_alive_at").alias("o_alive"), F.col("price_checked_at").alias("o_checked"), F.col("last_seen_at").alias("o_last"), F.lit(True).alias("in_old"))
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("in_new"))
    j = o.join(n, key, "full_outer")
    both, added = F.col("in_old").isNotNull() & F.col("in_new").isNotNull(), F.col("in_old").isNull()
    out = [F.when(F.col("in_new").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in OVERWRITE]
    out += [F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in KEEP_OLD]
    out += [
        (F.coalesce("o_is_featured", F.lit(False)) | F.coalesce("n_is_featured", F.lit(False))).alias("is_featured"),
        *[F.coalesce(f"o_{c}", f"n_{c}").alias(c) for c in KEEP_FIRST],
        F.when(both, F.coalesce(F.col("o_alive"), now)).otherwise(F.col("o_alive")).alias("first_seen_alive_at"),
        F.when(both, now).when(added, F.when(F.col("n_price_eur").isNotNull(), now)).otherwise(F.col("o_checked")).alias("price_checked_at"),
        F.when(F.col("in_new").isNotNull(), now).otherwise(F.col("o_last")).alias("last_seen_at"),
        F.when(added, "added").when(both, "updated").otherwise("same").alias("change"),
    ]
    return j.select(*key, *out)


#: What a detail page fills in where the advert has nothing.
DETAIL_FILLS = ["year", "mileage_km", "fuel", "gearbox", "model_id", "raw_title", "price_eur", "locality"]

#: Answers that say an advert's page is gone: also a refusal or being sent elsewhere.
GONE_PAGE = [301, 302, 303, 307, 308, 403, 404, 410]
GONE_MARK = "[GONE]"


def merge_details(listings: DataFrame, details: DataFrame, now: Column) -> DataFrame:
    """Adverts with what their detail pages say (``details``: id, the columns above, region, country, abroad; at most one row an id).

    Facts only fill gaps. A region also replaces one of another market, which its first two letters name. A page that
    says the car is abroad clears the country, the only fact that is overwritten; else its country fills a gap. A price
    read there counts as a check if there was none.
    """
    d = details.select(F.col("id").alias("d_id"), *[F.col(c).alias(f"d_{c}") for c in [*DETAIL_FILLS, "region", "country", "abroad"]])
    other_market = F.col("region").isNull() | (F.substring("region", 1, 2) != F.substring("d_region", 1, 2))
    out = listings.join(d, F.col("id") == F.col("d_id"), "left").withColumns({
        "region": F.when(F.col("d_region").isNotNull() & other_market, F.col("d_region")).otherwise(F.col("region")),
        "country": F.when(~F.coalesce("d_abroad", F.lit(False)), F.coalesce("country", "d_country")),
        "price_checked_at": F.when(F.col("d_price_eur").isNotNull(), F.coalesce(F.col("price_checked_at"), now)).otherwise(F.col("price_checked_at")),
        **{c: F.coalesce(c, f"d_{c}") for c in DETAIL_FILLS},
    })
    return out.select(*listings.columns)


def append_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def replace_children(old: DataFrame, new: DataFrame, parent: str, position: str, most: int = 100, url_length: int = 2000) -> DataFrame:
    """All children of re-read parents replaced. Addresses are cut to ``url_length``, places beyond ``most`` are refused; a parent of which nothing new stays keeps its old children."""
    fresh = new.where(F.col(position) <= most).withColumn("url", F.substring("url", 1, url_length))
    return old.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def upsert_details(old: DataFrame, read: DataFrame, statuses: DataFrame, now: Column) -> DataFrame:
    """Detail rows after a round of reading: a page that was read replaces the whole row, nulls included; a page found gone leaves the row there is, or else a marked one.

    ``old`` and ``read`` have listing_id (once each), description and the same facts; ``statuses`` (id, status) what the
    server said. A page with both was gone: its facts are not taken.
    """
    gone = statuses.where(F.col("status").isin(GONE_PAGE)).select(F.col("id").alias("listing_id")).distinct()
    taken = read.join(gone, "listing_id", "left_anti").withColumn("detailed_at", now)
    kept = old.join(taken.select("listing_id"), "listing_id", "left_anti")
    kind = {f.name: f.dataType for f in old.schema.fields}
    blank = {c: F.lit(None).cast(t) for c, t in kind.items()} | {"listing_id": F.col("listing_id"), "description": F.lit(GONE_MARK), "detailed_at": now.cast(kind["detailed_at"])}
    marked = append_absent(old, gone, ["listing_id"]).select(*[blank[c].alias(c) for c in old.columns])
    return kept.unionByName(taken.select(*[F.col(c).cast(t).alias(c) for c, t in kind.items()])).unionByName(marked)


def apply_liveness(listings: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """404 and 410 remove; 2xx and 3xx prove life; anything else tells nothing."""
    j = listings.join(checks, "id", "left")
    gone, alive = F.col("status").isin(404, 410), F.col("status").between(200, 399)
    return j.withColumns({
        "removed_at": F.when(gone, F.coalesce(F.col("removed_at"), now)).otherwise(F.col("removed_at")),
        "last_seen_at": F.when(alive, now).otherwise(F.col("last_seen_at")),
        "first_seen_alive_at": F.when(alive, F.coalesce(F.col("first_seen_alive_at"), now)).otherwise(F.col("first_seen_alive_at")),
    }).drop("status")


def tombstones(details: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """Marked detail rows (listing_id, detailed_at, description) of adverts found gone that have none: they are not asked for again."""
    gone = checks.where(F.col("status").isin(GONE_PAGE)).select(F.col("id").alias("listing_id"), now.alias("detailed_at"), F.lit(GONE_MARK).alias("description")).distinct()
    return append_absent(details, gone, ["listing_id"])


MODES = ("unenriched", "unenriched-newest", "null-description", "null-price", "null-model", "null-locality", "null-country")


def worklist(listings: DataFrame, details: DataFrame, mode: str, size: int, source: str | None = None, after_id: int | None = None, share: tuple[int, int] | None = None) -> DataFrame:
    """The next ``size`` adverts whose detail page is to be read.

    ``unenriched``: no detail row, lowest id first; ``unenriched-newest``: the same, newest first. The other modes take
    active adverts beyond ``after_id`` that lack a fact; ``null-description`` those whose detail row (``details``:
    listing_id, description) has no description. ``share`` (index, number) splits the work among callers by id.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    rows = listings if source is None else listings.where(F.col("source") == source)
    if share:
        rows = rows.where(F.col("id") % share[1] == share[0])
    known = details.select(F.col("listing_id").alias("_d"), "description")
    if mode.startswith("unenriched"):
        rows = rows.join(known, F.col("id") == F.col("_d"), "left_anti")
    else:
        rows = rows.where(active())
        if after_id is not None:
            rows = rows.where(F.col("id") > after_id)
        if mode == "null-description":
            rows = rows.join(known.where("description is null"), F.col("id") == F.col("_d"), "left_semi")
        else:
            lacks = {"null-price": "price_eur", "null-model": "model_id", "null-locality": "locality", "null-country": "country"}
            rows = rows.where(F.col(lacks[mode]).isNull())
    return rows.orderBy(*([F.desc("first_seen_at"), "id"] if mode == "unenriched-newest" else ["id"])).limit(size)


def detect_sold(listings: DataFrame, days: int = 30) -> DataFrame:
    """Removed, canonical adverts with a fingerprint and evidence of life, not listed again in time: sold at removal."""
    gone = listings.where("removed_at is not null and sold_at is null and canonical_listing_id is null and fingerprint is not null and first_seen_alive_at is not null")
    again = listings.where("fingerprint is not null").select(F.col("id").alias("a_id"), F.col("fingerprint").alias("a_fp"), F.col("source").alias("a_source"), F.col("first_seen_at").alias("a_seen"))
    span = F.expr(f"interval {days} days")
    relisted = (
        (F.col("fingerprint") == F.col("a_fp")) & (F.col("source") == F.col("a_source")) & (F.col("id") != F.col("a_id"))
        & (F.col("a_seen") > F.col("first_seen_at")) & F.col("a_seen").between(F.col("removed_at") - span, F.col("removed_at") + span)
    )
    return gone.join(again, relisted, "left_anti").select("id", "source", F.col("removed_at").alias("sold_at"))


def daily_prices(listings: DataFrame, history: DataFrame, day: Column, days: int = 7) -> DataFrame:
    """Today's prices of adverts truly read within a week, where today has none yet."""
    fresh = listings.where(F.col("price_eur").isNotNull() & F.col("removed_at").isNull() & (F.col("price_checked_at") >= day - F.expr(f"interval {days} days")))
    rows = fresh.select(F.col("id").alias("listing_id"), F.to_date(day).alias("recorded_on"), "price_eur")
    return append_absent(history, rows, ["listing_id", "recorded_on"])


def backfill_models(listings: DataFrame, brands: dict[str, list[str]], catalogue: DataFrame, attempts: int = 5) -> DataFrame:
    """``listings`` with a model where they have none and their stored title names one.

    Only active adverts are filled, and no model is ever overwritten. Brand and model of the title become the catalogue's
    id for "brand-model" (``catalogue``: name, id), or one minted for it; a title without a known model fills nothing.
    """
    blank = F.col("model_id").isNull() & F.col("raw_title").isNotNull() & active()
    titles = make_model(listings.where(blank).select("raw_title").distinct(), brands, "raw_title").where("model is not null")
    named = titles.select("raw_title", F.concat_ws("-", "make", "model").alias("name"))
    ids = mint_ids(named.select("name"), catalogue, attempts).select("name", F.col("id").alias("_model"))
    found = named.join(ids, "name").select(F.col("raw_title").alias("_title"), "_model")
    out = listings.join(found, blank & (F.col("raw_title") == F.col("_title")), "left")
    kind = listings.schema["model_id"].dataType
    return out.withColumn("model_id", F.coalesce("model_id", F.col("_model").cast(kind))).select(*listings.columns)


def flag_parts(listings: DataFrame) -> DataFrame:
    """``listings`` with is_vehicle false where the stored title is one of a part. No advert is made a vehicle again, so corrections by hand stay."""
    return listings.withColumn("is_vehicle", F.when(F.col("is_vehicle") & F.col("raw_title").isNotNull(), is_vehicle(F.col("raw_title"))).otherwise(F.col("is_vehicle")))
