"""Fingerprints and repost clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.buckets import mileage_floor
from ..functions.text import folded, photo_basename

# fixed values: names of stand-in pictures
PLACEHOLDERS = ["empty", "noimage", "no-image", "nophoto", "no-photo", "placeholder", "default", "blank"]


def seller_key(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(folded(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, 64)
    return F.when(F.coalesce(s, F.lit("")) == "", "no-seller").otherwise(s)


def region_key(region: Column) -> Column:
    r = F.regexp_replace(F.regexp_replace(folded(region), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(region, F.lit("")) == "", "unknown-region").otherwise(r)


def photo_identity(source: Column, url: Column, source_id: Column) -> Column:
    """A photo's share of an identity; none if it is a stand-in or only restates the advert's id."""
    base = photo_basename(url)
    return F.when((base == "no-photo") | F.lower(base).isin(PLACEHOLDERS) | F.coalesce(base.contains(source_id), F.lit(False)), None).otherwise(F.concat(source, F.lit(":"), base))


def fingerprint(make: Column, model: Column, year: Column, km: Column, region: Column, seller: Column, photo: Column) -> Column:
    """SHA-256 of the identity; null where nothing tells one item from another of the same model."""
    told = photo.isNotNull() | (F.trim(F.coalesce(seller, F.lit(""))) != "") | (year.isNotNull() & (km >= 0))
    unknown = lambda c, text: F.coalesce(c.cast("string"), F.lit(text))
    key = F.concat_ws("|", unknown(make, "unknown"), unknown(model, "unknown"), unknown(year, "unknown"), mileage_floor(km), region_key(region), seller_key(seller), unknown(photo, "no-photo"))
    return F.when(F.coalesce(told, F.lit(False)), F.sha2(key, 256))


def _keyed(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Heads (key, head, size) of groups of at least two: aggregated before they move, so a hot key is one row."""
    first = F.min_by("id", F.struct("first_seen_at", "id")).alias("head")
    return df, df.groupBy(key).agg(first, F.count("*").alias("size")).where("size > 1")


def cluster_by_vin(listings: DataFrame) -> DataFrame:
    """All rows, with the oldest advert of each 17-character VIN as head of the others; heads point nowhere."""
    _, heads = _keyed(listings.where(F.length("vin") == 17), "vin")
    joined = listings.join(heads, "vin", "left")
    canonical = F.when(F.col("head").isNull(), F.col("canonical_listing_id")).when(F.col("head") == F.col("id"), None).otherwise(F.col("head"))
    return joined.withColumn("canonical_listing_id", canonical).drop("head", "size")


def cluster_by_fingerprint(listings: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Groups equal fingerprints of rows that are recent, unclustered, have a model and a photo, whose fingerprint is
    not shared by differing VINs, and that head no other group. The oldest becomes the head."""
    conflict = listings.where("fingerprint is not null and vin is not null").groupBy("fingerprint").agg(F.count_distinct("vin").alias("vins")).where("vins > 1")
    heads = listings.where("canonical_listing_id is not null").select(F.col("canonical_listing_id").alias("id")).distinct()
    candidates = listings.where(F.col("fingerprint").isNotNull() & F.col("canonical_listing_id").isNull() & F.col("model_id").isNotNull() & (F.col("photo_count") > 0))
    candidates = candidates.where(F.col("last_seen_at") >= as_of - F.expr(f"interval {days} days"))
    candidates = candidates.join(conflict, "fingerprint", "left_anti").join(heads, "id", "left_anti")
    _, groups = _keyed(candidates, "fingerprint")
    moved = candidates.join(groups, "fingerprint").where("head <> id").select("id", "head")
    return listings.join(moved, "id", "left").withColumn("canonical_listing_id", F.coalesce("head", "canonical_listing_id")).drop("head")


def flatten_chains(listings: DataFrame) -> DataFrame:
    """A row whose head is itself a clone is freed, not pointed elsewhere."""
    clones = listings.where("canonical_listing_id is not null").select(F.col("id").alias("c_id"))
    joined = listings.join(clones, F.col("canonical_listing_id") == F.col("c_id"), "left")
    return joined.withColumn("canonical_listing_id", F.when(F.col("c_id").isNull(), F.col("canonical_listing_id"))).drop("c_id")


def unmerge(listings: DataFrame) -> DataFrame:
    """Clones are freed unless they share the head's VIN, or its fingerprint without differing VINs."""
    head = listings.select(F.col("id").alias("h_id"), F.col("vin").alias("h_vin"), F.col("fingerprint").alias("h_fp"))
    joined = listings.join(head, F.col("canonical_listing_id") == F.col("h_id"), "left")
    same_vin = F.coalesce(F.col("vin") == F.col("h_vin"), F.lit(False))
    differ = F.coalesce(F.col("vin") != F.col("h_vin"), F.lit(False))
    same_fp = F.coalesce(F.col("fingerprint") == F.col("h_fp"), F.lit(False))
    keep = same_vin | (same_fp & ~differ)
    return joined.withColumn("canonical_listing_id", F.when(keep, F.col("canonical_listing_id"))).drop("h_id", "h_vin", "h_fp")


def merge_catalog(facts: DataFrame, models: DataFrame) -> DataFrame:
    """Facts moved to the lowest model id of their (brand, bare slug)."""
    lowest = models.withColumn("canonical", F.min("model_id").over(W.partitionBy("make", "bare_slug"))).select("model_id", "canonical")
    return facts.join(lowest, "model_id", "left").withColumn("model_id", F.coalesce("canonical", "model_id")).drop("canonical")


def refresh_fingerprints(listings: DataFrame, computed: Column, now: Column, days: int = 8) -> DataFrame:
    """Adverts with the fingerprint written anew where it is missing or where price or details were read within ``days``."""
    recent = now - F.expr(f"interval {days} days")
    stale = F.col("fingerprint").isNull() | F.coalesce(F.col("price_checked_at") > recent, F.lit(False)) | F.coalesce(F.col("detailed_at") > recent, F.lit(False))
    return listings.withColumn("fingerprint", F.when(stale, computed).otherwise(F.col("fingerprint")))


#: Ids from here on are given by the crawl; lower ones are curated and never deleted.
MINTED = 1_000_000


def catalog_actions(models: DataFrame, makes: DataFrame, brand_of: Callable[[Column], Column]) -> DataFrame:
    """What becomes of each model (model_id, action, target, slug): ``models`` has model_id, make_id and slug, ``makes`` make_id and slug.

    ``brand_of`` gives the brand of a make's slug, null for what is none. ``junk``: no brand, its adverts lose the model.
    ``remap``: a model of the same brand and bare slug has a lower id, the target. ``move``: it stays but belongs under the
    brand's lowest make, the target, with its bare slug; not if that place is taken. Else ``keep``.
    """
    brands = makes.select("make_id", F.col("slug").alias("_make"), brand_of(F.col("slug")).alias("_brand"))
    home = brands.where("_brand is not null").groupBy("_brand").agg(F.min("make_id").alias("_home"))
    rows = models.join(brands, "make_id")
    bare = F.col("slug")
    for prefix in (F.concat("_make", F.lit("-")), F.concat("_brand", F.lit("-"))):
        bare = F.when((F.length(prefix) > 1) & F.startswith("slug", prefix), F.substring("slug", F.length(prefix) + 1, F.length("slug"))).otherwise(bare)
    rows = rows.withColumn("_bare", bare)
    lowest = rows.where("_brand is not null").groupBy("_brand", "_bare").agg(F.min("model_id").alias("_first"))
    taken = models.select(F.col("make_id").alias("_home"), F.col("slug").alias("_bare"), F.lit(True).alias("_taken")).distinct()
    rows = rows.join(lowest, ["_brand", "_bare"], "left").join(home, "_brand", "left").join(taken, ["_home", "_bare"], "left")
    moves = (F.col("_home") != F.col("make_id")) & F.col("_taken").isNull()
    action = F.when(F.col("_brand").isNull(), "junk").when(F.col("_first") != F.col("model_id"), "remap").when(moves, "move").otherwise("keep")
    rows = rows.withColumn("action", action)
    target = F.when(F.col("action") == "remap", F.col("_first")).when(F.col("action") == "move", F.col("_home"))
    return rows.select("model_id", "action", target.alias("target"), F.when(F.col("action") == "move", F.col("_bare")).otherwise(F.col("slug")).alias("slug"))


def apply_catalog(facts: DataFrame, actions: DataFrame) -> DataFrame:
    """Facts with their models remapped; those of junk models have none."""
    todo = actions.where("action in ('remap', 'junk')").select("model_id", F.lit(True).alias("_hit"), F.when(F.col("action") == "remap", F.col("target")).alias("_to"))
    return facts.join(todo, "model_id", "left").withColumn("model_id", F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("model_id"))).drop("_hit", "_to").select(*facts.columns)


def catalog_orphans(models: DataFrame, makes: DataFrame, actions: DataFrame, references: list[DataFrame]) -> DataFrame:
    """Minted models that no reference (frames with model_id) names after the merge, and minted makes then without models: (kind, id)."""
    gone = models.where(F.col("model_id") >= MINTED).select("model_id")
    for r in references:
        gone = gone.join(r.select("model_id"), "model_id", "left_anti")
    moved = actions.where("action = 'move'").select("model_id", F.col("target").alias("_to"))
    left = models.join(gone, "model_id", "left_anti").join(moved, "model_id", "left").select(F.coalesce("_to", "make_id").alias("make_id"))
    empty = makes.where(F.col("make_id") >= MINTED).select("make_id").join(left, "make_id", "left_anti")
    return gone.select(F.lit("model").alias("kind"), F.col("model_id").alias("id")).unionByName(empty.select(F.lit("make").alias("kind"), F.col("make_id").alias("id")))
