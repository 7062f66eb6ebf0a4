"""Filtered, sorted, paged lists of adverts; matching of saved searches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.predicates import all_of, in_regions, listed


@dataclass(frozen=True)
class Filters:
    """Optional criteria; what is None does not constrain."""

    sources: Sequence[str] | None = None
    price: tuple[float | None, float | None] = (None, None)
    year: tuple[int | None, int | None] = (None, None)
    mileage: tuple[int | None, int | None] = (None, None)
    fuels: Sequence[str] | None = None
    gearboxes: Sequence[str] | None = None
    regions: Sequence[str] | None = None
    with_photo: bool = False
    featured: bool = False
    text: str | None = None

    def conditions(self) -> list[Column]:
        out = [listed()]
        for column, wanted in (("source", self.sources), ("fuel", self.fuels), ("gearbox", self.gearboxes)):
            if wanted:
                out.append(F.col(column).isin(list(wanted)))
        for column, (lo, hi) in (("price_eur", self.price), ("year", self.year), ("mileage_km", self.mileage)):
            if lo is not None:
                out.append(F.col(column) >= lo)
            if hi is not None:
                out.append(F.col(column) <= hi)
        if self.regions:
            out.append(in_regions("region", list(self.regions)))
        if self.with_photo:
            out.append(F.col("photo_count") > 0)
        if self.featured:
            out.append(F.col("is_featured"))
        if self.text and self.text.strip():
            q = f"%{self.text.strip()}%"
            out.append(F.col("make").ilike(q) | F.col("model").ilike(q))
        return out


# descending order begins with missing values, ascending order ends with them
SORTS = {
    "newest": lambda: [F.col("first_seen_at").desc_nulls_first(), F.col("id").desc()],
    "oldest": lambda: [F.col("first_seen_at").asc_nulls_last(), F.col("id").asc()],
    "price_asc": lambda: [F.col("price_eur").asc_nulls_last(), F.col("id").desc()],
    "price_desc": lambda: [F.col("price_eur").desc_nulls_first(), F.col("id").desc()],
    "mileage_asc": lambda: [F.col("mileage_km").asc_nulls_last(), F.col("id").desc()],
}


def search(listings: DataFrame, filters: Filters) -> DataFrame:
    return listings.where(all_of(filters.conditions()))


def page(rows: DataFrame, sort: str, number: int, size: int) -> DataFrame:
    """One page; numbers below 1 and sizes outside 1 to 200 are moved to the nearest bound."""
    number, size = max(1, number), min(200, max(1, size))
    return rows.orderBy(*SORTS[sort]()).offset((number - 1) * size).limit(size)


#: Borders of the grid's cells. They only deal the work out; the exact criteria decide.
PRICE_CELLS, YEAR_CELLS = (5_000, 10_000, 20_000, 40_000, 80_000), (2000, 2010, 2015, 2020)
NO_VALUE = -1
#: Up to this many rows of a group Spark drops the others before they move (spark.sql.optimizer.windowGroupLimitThreshold's own value).
LIMITED = 1000


def cell(value: Column, borders: Sequence[int]) -> Column:
    """The number of borders at or below the value; a missing value has a cell of its own."""
    return F.coalesce(sum((F.when(value >= b, 1).otherwise(0) for b in borders), F.lit(0)) + F.when(value.isNull(), None).otherwise(0), F.lit(NO_VALUE))


def _fitting(watches: DataFrame, listings: DataFrame, *more: Column) -> DataFrame:
    """Watches and the adverts that fit them. They meet by model and by cells of price and year: an advert lies in one cell,
    a watch is copied to those its bounds reach, or to all, with that of missing values, where it has none. So the adverts
    of one model meet in up to thirty places, and no candidate far outside the bounds is made. They meet by sorting: the
    copies are many times the watches, which Spark does not reckon with when it picks a side to send to all tasks."""
    new = listings.where(listed() & F.col("canonical_listing_id").isNull()).withColumnRenamed("model_id", "l_model")
    new = new.withColumns({"_p": cell(F.col("price_eur"), PRICE_CELLS), "_y": cell(F.col("year"), YEAR_CELLS)})
    w = F.col
    reach_p = F.when(w("price_max").isNull(), F.sequence(F.lit(NO_VALUE), F.lit(len(PRICE_CELLS)))).otherwise(F.sequence(F.lit(0), cell(w("price_max"), PRICE_CELLS)))
    reach_y = F.when(w("year_min").isNull(), F.sequence(F.lit(NO_VALUE), F.lit(len(YEAR_CELLS)))).otherwise(F.sequence(cell(w("year_min"), YEAR_CELLS), F.lit(len(YEAR_CELLS))))
    copies = watches.where("enabled").withColumn("w_p", F.explode(reach_p)).withColumn("w_y", F.explode(reach_y))
    fits = (
        (w("model_id") == w("l_model")) & (w("w_p") == w("_p")) & (w("w_y") == w("_y")) & (w("price_max").isNull() | (w("price_eur") <= w("price_max")))
        & (w("year_min").isNull() | (w("year") >= w("year_min"))) & (w("mileage_max").isNull() | (w("mileage_km") <= w("mileage_max")))
    )
    return copies.hint("merge").join(new, all_of([fits, *more])).select("watch_id", "id", "price_eur", "first_seen_at")


def match_watches(watches: DataFrame, listings: DataFrame, since: Column, until: Column) -> DataFrame:
    """(watch_id, id) of new adverts within the window, both ends included; a missing criterion does not constrain."""
    return _fitting(watches, listings.where(F.col("first_seen_at").between(since, until)))


def match_since_notified(watches: DataFrame, listings: DataFrame, until: Column, days: int = 7) -> DataFrame:
    """As ``match_watches``, with a window of each watch's own: from when it was last notified (``last_notified_at``), or
    made (``created_at``), but at most ``days`` back, to ``until``, which is taken once and becomes the next start."""
    oldest = until - F.expr(f"interval {days} days")
    own = watches.withColumn("since", F.greatest(F.coalesce("last_notified_at", "created_at"), oldest))
    return _fitting(own, listings.where(F.col("first_seen_at").between(oldest, until)), F.col("first_seen_at") >= F.col("since"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], shown: int, parts: int = 16) -> DataFrame:
    """The first rows of each group, and how many more there are.

    Groups are counted apart, by sums that combine before they move. Ranks alone let Spark drop what lies beyond ``shown`` in
    each task before rows move; where it does not, as more are shown than LIMITED, groups are ranked in parts first. So no
    task sorts a group of any size.
    """
    counts = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    first = rows
    if shown > LIMITED:
        first = first.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(parts)))
        first = first.withColumn("_rank", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order))).where(F.col("_rank") <= shown).drop("_part", "_rank")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= shown)
    return ranked.join(counts, F.col(group).eqNullSafe(F.col("_group"))).withColumn("extra", F.greatest(F.col("_n") - shown, F.lit(0))).drop("_group", "_n")
