"""Named row sets of the advert market, as Column factories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE, MILEAGE, OLDEST_YEAR, HOME = (100, 500_000), (0, 1_000_000), 1980, "SK"

# fixed values: region names and the patterns that place a location in them
REGION_PATTERNS = {
    "Bratislavský": ["%bratisl%", "BA %", "BA-%"],
    "Trnavský": ["%trnav%"],
    "Trenčiansky": ["%trenč%"],
    "Nitriansky": ["%nitr%"],
    "Žilinský": ["%žilin%"],
    "Banskobystrický": ["%bansk%"],
    "Prešovský": ["%prešov%"],
    "Košický": ["%košic%"],
}


def _in(name: str, lo: int, hi: int) -> Column:
    return F.col(name).isNull() | F.col(name).between(lo, hi)


def plausible(next_year: int) -> Column:
    """Price, mileage and year within bounds; a missing value passes."""
    return _in("price_eur", *PRICE) & _in("mileage_km", *MILEAGE) & _in("year", OLDEST_YEAR, next_year)


def plausible_priced(next_year: int) -> Column:
    """As plausible, but the price must be there."""
    return F.col("price_eur").isNotNull() & plausible(next_year)


def home_market() -> Column:
    """An unknown country is not home."""
    return F.coalesce(F.col("country") == HOME, F.lit(False))


def domestic_only() -> Column:
    """An unknown country passes."""
    return F.col("country").isNull() | (F.col("country") == HOME)


def market_reference(next_year: int) -> Column:
    return F.col("is_vehicle") & plausible_priced(next_year) & home_market()


def market_reference_nullable(next_year: int) -> Column:
    """The variant in which rows without a price count."""
    return F.col("is_vehicle") & plausible(next_year) & home_market()


def active() -> Column:
    return F.col("canonical_listing_id").isNull() & F.col("sold_at").isNull() & F.col("removed_at").isNull()


def listed() -> Column:
    """What lists show: sold and cloned rows stay, removed ones go."""
    return F.col("removed_at").isNull()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def in_regions(column: str, names: list[str]) -> Column:
    """Any pattern of any named region; unknown names are dropped, and with no known name every row passes."""
    return any_of([F.col(column).ilike(p) for n in names for p in REGION_PATTERNS.get(n, [])])


def at_least(column: str, least: str, order: tuple[str, ...] = ("low", "medium", "high")) -> Column:
    """Threshold on an ordered enumeration."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(order):
        rank = F.when(F.col(column) == name, i).otherwise(rank)
    return rank >= order.index(least)
