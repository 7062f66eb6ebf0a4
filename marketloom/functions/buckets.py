"""Bucket labels of years and mileages."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_bucket(year: Column) -> Column:
    return F.when(year.isNull(), "unknown").when(year >= 2020, "2020+").when(year >= 2015, "2015-19").when(year >= 2010, "2010-14").otherwise("<2010")


def mileage_bucket(km: Column) -> Column:
    return F.when(km.isNull() | (km < 0), "unknown").when(km < 50_000, "0-50k").when(km < 100_000, "50-100k").when(km < 150_000, "100-150k").otherwise("150k+")


def mileage_floor(km: Column, step: int = 5000) -> Column:
    """Mileage floored to a step, as text; unknown where missing or negative."""
    return F.when(km.isNull() | (km < 0), "unknown").otherwise((F.floor(km / step) * step).cast("string"))
