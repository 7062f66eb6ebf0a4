"""Rounding with the rules the engine needs, spelled out, as casts differ between engines."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """To a whole number, halves towards plus infinity."""
    return F.floor(c + F.lit(0.5)).cast("long")


def half_up_to(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def percent_share(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; 0 where the whole is not positive."""
    return F.when(whole > 0, F.floor(part * 1000 / whole + 0.5) / 10).otherwise(F.lit(0.0))
