"""Places of rows in a whole table's order, without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import settled

WITHIN = 33


def numbered(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in the order of ``order``.

    Ranges of the order are sorted apart, counted, and each range's rows start from the sum of the counts before it. Only
    one row for each range meets in one task. The sorted ranges are fixed before they are counted, as a second sampling of
    their borders could differ. Rows equal in ``order`` get places in any order.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_rows = settled(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", WITHIN), F.col("_at").bitwiseAND(F.lit((1 << WITHIN) - 1))
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))
    out = sorted_rows.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + within)
    return out.drop("_at", "_part", "_before")


def every_nth(rows: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """Rows 1, n + 1, 2n + 1 and so on of the whole table in the given order: a sample for dry runs."""
    if n < 1:
        raise ValueError("n is 1 or more")
    return numbered(rows, *order, name="_place").where(F.col("_place") % n == 0).drop("_place")
