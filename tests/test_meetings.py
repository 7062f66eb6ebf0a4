"""Saved searches and ranked groups: what moves, and what is sent to all tasks."""

from datetime import datetime

from pyspark.sql import functions as F

from marketloom.operators import search as S

LISTING = "id long, model_id int, price_eur double, year int, mileage_km long, first_seen_at timestamp_ntz, removed_at timestamp_ntz, canonical_listing_id long"
DAY = datetime(2025, 7, 16)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def watched(spark):
    watches = spark.createDataFrame([(k, 1, None, None, None, True) for k in range(3)], "watch_id long, model_id int, price_max long, year_min int, mileage_max int, enabled boolean")
    return watches, spark.createDataFrame([(9, 1, 500.0, 2010, 7, DAY, None, None)], LISTING)


def test_copies_of_watches_are_not_sent_to_all_tasks(spark):
    watches, listings = watched(spark)
    met = S.match_watches(watches, listings, F.lit(DAY), F.lit(DAY))
    assert "Broadcast" not in plan(met) and "SortMergeJoin" in plan(met)
    assert sorted((r.watch_id, r.id) for r in met.collect()) == [(0, 9), (1, 9), (2, 9)]
    own = S.match_since_notified(watches.withColumns({"last_notified_at": F.lit(None).cast("timestamp_ntz"), "created_at": F.lit(DAY)}), listings, F.lit(DAY))
    assert "Broadcast" not in plan(own) and own.count() == 3


def test_groups_are_cut_before_they_move(spark):
    rows = spark.createDataFrame([("a" if i % 9 else None, i) for i in range(3000)], "g string, v int").repartition(7)
    few = S.top_per_group(rows, "g", [F.desc("v")], 4)
    assert "WindowGroupLimit" in plan(few)
    assert sorted((r.g or "", r.v, r.rank, r.extra) for r in few.collect()) == sorted([("a", v, k + 1, 2662) for k, v in enumerate((2999, 2998, 2996, 2995))] + [("", v, k + 1, 330) for k, v in enumerate((2997, 2988, 2979, 2970))])
    many = S.top_per_group(rows, "g", [F.desc("v")], S.LIMITED + 500)
    assert [(r.g, r["n"], r.e) for r in many.groupBy("g").agg(F.count("*").alias("n"), F.max("extra").alias("e")).orderBy("g").collect()] == [(None, 334, 0), ("a", 1500, 1166)]
