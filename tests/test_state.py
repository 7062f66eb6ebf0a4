"""Minted ids, places in a whole order, first-hit windows, the cursor stream, and detail rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import lifecycle as M
from marketloom.operators import minting as N
from marketloom.operators import numbering as O
from marketloom.streaming import events as E
from marketloom.streaming import rates as R

# --- minted ids -------------------------------------------------------------------------------------------------------


def fnv(s):
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def minted(names, catalogue, attempts, space):
    out = {n: i for i, n in sorted(((i, n) for n, i in catalogue if n is not None and n in names), reverse=True)}
    taken, waiting = {i for _, i in catalogue}, sorted({n for n in names if n is not None} - set(out))
    for k in range(attempts):
        wants = {}
        for n in waiting:
            wants.setdefault(1_000_000 + (fnv(f"{n}-{k}") & space), []).append(n)
        won = {ns[0]: i for i, ns in wants.items() if i not in taken}
        out |= won
        taken |= set(won.values())
        waiting = [n for n in waiting if n not in won]
    return out | dict.fromkeys(waiting)


@pytest.mark.parametrize(("space", "attempts"), [(63, 5), (15, 2), (0x7FFFFF, 5)])
def test_minted_ids_probe_and_never_meet(spark, space, attempts):
    names = [f"brand-{k}" for k in range(45)] + ["old", "old", None, "brand-1"]
    catalogue = [("old", 7), ("old", 1_000_003), ("other", 1_000_005), (None, 1_000_009)] + [(f"c{k}", 1_000_000 + 4 * k) for k in range(5)]
    ask = lambda parts: {r.name: r.id for r in N.mint_ids(spark.createDataFrame([(n,) for n in names], "name string").repartition(parts), spark.createDataFrame(catalogue, "name string, id long"), attempts, space=space).collect()}
    got = ask(3)
    assert got == minted(names, catalogue, attempts, space) == ask(7)
    new = [i for n, i in got.items() if i is not None and n != "old"]
    assert len(new) == len(set(new)) and not set(new) & {i for _, i in catalogue} and got["old"] == 7
    if space == 63:
        assert any(i is None for i in got.values()) or len(new) == 45
    again = spark.createDataFrame([(n, i) for n, i in got.items() if i is not None], "name string, id long").unionByName(spark.createDataFrame(catalogue, "name string, id long"))
    kept = {r.name: r.id for r in N.mint_ids(spark.createDataFrame([(n,) for n in names], "name string"), again, attempts, space=space).collect()}
    assert all(kept[n] == i for n, i in got.items() if i is not None)
    with pytest.raises(ValueError):
        N.mint_ids(again, again, space=10)


# --- places -----------------------------------------------------------------------------------------------------------


def test_places_in_the_whole_order(spark):
    values = random.Random(2).sample(range(10_000), 999) + [None]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(6)
    got = {r.v: r.p for r in O.numbered(df, "v", name="p").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, key=lambda v: (v is not None, v or 0)))}
    down = [r.v for r in O.every_nth(df, 100, F.col("v").desc_nulls_last()).orderBy(F.desc("v")).collect()]
    assert down == sorted((v for v in values if v is not None), reverse=True)[::100]
    assert O.every_nth(df.limit(0), 3, "v").count() == 0 and O.every_nth(df, 1, "v").columns == ["v"]


# --- first-hit windows ------------------------------------------------------------------------------------------------


def test_windows_open_at_the_first_hit(spark):
    r = random.Random(3)
    start = dt.datetime(2025, 1, 1)
    rows = [(i, r.choice(["hot", "hot", "a", "b", None]), None if i % 50 == 0 else start + dt.timedelta(seconds=r.randrange(4000))) for i in range(600)]
    rows += [(1000, "c", start), (1001, "c", start + dt.timedelta(seconds=60)), (1002, "c", start + dt.timedelta(seconds=59)), (1003, "c", start + dt.timedelta(seconds=120))]
    want, state = {}, {}
    for i, k, t in sorted(rows, key=lambda x: (x[2] is not None, x[2] or start, x[0])):
        if t is None:
            want[i] = (False, 0, None)
            continue
        opened, used = state.get(k, (None, 0))
        if opened is None or t >= opened + dt.timedelta(seconds=60):
            opened, used = t, 0
        want[i] = (used < 3, max(0, 2 - used), opened)
        state[k] = (opened, used + 1)
    df = spark.createDataFrame(rows, "i int, k string, t timestamp_ntz").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {x.i: (x.allowed, x.remaining, x.window_start) for x in R.first_hit_verdicts(df, "k", "t", "i", 3, 60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert R.first_hit_verdicts(df.limit(0), "k", "t", "i", 1, 1).count() == 0


# --- the cursor as a stream -------------------------------------------------------------------------------------------


def test_cursor_stream_goes_on_after_a_restart(spark, tmp_path):
    r = random.Random(4)
    runs = [(f"s{r.randrange(4)}", i, r.randrange(1, 90), r.random() < 0.05, r.random() < 0.4) for i in range(240)]
    schema = "source string, run_id long, last_page int, end boolean, failed boolean"
    latest = {}

    def keep(batch, _):
        for row in batch.collect():
            latest[row.source] = tuple(row)

    for part in range(3):
        spark.createDataFrame(runs[80 * part : 80 * part + 80], schema).repartition(2).write.mode("append").parquet(str(tmp_path / "runs"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(str(tmp_path / "runs"))
        query = E.cursor_stream(stream, 80).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    replayed = {x.source: tuple(x) for x in E.replay_cursors(spark.createDataFrame(runs, schema), 80).collect()}
    assert latest == replayed


# --- detail rows ------------------------------------------------------------------------------------------------------


def test_detail_rows_are_replaced_whole_and_gone_ones_marked(spark):
    old = spark.createDataFrame([(1, "old", 90, None), (2, "old", 80, None), (3, "old", 70, None)], "listing_id long, description string, power_kw int, detailed_at timestamp")
    read = spark.createDataFrame([(1, None, 95), (3, "new", 1), (5, "new", 60)], "listing_id long, description string, power_kw int")
    statuses = spark.createDataFrame([(1, 200), (3, 403), (4, 302), (4, 302), (6, 500), (2, 404)], "id long, status int")
    rows = {r.listing_id: (r.description, r.power_kw, r.detailed_at is not None) for r in M.upsert_details(old, read, statuses, F.lit("2025-01-01 00:00:00").cast("timestamp")).collect()}
    assert rows == {1: (None, 95, True), 2: ("old", 80, False), 3: ("old", 70, False), 4: ("[GONE]", None, True), 5: ("new", 60, True)}


def test_photos_are_cut_and_never_lost(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], "id long, position int, url string")
    new = spark.createDataFrame([(1, 1, "x" * 2100), (1, 101, "y"), (2, 150, "z")], "id long, position int, url string")
    rows = sorted((r.id, r.position, len(r.url)) for r in M.replace_children(old, new, "id", "position").collect())
    assert rows == [(1, 1, 2000), (2, 1, 1), (3, 1, 1)]


# --- quantiles of large groups, the table of snapshots, backfills ------------------------------------------------------


def test_quantiles_of_hot_null_and_single_groups(spark):
    import numpy as np

    from marketloom.operators.quantiles import group_quantiles

    r = random.Random(6)
    rows = [("hot", r.choice([None, 5.0, r.random()])) for _ in range(700)] + [(None, 1.0), (None, 4.0), ("one", 3.0), ("none", None)] + [("b", float(r.randrange(9))) for _ in range(50)]
    got = {x.g: (x.p25, x.p90, x.top) for x in group_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v", {"p25": 0.25, "p90": 0.9, "top": 1.0}).collect()}
    assert set(got) == {"hot", None, "one", "b"}
    for g, found in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        assert found == pytest.approx([np.quantile(values, q) for q in (0.25, 0.9, 1.0)], abs=1e-12)
    assert group_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"m": 0.5}).count() == 0


def test_published_table_survives_reruns_and_failures(spark, tmp_path):
    from marketloom.operators import snapshots as S

    path = str(tmp_path / "published")
    week = lambda d: F.lit(d)
    now = spark.createDataFrame([(1, "a", 10), (2, "a", 20)], "model_id int, year_bucket string, n int")
    stands = lambda: sorted((x.model_id, x.n, str(x.captured_on)) for x in spark.read.parquet(path).collect())
    S.publish_table(now, path, week("2025-05-19"))
    S.publish_table(now.where("model_id = 1"), path, week("2025-05-26"))
    S.publish_table(now.where("model_id = 1").withColumn("n", F.lit(11)), path, week("2025-05-26"))
    before = [(1, 10, "2025-05-19"), (1, 11, "2025-05-26"), (2, 20, "2025-05-19")]
    assert stands() == before
    # a job that fails midway leaves the table as it was
    broken = now.repartition(2, "model_id").withColumn("n", F.when(F.col("model_id") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        S.publish_table(broken, path, week("2025-05-26"))
    assert stands() == before
    S.publish_table(now.limit(0), path, week("2025-05-26"))
    assert stands() == [(1, 10, "2025-05-19"), (2, 20, "2025-05-19")]


def test_backfills_never_overwrite(spark):
    cols = "id long, model_id int, raw_title string, is_vehicle boolean, canonical_listing_id long, sold_at timestamp, removed_at timestamp"
    rows = [(1, None, "Predám Škoda Fabia 1.2", True, None, None, None), (2, 9, "Škoda Fabia", True, None, None, None), (3, None, "Škoda Fabia", True, 1, None, None), (4, None, "Škoda Octavia", True, None, None, None), (5, None, "Škoda neznáma", True, None, None, None), (6, None, None, True, None, None, None),
            (7, 3, "Nárazník Fabia", True, None, None, None), (8, 3, "Škoda Fabia", False, None, None, None)]
    df = spark.createDataFrame(rows, cols)
    catalogue = spark.createDataFrame([("skoda-fabia", 42)], "name string, id long")
    out = {r.id: r.model_id for r in M.backfill_models(df, {"skoda": ["fabia", "octavia"]}, catalogue).collect()}
    assert out == {1: 42, 2: 9, 3: None, 4: 1_000_000 + (fnv("skoda-octavia-0") & 0x7FFFFF), 5: None, 6: None, 7: 3, 8: 3}
    assert {r.id: r.is_vehicle for r in M.flag_parts(df).collect()} == {1: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False, 8: False}


def test_deal_list_orders_and_bounds(spark):
    from marketloom.operators import cohorts as C

    rows = [(1, 1000, 700.4, 29.96, "low", 1, "a", 70), (2, 9000, 5000.0, 44.44, "high", 2, "b", 80), (3, 2000, 1500.0, 25.0, "medium", 1, "a", None), (4, 1000, 700.4, 29.96, "low", 1, None, 60)]
    deals = spark.createDataFrame(rows, "id long, median_eur long, price_eur double, discount_pct double, confidence string, model_id int, region string, score int").withColumn("est_profit", F.lit(None).cast("long"))
    ids = lambda **k: [r.id for r in C.deal_list(deals, **k).collect()]
    assert ids() == [2, 1, 4, 3] and ids(sort="gain") == [2, 3, 1, 4] and ids(size=1) == [2]
    assert ids(confidence="medium") == [2, 3] and ids(price=1000) == [1, 4] and ids(discount=30) == [2] and ids(gain=400) == [2, 3] and ids(model_id=1, region="a") == [1, 3]
    assert C.deal_list(deals).first().discount_pct == 44.4
    one = {r.id: r.est_profit for r in C.deals_of(deals, spark.createDataFrame([(1,), (1,), (3,), (9,)], "id long")).collect()}
    assert one == {1: 1000 - 700 - 800 - 50}
    with pytest.raises(ValueError):
        C.deal_list(deals, sort="x")


# --- watches ----------------------------------------------------------------------------------------------------------


def test_watches_on_one_hot_model_equal_all_pairs(spark):
    from marketloom.operators import search as S

    r = random.Random(8)
    start = dt.datetime(2025, 1, 1)
    ads = [(i, 1 if i % 3 else r.choice([2, None]), r.choice([None, 5000.0, 4999.99, 80_000.0, float(r.randrange(100, 200_000))]), r.choice([None, 1999, 2000, 2010, 2020, 2024]), r.choice([None, 10, 150_000, 200_000]), start + dt.timedelta(hours=i)) for i in range(300)]
    asks = [(w, r.choice([1, 1, 2]), r.choice([None, 4999, 5000, 5001, 79_999, 80_000, 500_000]), r.choice([None, 1950, 2000, 2001, 2020, 2030]), r.choice([None, 150_000]), w % 7 > 0) for w in range(60)]
    listings = spark.createDataFrame(ads, "id long, model_id int, price_eur double, year int, mileage_km long, first_seen_at timestamp_ntz").withColumns({"removed_at": F.lit(None).cast("timestamp"), "canonical_listing_id": F.lit(None).cast("long")})
    watches = spark.createDataFrame(asks, "watch_id long, model_id int, price_max long, year_min int, mileage_max long, enabled boolean")
    since, until = (F.lit(str(start + dt.timedelta(hours=h))).cast("timestamp_ntz") for h in (20, 250))
    got = sorted((x.watch_id, x.id) for x in S.match_watches(watches, listings, since, until).collect())
    want = sorted((w, i) for w, wm, pm, ym, km, on in asks for i, m, p, y, k, t in ads if on and m == wm and 20 <= i <= 250 and (pm is None or (p is not None and p <= pm)) and (ym is None or (y is not None and y >= ym)) and (km is None or (k is not None and k <= km)))
    assert got == want and len(got) > 200


def test_top_rows_of_hot_groups_with_what_is_left(spark):
    from marketloom.operators import search as S

    rows = [("hot", i) for i in range(500)] + [("few", i) for i in range(3)] + [(None, 1)]
    got = S.top_per_group(spark.createDataFrame(rows, "g string, v int").repartition(6), "g", [F.desc("v")], 4).collect()
    assert sorted(((x.g or "", x.v, x.rank, x.extra) for x in got)) == sorted([("hot", 499 - k, k + 1, 496) for k in range(4)] + [("few", 2 - k, k + 1, 0) for k in range(3)] + [("", 1, 1, 0)])
