"""Rules of the market operators on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.functions import predicates as P
from marketloom.functions import scoring
from marketloom.functions import text as X
from marketloom.functions import vehicles as V
from marketloom.operators import identity as I
from marketloom.operators import lifecycle as M
from marketloom.operators import snapshots as N
from marketloom.sources import pages as S
from marketloom.streaming import events as E

T0 = dt.datetime(2025, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def test_score_of_known_cases(spark):
    rows = spark.createDataFrame([(10000.0, 10000.0, 0, None, 0, 100.0), (6000.0, 10000.0, 50, "private", 10, 3.0), (0.0, 0.0, 0, "dealer", 20, 14.0)], "p double, m double, n int, s string, k int, d double")
    parts = scoring.components(*[F.col(c) for c in "pmnskd"])
    assert [r[0] for r in rows.select(scoring.deal_score(parts)).collect()] == [6, 100, 25]


def test_predicates_differ_on_missing_prices(spark):
    rows = spark.createDataFrame([(1, None, "SK"), (2, 5000.0, "SK"), (3, 5000.0, None), (4, 50.0, "SK")], "id int, price_eur double, country string")
    rows = rows.withColumns({"mileage_km": F.lit(None).cast("int"), "year": F.lit(2000), "is_vehicle": F.lit(True)})
    ids = lambda c: [r.id for r in rows.where(c).orderBy("id").collect()]
    assert ids(P.market_reference(2026)) == [2]
    assert ids(P.market_reference_nullable(2026)) == [1, 2]
    assert ids(P.domestic_only()) == [1, 2, 3, 4]


def adverts(spark, rows):
    schema = "id long, source string, vin string, fingerprint string, first_seen_at timestamp, last_seen_at timestamp, removed_at timestamp, first_seen_alive_at timestamp, sold_at timestamp, canonical_listing_id long, model_id int, photo_count int"
    return spark.createDataFrame(rows, schema)


def advert(i, fp=None, vin=None, seen=0, removed=None, alive=0, head=None, source="A"):
    return (i, source, vin, fp, day(seen), day(seen + 5), None if removed is None else day(removed), None if alive is None else day(alive), None, head, 1, 3)


def test_clusters_settle(spark):
    vin = "A" * 17
    df = adverts(spark, [advert(1, "f", vin, 0), advert(2, "g", vin, 1), advert(3, "h", None, 2), advert(4, "h", None, 3), advert(5, "k", "B" * 17, 4), advert(6, "k", "C" * 17, 5)])
    now = F.lit("2025-01-20 00:00:00").cast("timestamp")
    once = I.flatten_chains(I.cluster_by_fingerprint(I.cluster_by_vin(df), now))
    heads = {r.id: r.canonical_listing_id for r in once.collect()}
    assert heads == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None}
    again = I.flatten_chains(I.cluster_by_fingerprint(I.cluster_by_vin(once), now))
    assert {r.id: r.canonical_listing_id for r in again.collect()} == heads


def test_sold_needs_no_relisting(spark):
    df = adverts(spark, [
        advert(1, "a", removed=50), advert(2, "a", seen=21), advert(3, "b", removed=50), advert(4, "b", seen=81), advert(5, None, removed=50), advert(6, "c", removed=50, alive=None), advert(7, "d", seen=10, removed=50), advert(8, "d", seen=5),
    ])
    assert sorted(r.id for r in M.detect_sold(df).collect()) == [3, 7]


def test_merge_rules(spark):
    schema = "source string, source_id string, price_eur double, year int, mileage_km long, fuel string, gearbox string, region string, country string, model_id int, raw_title string, is_featured boolean, fingerprint string"
    new = spark.createDataFrame([("s", "1", None, None, 5, None, None, None, None, None, "t2", False, "z"), ("s", "2", 9.0, 1, 1, None, None, None, None, 1, "n", True, "y"), ("s", "3", None, 1, 1, None, None, None, None, 1, "n", True, "y")], schema)
    old = spark.createDataFrame([("s", "1", 7.0, 2000, 4, "diesel", None, None, "SK", 3, "t1", True, None), ("s", "9", 1.0, 1, 1, None, None, None, None, 1, "o", False, "q")], schema)
    stamp = lambda c: F.lit(c).cast("timestamp")
    more = lambda place, views, url, phone: {"locality": F.lit(place).cast("string"), "view_count": F.lit(views).cast("int"), "url": F.lit(url).cast("string"), "raw_json": F.lit(url).cast("string"), "seller_phone": F.lit(phone)}
    old, new = old.withColumns(more("Nitra", 3, "u1", "p1")), new.withColumns(more(None, 4, None, "p2"))
    old = old.withColumns({"first_seen_alive_at": stamp(None), "price_checked_at": stamp("2024-01-01 00:00:00"), "last_seen_at": stamp("2024-01-01 00:00:00")})
    out = {r.source_id: r for r in M.merge_observations(old, new, stamp("2025-01-01 00:00:00")).collect()}
    a = out["1"]
    assert (a.price_eur, a.year, a.mileage_km, a.fuel, a.country, a.is_featured, a.fingerprint, a.change) == (None, 2000, 5, "diesel", "SK", True, "z", "updated")
    assert a.first_seen_alive_at == a.price_checked_at == a.last_seen_at == dt.datetime(2025, 1, 1)
    assert (a.locality, a.view_count, a.url, a.raw_json, a.seller_phone, out["2"].seller_phone, out["9"].url) == ("Nitra", 4, None, None, "p1", "p2", "u1")
    assert out["2"].change == "added" and out["2"].first_seen_alive_at is None and out["2"].price_checked_at is not None and out["3"].price_checked_at is None
    assert out["9"].change == "same" and out["9"].last_seen_at == dt.datetime(2024, 1, 1)


def test_days_to_sell_needs_five_sales(spark):
    rows = [(i, 1, None, True, "SK", 2015, 60000, 10000.0 + 2000 * i, None, None, day(0)) for i in range(5)]
    rows += [(10 + i, 1, None, True, "SK", 2015, 60000, 9000.0, day(n), day(n), day(0)) for i, n in enumerate([3, 4, 5, 6, 300])]
    df = spark.createDataFrame(rows, "id int, model_id int, canonical_listing_id long, is_vehicle boolean, country string, year int, mileage_km int, price_eur double, sold_at timestamp, removed_at timestamp, first_seen_alive_at timestamp")
    week = F.lit("2025-01-01 00:00:00").cast("timestamp")
    r = N.weekly_snapshot(df, week, 2026).first()
    assert (r.count_active, r.p25_price_eur, r.median_price_eur, r.p75_price_eur, r.count_sold, r.days_to_sell) == (5, 12000, 14000, 16000, 5, 5.0)
    assert N.weekly_snapshot(df.where("id < 14"), week, 2026).first().days_to_sell is None


@pytest.mark.parametrize(
    ("text", "title", "year"),
    [
        ("dátum r.v.: 04/21, 1598cm³", None, 2021), ("bez údajov", "Kombi 2009", 2009), ("rok 1971", None, None), ("R.V. 7.3.2017", None, 2017), ("r.v.: 9/16", None, 2016), ("r.v.: 11/97", None, 1997),
        ("Diesel, r.v.: 04/21, objem 1598cm³, 85kW", None, 2021), ("Objem: 1395cm³", None, None), ("Objem: 1998cm³", None, None), ("Rok výroby: 8/2014", None, 2014), ("MODEL 2019", None, 2019),
        ("r.v.: 17/23", None, None), ("r.v 2021/9 prejdených 40500km", None, 2021), ("★r.v: 2020/11", None, 2020), ("★Rok výroby: 14.6.2016", None, 2016), ("★Rok výroby:3.10.2020", None, 2020),
        ("manuál 6st.,r.v10/2020, Benzín", None, 2020), ("PRVÁ registrácia 02/2022, stav 30 100 km.", None, 2022), ("Rok výroby: 24.8.1999", None, 1999), ("Rok výroby: 7.31.2018", None, 2018),
        ("R.v 2010, prešlo 190tis km", None, 2010), ("Päťstupňová prevodovka, rv. 2008", None, 2008), ("Dodávka,1.9tdi,rv2003,naj.210tis", None, 2003), ("rv.9/2012 plná výbava", None, 2012),
        ("r. v. 2016 – rodinné auto", None, 2016), ("Parametre r. v. : 08/15, 2998cm³", None, 2015), ("Malé mestské auto, rocnik 2007, trojdverové", None, 2007), ("ročník 2014", None, 2014),
        ("servisné intervaly každých 2010 km", None, None), ("rezervný kľúč, zosilňovač 2005 W", None, None), ("Prvá evidencia 2012", None, 2012), ("1. evidencia: 9/2016", None, 2016), (None, None, None),
    ],
)
def test_labelled_years(spark, text, title, year):
    df = spark.createDataFrame([(text, title)], "t string, h string")
    assert df.select(V.labelled_year(F.col("t"), F.col("h"), 2026)).first()[0] == year


@pytest.mark.parametrize(
    ("text", "km"),
    [
        ("Najazdené: 88 500 km", 88500), ("výkon 66 kW 140 020 km", 140020), ("175 tis. km", 175000), ("7 km", None), (None, None), ("Rok vyroby 2012 Najazdenych 98 tis km - doklady", 98000),
        ("rv. 08/2011, najazdené 160tis. km", 160000), ("Rok vyroby - 2015 Najazdenych - 63 tisic km", 63000), ("Cena dohodou, okolo 12 tis €", None), ("Možná výmena RV:6/2014 KW:103 KM:98760 klíma", 98760),
        ("Km 143000km strešné nosiče", 143000), ("★km: 64000 ★r.v: 2021/5", 64000), ("ROK 2013 201 300 KM 110 KW", 201300), ("Najazdené: 54 321 km", 54321), ("Spotreba okolo 6.1 lit. /100 km", None),
    ],
)
def test_odometers(spark, text, km):
    assert spark.createDataFrame([(text,)], "t string").select(V.odometer(F.col("t"))).first()[0] == km


def test_make_and_model(spark):
    brands = {"land-rover": ["discovery", "range"], "rover": ["75"], "skoda": ["octavia", "octavia-combi", "fabia"], "volkswagen": ["golf"], "mercedes-benz": ["c-class"], "audi": ["a4"]}
    expected = {
        "Land Rover Discovery 3.0": ("land-rover", "discovery"), "Škoda Octavia Combi 2.0": ("skoda", "octavia-combi"), "Škoda neznáma": ("skoda", None), "niečo": (None, None), None: (None, None),
        "Predám Škoda Octavia 2.0 TDI": ("skoda", "octavia"), "Ľavé bočné dvere Škoda Fabia 1 strana vodiča": ("skoda", "fabia"), "VW Golf 1.6 TDI": ("volkswagen", "golf"), "Mercedes C 220": ("mercedes-benz", None),
        "Kolesá": (None, None), "205/55R16": (None, None), "Rozpredám golf 4 96kw": (None, None), "Audi Q9 prototyp": ("audi", None), "": (None, None), "Škoda": ("skoda", None),
    }
    titles = spark.createDataFrame([(t,) for t in expected], "title string")
    assert {r.title: (r.make, r.model) for r in V.make_model(titles, brands).collect()} == expected


def test_fnv_of_known_texts(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string")
    assert [r[0] for r in df.select(X.fnv1a(F.col("s"))).collect()] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_fingerprint_needs_an_identity(spark):
    df = spark.createDataFrame([(None, None, None, None), (2010, 4999, None, None), (2010, 5000, None, None), (None, None, " Ján ", None), (None, None, None, "s:x")], "y int, k int, s string, p string")
    fp = [r[0] for r in df.select(I.fingerprint(F.lit("m"), F.lit("o"), F.col("y"), F.col("k"), F.lit("SK-Brno"), F.col("s"), F.col("p"))).collect()]
    assert fp[0] is None and len(set(fp)) == 5


def test_robots_longest_rule_wins(spark):
    df = spark.createDataFrame([("/a/b",), ("/a",), ("/x.html",), ("/x.htmlx",)], "p string")
    assert [r[0] for r in df.select(S.robots_allowed(F.col("p"), ["/a/b"], ["/a", "/*.html$"])).collect()] == [True, False, False, True]


def test_cursor_rules():
    start = {"next_page": 5, "page_space": None, "max_known": None, "cycle": 0, "failures": 0}
    assert E.next_cursor(start, {"failed": False, "end": False, "last_page": 80})["next_page"] == 81
    assert E.next_cursor(start | {"page_space": 6776}, {"failed": False, "end": False, "last_page": 6776}) == start | {"page_space": 6776, "next_page": 1, "cycle": 1}
    twice = start | {"failures": 2}
    assert E.next_cursor(twice, {"failed": True, "end": False, "last_page": 7})["next_page"] == 8


def test_hourly_counts_stream(spark, tmp_path):
    rows = [(i, day(0) + dt.timedelta(minutes=10 * i), 1, "view", 1.0) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "in"))
    q = E.hourly_counts(E.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("hourly").collect()) == [6, 6, 6, 6, 6]


def test_detail_merge(spark):
    cols = "id long, year int, mileage_km long, fuel string, gearbox string, model_id int, raw_title string, price_eur double, region string, country string"
    rows = [(1, None, 5, None, None, None, None, None, "SK-Brno", "SK"), (2, 2000, None, "diesel", None, 3, "t", 9.0, None, None), (3, None, None, None, None, None, None, None, "SK-A", "SK"), (4, None, None, None, None, None, None, 1.0, "SK-A", None)]
    old = spark.createDataFrame(rows, cols).withColumns({"price_checked_at": F.lit(None).cast("timestamp"), "locality": F.when(F.col("id") == 1, F.lit("Brno"))})
    new = spark.createDataFrame([(1, 1999, 7, "lpg", "manual", 2, "n", 8.0, "CZ-Brno", "CZ", False), (2, 1999, 7, "lpg", "manual", 2, "n", None, "SK-B", "SK", None), (3, None, None, None, None, None, None, None, "SK-B", "DE", True)], cols + ", abroad boolean").withColumn("locality", F.lit("Detva"))
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    out = {r.id: r for r in M.merge_details(old, new, now).collect()}
    assert (out[1].year, out[1].mileage_km, out[1].fuel, out[1].region, out[1].country, out[1].price_eur, out[1].price_checked_at is None) == (1999, 5, "lpg", "CZ-Brno", "SK", 8.0, False)
    assert (out[2].year, out[2].fuel, out[2].region, out[2].country, out[2].price_eur, out[2].price_checked_at) == (2000, "diesel", "SK-B", "SK", 9.0, None)
    assert [out[k].locality for k in (1, 2, 3, 4)] == ["Brno", "Detva", "Detva", None]
    assert (out[3].region, out[3].country) == ("SK-A", None) and (out[4].region, out[4].country) == ("SK-A", None)
