"""Table operators on small invented tables."""

from __future__ import annotations

import tempfile
import time

from pyspark.sql import functions as F

from larkfield.operators import identity, leads, places, website
from larkfield.plans import website_queries
from larkfield.sources.records import upsert
from larkfield.streaming.jobs import admission_stream, current_pool, research_stream

RECORD = "id string, provider string, external_id string, name string, street string, house_number string, postal_code string, city string, country_code string, lat double, lon double, phone string, category string"


def records(spark, *rows):
    return spark.createDataFrame([(r[0], "map", r[0], *r[1:]) for r in rows], RECORD)


FULL = ("Ufer", "1", "10115", "Berlin", "DE", 52.5, 13.4, "030 1234567", "cafe")


def test_identity_points(spark):
    found = {r.id: r for r in identity.build_identity(records(spark, ("a", "Optik Nord", *FULL), ("b", "Optik Nord", *FULL[:7], None, "cafe"), ("c", " ", *FULL))).collect()}
    assert (found["a"].identity_confidence, found["a"].identity_status) == (87, "CONFIRMED")
    assert found["b"].identity_status == "PROBABLE" and found["c"].identity_status == "UNVERIFIED"


def test_pair_rules(spark):
    pool = identity.build_identity(records(spark, ("p", "Optik Nord GmbH", *FULL)))
    other = ("Ring", "9", "80331", "Muenchen", "DE", 48.1, 11.5, "089 7654321", "cafe")
    cases = records(spark, ("same", "Optik Nord", *FULL), ("branch", "Optik Nord", *other), ("building", "Pizzeria Roma", *FULL[:7], "030 9999999", "cafe"), ("desk", "Pizzeria Roma", *other[:7], "030 1234567", "cafe"), ("alone", "Blumen Petra", *other))
    i = identity.build_identity(cases)
    best = {r.incoming_id: r.kind for r in identity.best_match(identity.decide_pairs(identity.blocking_pairs(i, pool), i, pool)).collect()}
    assert best == {"same": "same", "branch": "branch", "building": "none", "desk": "review"}


def test_load_is_repeatable_and_streams_alike(spark):
    rows = records(spark, ("a", "Optik Nord", *FULL), ("b", "Optik Nord GmbH", *FULL), ("c", "Blumen Petra", "Ring", "9", "80331", "Muenchen", "DE", 48.1, 11.5, "089 7654321", "shop"), ("d", " ", *FULL))
    built = identity.build_identity(rows)
    none = built.limit(0)
    sources = built.select("provider", "external_id", F.col("id").alias("business_id"))
    first = {r.incoming_id: (r.business_id, r.outcome) for r in identity.load_discovered(built, none, sources.limit(0)).collect()}
    assert first == {"a": ("a", "new"), "b": ("a", "duplicate"), "c": ("c", "new"), "d": (None, "rejected")}
    again = {r.outcome for r in identity.load_discovered(built, none, sources).collect()}
    assert again == {"refreshed", "rejected"}  # a record without a name is rejected, known or not
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    research_stream(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/out/businesses").collect()) == ["a", "c"]


def test_load_outcomes_follow_the_sequential_rules(spark):
    other = ("Ring", "9", "80331", "Muenchen", "DE", 48.1, 11.5)
    pool = identity.build_identity(records(spark, ("p", "Optik Nord", *FULL)))
    rows = records(spark, ("a", "Optik Nord", *FULL[:7], "030 7777777", "shop"), ("b", "Blumen Petra", *other, "089 7654321", "shop"), ("c", "Autohaus Zentrum", "Allee", "1", "80331", "Muenchen", "DE", 48.9, 11.9, "089 7654321", "shop"), ("d", "Blumen Petra GmbH", "Ring", "9", "80331", "Muenchen", "DE", 48.1, 11.5, "089 1111111", "shop"), ("e", "  ", *other, "089 2222222", "shop"), ("f", "Optik Nord", *FULL))
    built = identity.build_identity(rows)
    sources = built.where("id in ('e', 'f')").select("provider", "external_id", F.lit("p").alias("business_id"))
    found = {r.incoming_id: (r.business_id, r.outcome) for r in identity.load_discovered(built, pool, sources).collect()}
    assert found == {"a": ("p", "needs_review"), "b": ("b", "new"), "c": ("c", "needs_review"), "d": ("b", "needs_review"), "e": (None, "rejected"), "f": ("p", "refreshed")}
    out = spark.createDataFrame([(k, *v) for k, v in found.items()], "incoming_id string, business_id string, outcome string")
    assert {(r.business_id, r.is_new) for r in identity.verification_queue(out).collect()} == {("p", False), ("b", True), ("c", True)}
    assert {r.business_id for r in identity.verification_queue(out, only_new=True).collect()} == {"b", "c"}


def test_second_load_fills_what_the_pool_lacks(spark):
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    for k, phone in enumerate((None, "030 1234567")):
        rows = records(spark, ("a", "Optik Nord", *FULL[:7], phone, "shop"))
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        research_stream(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
        pool = current_pool(spark, f"{folder}/out").collect()
        assert [(r.id, r.phone_e164) for r in pool] == [("a", "+49301234567" if k else None)]


def test_places_near_the_180th_meridian_and_in_queries(spark):
    rows = spark.createDataFrame([("a", -17.0, 179.95), ("b", -17.0, -179.95), ("c", -17.0, 179.0), ("d", None, 1.0)], "id string, lat double, lon double")
    spots = spark.createDataFrame([(0, "West", "suva west", -17.0, -179.99), (1, "East", "suva", -17.0, 178.95)], "ordinal int, label string, alias string, lat double, lon double")
    assert {(r.id, r.label) for r in places.nearest_place(rows, spots).collect()} == {("a", "West"), ("b", "West"), ("c", "East")}
    asked = spark.createDataFrame([("Cafés in SUVA West",), ("in Suva",), ("",), (None,), ("suv",)], "query string")
    assert {(r.query, r.label) for r in places.lookup_places(asked, spots).collect()} == {("Cafés in SUVA West", "West"), ("in Suva", "East")}
    assert places.lookup_places(asked, spots.limit(0)).count() == 0


def test_admissions_batch_and_stream(spark):
    at = 1_700_000_000_000
    rows = spark.createDataFrame([("k", at, 1), ("k", at + 10, 2), ("k", at + 20, 3), ("k", at + 105, 4), ("z", at + 5, 5)], "key string, ts_ms long, event_id long")
    batch = {(r.event_id, r.allowed, r.remaining, r.retry_after_ms) for r in leads.admissions(rows, 2, 100).collect()}
    assert batch == {(1, True, 1, 0), (2, True, 0, 0), (3, False, 0, 80), (4, True, 1, 0), (5, True, 1, 0)}
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    for part in ("event_id in (1, 5)", "event_id in (2, 3)", "event_id = 4"):  # one window over three runs with pauses between them
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        out = admission_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), 2, 100)
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        time.sleep(0.2)
    found = {(r.event_id, r.allowed, r.remaining, r.retry_after_ms) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert found == batch


def test_qualification_blockers(spark):
    clean = ("CONFIRMED", 80, "VERIFIED_NO_WEBSITE", 90, "+49301", None)
    cases = [clean, *[tuple(v if k == n else x for k, x in enumerate(clean)) for n, v in ((0, "PROBABLE"), (1, 60), (2, "PROBABLE_WEBSITE"), (2, "WEBSITE_UNCERTAIN"), (2, "NOT_CHECKED"), (3, 60), (4, None), (5, 1))]]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, identity_status string, identity_confidence int, website_status string, website_confidence int, phone_e164 string, excluded_ms long")
    got = [tuple(r.q.blockers) for r in df.withColumn("q", leads.qualify()).orderBy("k").collect()]
    assert got == [(), ("identity_status",), ("identity_confidence",), ("has_website",), ("manual_check",), ("not_checked",), ("website_confidence",), ("no_phone",), ("excluded",)]


def test_redirects_stop_after_five(spark):
    hops = spark.createDataFrame([(f"h{k}.de", f"https://h{k + 1}.de") for k in range(7)], "host_path string, redirect_to string")
    start = spark.createDataFrame([("https://www.h0.de/",), ("https://h6.de",), ("https://none.de",)], "url string")
    got = {r.url: (r.final_url, len(r.redirects), r.too_many) for r in website.follow_redirects(start, hops).collect()}
    assert got == {"https://www.h0.de/": ("https://h5.de", 5, True), "https://h6.de": ("https://h7.de", 1, False), "https://none.de": ("https://none.de", 0, False)}


def test_status_ladder_never_concludes_from_a_blocked_channel(spark):
    s = "identity_status string, identity_confidence int, accepted struct<url:string,score:int>, probable struct<url:string,score:int>, unreachable long, parked long, ambiguous long, ok_channels long, blocked long, n_profiles long, social_as_website boolean"
    base = ["CONFIRMED", 80, None, None, 0, 0, 0, 4, 0, 0, False]
    change = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(s.replace("url:string,", "url:string;").split(", "), base, strict=True))
    cases = [change(), change(blocked=1), change(unreachable=1), change(parked=1), change(ambiguous=1), change(identity_status="PROBABLE"), change(ok_channels=1), change(accepted=("u", 90)), change(n_profiles=1, social_as_website=True)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, " + s)
    got = [(r.w.status, r.w.confidence) for r in df.withColumn("w", website.website_status()).orderBy("k").collect()]
    manual = "REQUIRES_MANUAL_CHECK"
    assert got == [("VERIFIED_NO_WEBSITE", 95), (manual, 30), (manual, 40), (manual, 45), ("WEBSITE_UNCERTAIN", 40), (manual, 35), (manual, 35), ("VERIFIED_WEBSITE", 90), ("VERIFIED_NO_WEBSITE", 78)]


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 5, "w"), ("c", 1, "n")], "k string, t int, v string")
    assert {(r.k, r.v) for r in upsert(old, new, ["k"], "t").collect()} == {("a", "z"), ("b", "w"), ("c", "n")}


def test_every_page_has_its_own_address(spark):
    """More pages than made addresses before (170): none is dropped, and search results lead to them, some by a redirect."""
    sf = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    spark.range(400).selectExpr("id AS page_id", "concat('http://x.example.org/', id) AS url", "concat('<p>', id, '</p>') AS html").write.parquet(f"{sf}/pages.parquet")
    pages = website_queries.page_table(spark, sf)
    paths = {r.host_path for r in pages.select("host_path").collect()}
    assert pages.count() == len(paths) == 400
    made = spark.range(3000).selectExpr("concat('q', id) AS query", "int(id % 10) AS rank", "concat('https://www.site', id % 17, '.de/x', id % 10) AS url")
    got = {r.url.removeprefix("https://www.") for r in website_queries.results_on_pages(made, pages).collect()}
    assert {u.replace("/old", "/x") for u in got} <= paths and len(got) > 400
