"""Steps whose work must not be multiplied by what repeats."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from larkfield.functions import hours
from larkfield.operators import identity, leads, matching, places, website
from larkfield.operators.schedules import with_hours
from larkfield.plans import lead_queries, website_queries


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hours_of_a_text_are_read_once(spark):
    texts = ["Mo-Fr 09:00-18:00", "24/7", None, " ", "by appointment"]
    rows = spark.createDataFrame([(k, texts[k % 5], ("Europe/Berlin", "UTC")[k % 2]) for k in range(40)], "id int, opening_hours_raw string, timezone string")
    got = with_hours(rows)
    assert "regexp_replace" not in plan_of(got)  # the texts are read before, not in the rows
    want = rows.withColumn("h", hours.parse_opening_hours(F.col("opening_hours_raw"), F.col("timezone")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_status_names_its_hours_once(spark):
    rows = spark.createDataFrame([("Mo 9-10", "UTC")], "raw string, zone string")
    status = hours.opening_status(hours.parse_opening_hours(F.col("raw"), F.col("zone")), F.lit("2024-06-03 09:30:00").cast("timestamp"))
    alone = plan_of(rows.select(hours.parse_opening_hours(F.col("raw"), F.col("zone")).alias("h")))
    assert plan_of(rows.select(status.alias("s"))).count("geschlossen") == alone.count("geschlossen")


def test_queues_join_no_user_with_leads_of_others(spark):
    rows = [(f"b{k:03d}", f"l{k}", None, "+49301", True, None if k % 3 else 5, f"u{k % 4}" if k % 5 else None, k % 3, k % 2, None, f"n{k % 7}") for k in range(60)]
    view = spark.createDataFrame(rows, "id string, lead_id string, excluded_ms long, phone_e164 string, is_callable boolean, next_callback_ms long, assigned_user_id string, priority int, call_count long, last_call_ms long, name_lower string")
    users = spark.createDataFrame([(f"u{k}",) for k in range(6)], "user_id string")
    for limit in (3, 50):
        out = leads.all_queues(view, users, 10, limit)
        assert not re.search(r"Join \w+, NOT ", plan_of(out))
        got = {(r.user_id, r["rank"]): r.id for r in out.collect()}
        for u in range(6):
            want = [r.id for r in leads.calling_queue(view, f"u{u}", 10, limit).collect()]
            assert [got[f"u{u}", k + 1] for k in range(len(want))] == want
    assert len(got) == 6 * 50


def test_nearest_place_multiplies_no_row(spark):
    rows = spark.range(200).select(F.col("id").cast("string"), (F.lit(48.0) + F.col("id") % 4 / 10).alias("lat"), F.lit(11.0).alias("lon"))
    spots = spark.range(30).select(F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("p"), "id").alias("label"), (F.lit(48.0) + F.col("id") / 100).alias("lat"), F.lit(11.0).alias("lon"))
    out = places.nearest_place(rows, spots)
    assert "Generate" not in plan_of(out)
    assert {(int(r.id) % 4, r.label) for r in out.collect()} == {(0, "p0"), (1, "p10"), (2, "p20"), (3, "p29")} and out.count() == 200


def test_pairs_are_met_once_and_not_shuffled(spark):
    """One row for each two rows that meet, as the queries' SQL gives them, also where both ids repeat."""
    at = [(48.0, 11.0), (48.002, 11.003), (48.5, 11.0), (None, None), (-33.0, 179.9)]
    rows = [(f"r{k % 29}", f"+49{k % 3}" if k % 4 else None, f"a{k % 5}" if k % 3 else "", f"n{k % 4}" if k % 2 else "", *at[k % 5]) for k in range(30)]
    table = spark.createDataFrame(rows, "id string, phone_e164 string, address_key string, name_key string, lat double, lon double")
    table.createOrReplaceTempView("met_once")
    step = "0.25 / cast(111.32 as double)"
    box = f"abs(p.lat - i.lat) <= {step} AND abs(p.lon - i.lon) <= ({step}) / greatest(0.01, cos(radians(i.lat)))"
    keys = " OR ".join(f"(i.{c} = p.{c} AND i.{c} <> '')" for c in ("phone_e164", "address_key", "name_key"))
    for got, on in ((identity.near_pairs(table, table), box), (identity.blocking_pairs(table, table), f"{keys} OR ({box})")):
        want = spark.sql(f"SELECT i.id, p.id FROM met_once i JOIN met_once p ON {on}")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "Aggregate" not in plan_of(got)


def test_search_results_are_read_before_businesses_meet_them(spark):
    rows = spark.createDataFrame([(f"b{k}", "Same Name", "Town", None, None) for k in range(20)], "id string, name string, city string, street string, phone_e164 string")
    query = '"Same Name" Town'
    urls = ["www.own.de/a", "ftp://x.de", "https://own.de/b", "https://www.facebook.com/p", "https://other.de"]
    results = spark.createDataFrame([(query, n, u, "t", "s") for n, u in enumerate(urls)], "query string, rank int, url string, title string, snippet string")
    hits, _ = website.search_channel(rows, results, spark.createDataFrame([(query, "ok")], "query string, status string"))
    assert "regexp_" not in plan_of(hits).split("Join Inner")[0]
    want = {("candidate", 1, "https://www.own.de/a", "own.de"), ("candidate", 2, "https://other.de/", "other.de"), ("social", 1, "https://www.facebook.com/p", "facebook.com")}
    assert {tuple(r) for r in hits.collect()} == {(f"b{k}", *w) for k in range(20) for w in want}


def test_page_scores_are_dealt_over_cores(spark):
    """Scoring is more work than reading, so one file's rows are not one task's."""
    out = website_queries.d11_d12_page_scores(spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_verification_runs_join_their_tables_once(spark, monkeypatch):
    """What a run writes is a part of tables that are stored by run, and no join of its own."""
    plans, write = [], lead_queries.write_verifications
    monkeypatch.setattr(lead_queries, "write_verifications", lambda *x: plans.extend(map(plan_of, x[:3])) or write(*x))
    assert lead_queries.k2_verification_store(spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 12 and not any("Join" in p or "Window" in p or "Aggregate" in p for p in plans)


def test_names_of_a_block_are_compared_on_all_cores(spark):
    """A few kilobytes of names meet many partners each; they are not one task's."""
    names = spark.range(300).select((F.col("id") % 40).alias("key"), F.col("id").alias("x"))
    known = spark.range(300).select((F.col("id") % 40).alias("key"), F.col("id").alias("y"), F.format_string("b%03d", "id").alias("business_id"))
    out = matching.first_match(names, known, "key", lambda: F.col("y") > F.col("x"))
    assert "RepartitionByExpression" in plan_of(out)
    assert {(r.x, r.business_id) for r in out.collect()} == {(x, f"b{x + 40:03d}") for x in range(260)}


def test_blocking_pairs_are_made_on_all_cores(spark):
    """Rows are few bytes and their pairs many: rows are dealt by keys, and no pair works out the width of a box."""
    table = spark.createDataFrame([("r1", "+49", "a", "n", 48.0, 11.0)], "id string, phone_e164 string, address_key string, name_key string, lat double, lon double")
    plan = plan_of(identity.blocking_pairs(table, table))
    assert plan.count("RepartitionByExpression") == 8
    assert not any("COS" in line.upper() for line in plan.splitlines() if "Join" in line)
