"""Windows in order, verification runs and stale checks, groups, redirects, keyword search, pages, against plain Python."""

from __future__ import annotations

import json
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from larkfield.functions import html
from larkfield.operators import graph, identity, leads, ordering, website
from larkfield.sources.records import read_verifications, write_verifications


def windows(events: list[tuple], limit: int, width: int) -> set[tuple]:
    out, state = set(), {}
    for key, ts, n in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        reset, seen = state.get(key, (None, 0))
        if reset is None or ts >= reset:
            reset, seen = ts + width, 0
        state[key] = reset, seen + 1
        ok = seen + 1 <= limit
        out.add((key, ts, n, ok, max(0, limit - seen - 1), 0 if ok else reset - ts))
    return out


@pytest.mark.parametrize("fold", [0, 30, 10_000])
def test_windows_open_with_the_data(spark, fold):
    rng = random.Random(fold)
    events = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([rng.randrange(-500, 3000), 50, 51]), k) for k in range(400)] + [("one", 7, 1000)]
    rows = spark.createDataFrame(events, "key string, ts_ms long, event_id long")
    got = leads.admissions(rows.unionByName(spark.createDataFrame([("a", None, 5)], rows.schema)).repartition(5), 3, 40, fold)
    assert {tuple(r) for r in got.collect()} == windows(events, 3, 40)
    assert leads.admissions(rows.limit(0), 3, 40, fold).count() == 0


def test_windows_of_one_large_key(spark):
    """A window for every few events: more windows than rounds could follow one by one."""
    rows = spark.range(100_000).select(F.lit("k").alias("key"), (F.col("id") * 7).alias("ts_ms"), F.col("id").alias("event_id"))
    got = leads.admissions(rows, 2, 20, 100).groupBy("allowed").count().collect()
    assert {r["allowed"]: r["count"] for r in got} == {True: 66_667, False: 33_333}


def test_places_in_keys(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("key"), F.xxhash64("id").alias("t"), "id")
    got = ordering.ranked(rows, ["key"], ["t", "id"]).collect()
    for key in (0, 1):
        own = sorted((r.t, r.id, r.k) for r in got if r.key == key)
        assert [k for *_, k in own] == [*range(2500)]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    links = spark.range(10_000).select(F.format_string("n%05d", "id").alias("a"), F.format_string("n%05d", F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([("x", "y"), ("z", "z"), (None, "q")], "a string, b string"))
    found = graph.components(links.repartition(3)).groupBy("component").count().collect()
    assert {tuple(r) for r in found} == {("n00000", 10_001), ("x", 2)} and len(rounds) < 20


def test_loads_with_conflicts(spark):
    """A refreshed and a matched record with another phone need review too; a group of the load goes to one business."""
    fields = "id string, provider string, external_id string, name string, street string, house_number string, postal_code string, city string, country_code string, lat double, lon double, phone string, category string"
    full = ("Ufer", "1", "10115", "Berlin", "DE", 52.5, 13.4)
    make = lambda *rows: identity.build_identity(spark.createDataFrame([(r[0], "map", r[0], r[1], *full, r[2], "cafe") for r in rows], fields))
    pool = make(("p", "Optik Nord", "030 1234567"))
    rows = make(("a", "Optik Nord", "030 7777777"), ("b", "Optik Nord", "030 1234567"), ("c", "Optik Nord", "030 1234567"), ("d", " ", None))
    sources = rows.where("id = 'c'").select("provider", "external_id", F.lit("p").alias("business_id"))
    out = identity.load_discovered(rows, pool, sources)
    assert {tuple(r) for r in out.select("incoming_id", "business_id", "outcome", "conflict").collect()} == {("a", "p", "needs_review", True), ("b", "p", "duplicate", False), ("c", "p", "refreshed", False), ("d", None, "rejected", False)}
    items = spark.createDataFrame([("r", "needs_review", True), ("r", "needs_review", False), ("r", "duplicate", False), ("r", "refreshed", True), ("r", "refreshed", None), ("r", "rejected", False), ("r", "new", False)], "run_id string, outcome string, conflict boolean")
    assert leads.run_statistics(items).first().asDict() == {"run_id": "r", "found": 7, "n_new": 1, "n_duplicate": 2, "n_refreshed": 2, "n_needs_review": 3, "n_excluded": 1}


def test_merging_fills_what_is_missing(spark):
    kind = "id string, phone_e164 string, street string, house_number string, postal_code string, city string, address_key string, email string, opening_hours_raw string, opening_hours_source string, lat double, lon double, identity_status string, identity_confidence int"
    pool = spark.createDataFrame([("p", "+491", None, "", "10115", "Berlin", None, None, "", None, None, None, "PROBABLE", 60), ("q", None, None, None, None, None, None, "a@b", "24/7", "map", 1.0, 2.0, "PROBABLE", 60)], kind)
    add = spark.createDataFrame([("p", None, "Ring", "2", "10115", None, "k", "x@y", "Mo 9-10", "places", 5.0, 6.0)], "business_id string, phone_e164 string, street string, house_number string, postal_code string, city string, address_key string, email string, opening_hours_raw string, opening_hours_source string, lat double, lon double")
    got = {r.id: r for r in identity.merge_matched(pool, add, as_of_ms=9).collect()}
    p, q = got["p"], got["q"]
    assert (p.phone_e164, p.street, p.house_number, p.city, p.address_key, p.email, p.opening_hours_raw, p.opening_hours_source, p.lat, p.lon) == ("+491", "Ring", "2", "Berlin", "k", "x@y", "Mo 9-10", "places", 5.0, 6.0)
    assert (p.identity_status, p.identity_confidence, p.last_seen_ms, p.touched, q.email, q.last_seen_ms, q.touched) == ("CONFIRMED", 75, 9, True, "a@b", None, False)


def test_redirects_by_paths_of_double_length(spark):
    rng = random.Random(3)
    hops = {f"h{k}.de": f"https://www.h{rng.randrange(60)}.de/" for k in range(60) if rng.random() < 0.7}
    rows = spark.createDataFrame([*hops.items(), ("h1.de", "zzz"), ("h2.de", None)], "host_path string, redirect_to string")
    hops.setdefault("h1.de", "zzz")
    start = spark.createDataFrame([(f"https://h{k}.de", k) for k in range(60)], "url string, n int")
    for r in website.follow_redirects(start, rows).collect():
        path, at = [], f"h{r.n}.de"
        while at in hops and len(path) < 6:
            path.append(hops[at])
            at = hops[at].removeprefix("https://www.").removesuffix("/")
        assert (r.redirects, r.too_many, r.final_url) == (path[:5], len(path) > 5, (path[:5] or [r.url])[-1])


def test_keyword_search_equals_counting(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    pick = lambda n: [words[min(int(rng.expovariate(0.12)), 39)] for _ in range(n)]
    docs = [(k, pick(rng.choice([1, 2, 3, 8, 40]))) for k in range(300)] + [(900, []), (901, None)]
    asked = [(k, " ".join(pick(rng.choice([1, 2, 6, 20])))) for k in range(25)] + [(90, ""), (91, None)]
    want = set()
    for qid, text in asked:
        own, rows = set((text or "").split()), []
        for doc, keys in docs:
            hits = len(own & set(keys or []))
            if hits >= 2:
                rows.append((-hits / len(set(keys)), -hits, doc))
        want |= {(qid, doc, -hits, n + 1) for n, (_, hits, doc) in enumerate(sorted(rows)[:10])}
    got = website.keyword_search(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(docs, "doc_id int, keywords array<string>"))
    assert {(r.query_id, r.doc_id, r.hits, r["rank"]) for r in got.collect()} == want


def test_keyword_search_counts_hits_where_documents_lie(spark, monkeypatch):
    """No shuffle by word or by document and query: hits are counted in the documents' partitions, and bounds of the first documents lose nothing."""
    docs = spark.createDataFrame([(k, [f"w{j}" for j in range(k % 7, 12)]) for k in range(200)], "doc_id int, keywords array<string>")
    asked = spark.createDataFrame([(k, f"w{k} w{k + 3} w{k + 5} w11") for k in range(6)], "query_id int, text string")
    monkeypatch.setattr(website, "FIRST", 3)
    got = website.keyword_search(asked, docs)
    dealt = re.findall(r"Exchange hashpartitioning\((\w+?)#", got._jdf.queryExecution().executedPlan().toString())
    assert set(dealt) == {"doc_id", "query_id"} and not re.search(r"hashpartitioning\(query_id#\d+, doc_id", got._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(website, "FIRST", 10**9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, website.keyword_search(asked, docs).collect())) != []


def test_runs_are_visible_as_a_whole(spark):
    path = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    write_verifications(table(1), table(10, 11), table(100), path, "a")
    write_verifications(table(2), table(20), table(200), path, "b")
    write_verifications(table(3), table(30), table(300, 301), path, "a")  # again: replaces the first
    table(4).write.parquet(f"{path}/verifications/run=c/attempt=broken")  # half a run
    table(5).write.parquet(f"{path}/candidates/run=b/attempt=broken")
    got = {name: {(r.run, r.v) for r in df.collect()} for name, df in read_verifications(spark, path).items()}
    assert got == {"verifications": {("a", 3), ("b", 2)}, "candidates": {("a", 30), ("b", 20)}, "evidence": {("a", 300), ("a", 301), ("b", 200)}}


B = "id string, name string, street string, house_number string, postal_code string, city string, country_code string, lat double, lon double, phone string, phone_e164 string, website string, category string, identity_status string, identity_confidence int, website_status string, website_confidence int, checked_ms long"


def business(key: str, status: str = "CONFIRMED", checked: int | None = None, name: str = "Optik Nordlicht"):
    return (key, name, "Ufer", "1", "10115", "Berlin", "DE", 52.5, 13.4, None, "+49301234567", None, "optician", status, 90, "NOT_CHECKED", None, checked)


def crawl(spark, results=(), statuses=None, pages=(), hops=()):
    signals = "host_path string, http_status int, fetch_error string, retryable boolean, title string, text string, normalized string, phones array<string>, postal_codes array<string>, is_parked boolean, is_placeholder boolean, is_empty boolean, links array<string>, structured array<struct<type:string,name:string,telephone:string,street:string,postal:string,locality:string,url:string>>"
    page = [(p, 200, None, True, t, x, x.lower(), ph, pc, False, False, False, links, []) for p, t, x, ph, pc, links in pages]
    return (
        spark.createDataFrame(list(results), "query string, rank int, url string, title string, snippet string"),
        spark.createDataFrame(list(statuses or ()), "query string, status string"),
        spark.createDataFrame(page, signals),
        spark.createDataFrame(list(hops), "host_path string, redirect_to string"),
    )


QUERIES = ('"Optik Nordlicht" Berlin', '"Optik Nordlicht" Ufer Berlin', '"Optik Nordlicht" +49301234567')
DAY = 86_400_000


def test_stale_checks_are_written_back(spark):
    """Latest payload and sources count, the stored status wins, a broken check says so, a second run checks nothing."""
    rows = spark.createDataFrame([business("a"), business("b", "NEEDS_REVIEW"), business("c", checked=100 * DAY), business("d", checked=1), business("e", name="Cafe Sonne")], B)
    payload = lambda site, social=None: json.dumps({"website": site, "socialUrls": social})
    sources = spark.createDataFrame([("map", "1", "a", 1, payload("https://old.de")), ("places", "2", "a", 2, payload("https://www.optik-nordlicht.de/")), ("map", "3", "d", 1, None)], "provider string, external_id string, business_id string, fetched_ms long, raw_json string")
    text = "Optik Nordlicht Ufer 1 10115 Berlin Telefon 030 1234567 und vieles mehr in unserem Laden"
    tables = crawl(spark, statuses=[(q, "ok") for q in QUERIES], pages=[("optik-nordlicht.de", "Optik Nordlicht", text, ["+49301234567"], ["10115"], [])])
    failed = spark.createDataFrame([("d",)], "business_id string")
    after, found = website.check_stale(rows, sources, *tables, as_of_ms=101 * DAY, failed=failed)
    got = {r.id: (r.website_status, r.website_url, r.checked_ms) for r in after.collect()}
    assert got["a"] == ("VERIFIED_WEBSITE", "https://www.optik-nordlicht.de/", 101 * DAY)
    assert got["b"][0] == "IDENTITY_UNVERIFIED" and got["c"] == ("NOT_CHECKED", None, 100 * DAY) and got["d"] == ("REQUIRES_MANUAL_CHECK", None, 101 * DAY)
    assert {r.business_id for r in found.concluded.collect()} == {"a", "b", "d", "e"}
    again, none = website.check_stale(after, sources, *tables, as_of_ms=101 * DAY)
    assert none.concluded.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, after.collect()))


def test_statements_and_their_stances(spark):
    """Profiles stated beside the website, link pages, listings; only what speaks against a candidate contradicts."""
    b = identity.build_identity(spark.createDataFrame([business("a")], B).withColumn("phone", F.col("phone_e164")).drop("phone_e164", "identity_status", "identity_confidence")).withColumn("social_urls", F.array(F.lit("https://www.instagram.com/nordlicht"), F.lit("https://example.org/x")))
    results = [(QUERIES[0], 0, "https://www.yelp.de/biz/a", "t", "s"), (QUERIES[0], 1, "https://weak.de/", "t", "s"), (QUERIES[0], 2, "https://against.de/", "t", "s"), *[(QUERIES[1], k, f"https://www.yelp.de/biz/{k}", "t", "s") for k in range(6)], ('"nordlicht" Berlin', 0, "https://linktr.ee/nordlicht", "t", "s")]
    plain = "Willkommen bei uns, wir haben vieles und noch viel mehr zu bieten als andere"
    pages = [("weak.de", "Optik Nordlicht", plain + " Optik Nordlicht", [], [], []), ("against.de", "Optik Nordlicht", plain, ["+49309999999"], [], []), ("linktr.ee/nordlicht", "x", plain, [], [], ["https://own-shop.de/"])]
    tables = crawl(spark, results, [(q, "ok") for q in (*QUERIES[:2], '"nordlicht" Berlin')] + [(QUERIES[2], "error")], pages)
    rows = website.evidence(website.verify_websites(b, *tables)).orderBy("seq").collect()
    said = {(r.kind, r.url): r.stance for r in rows}
    assert said[("candidate_rejected", "https://weak.de/")] == "neutral" and said[("candidate_rejected", "https://against.de/")] == "contradicts"
    assert said[("channel_search_engine", None)] == "contradicts" and said[("channel_provider_field", None)] == "neutral" and said[("identity", None)] == "supports"
    assert ("social_profile", "https://www.instagram.com/nordlicht") in {(k, u.rstrip("/") if u else u) for k, u in said}
    assert any(k == "link_in_bio" and "linktr.ee/nordlicht" in u for k, u in said) and any(u and "own-shop.de" in u for _, u in said)
    kinds = [r.kind for r in rows]
    assert kinds.count("directory_listing") == 5 and kinds[0] == "identity" and kinds[-1] == "conclusion"


def entities(text: str) -> str:
    def one(m: re.Match) -> str:
        code = int(m[2], 16) if m[1] else int(m[2])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&#([xX])?([0-9a-fA-F]+);", lambda m: one(m) if m[1] or m[2].isdigit() else m[0], text)


def things(value: object, depth: int = 0) -> list:
    if depth > 4 or not isinstance(value, dict | list):
        return []
    if isinstance(value, list):
        return [x for v in value for x in things(v, depth + 1)]
    graph_ = value.get("@graph")
    below = things(graph_, depth + 1) if isinstance(graph_, list) else []
    return [value, *below] if value.get("@type") else below


def test_numeric_entities(spark):
    rng = random.Random(2)
    texts = ["", None, "none", "&#0065;&#x0;z", "&#99999999999999999999;", "&#1114112;&#x10FFFF;", "&#xD800;&#55296;"] + ["".join(rng.choice(["&#", "x", "X", ";", "65", "20AC", "1F600", "g", " ", "&", "000"]) for _ in range(8)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.numeric_entities(F.col("t")).alias("out")).collect()
    assert [r.out for r in rows] == [None if r.t is None else entities(r.t) for r in rows]


def test_json_ld_in_lists_and_graphs(spark):
    rng = random.Random(5)

    def value(depth: int) -> object:
        kind = rng.random()
        if depth > 5 or kind < 0.2:
            return rng.choice(["text", 5, None, True, {}])
        if kind < 0.45:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        node = {"name": rng.choice([" a ", "", 7, 1.5, True, None, "b"]), "address": rng.choice([{"postalCode": 10115, "streetAddress": "s"}, "text", None])}
        if rng.random() < 0.7:
            node["@type"] = rng.choice(["Shop", ["A", "B"], "", [], None])
        if rng.random() < 0.6:
            node["@graph"] = rng.choice([value(depth + 1), [value(depth + 1) for _ in range(2)]])
        return node

    text = lambda v: (v.strip() or None) if isinstance(v, str) else str(v) if isinstance(v, int | float) and not isinstance(v, bool) else None
    blocks = [json.dumps(value(0)) for _ in range(120)] + ["{bad", " ", "[[[[{\"@type\":\"kept\"}]]]]", "[[[[[{\"@type\":\"deep\"}]]]]]"]
    pages = [(k, "<p>x</p>" + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks[k : k + 3])) for k in range(0, len(blocks), 3)] + [(999, None), (998, "<p>")]
    for r in spark.createDataFrame(pages, "k int, h string").select("k", html.json_ld_of(F.col("h")).alias("found")).collect():
        want = []
        for block in blocks[r.k : r.k + 3] if r.k < 900 else []:
            try:
                found = things(json.loads(block))
            except ValueError:
                continue
            for n in found:
                a, kind = n.get("address") if isinstance(n.get("address"), dict) else {}, n["@type"]
                want.append((",".join(kind) if isinstance(kind, list) else kind, text(n.get("name")), text(a.get("streetAddress")), text(a.get("postalCode"))))
        assert [(x.type, x.name, x.street, x.postal) for x in r.found] == want
