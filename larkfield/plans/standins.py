"""Domain tables made from the given ones.

Each view is one SQL text that Spark and DuckDB both run, so a query and its
SQL read the same rows. Times are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The instant that all registered queries take as now: 2024-06-01 12:00 UTC.
AS_OF = 1_717_243_200_000

NAME = "CASE {k} % 7 WHEN 0 THEN concat(p.p_name, ' GmbH') WHEN 1 THEN concat('Café ', p.p_name) WHEN 2 THEN concat(p.p_name, ' & Söhne') WHEN 3 THEN concat('MÜLLER ', p.p_name, ' Ltd.') WHEN 4 THEN concat('Salon ', p.p_name) ELSE p.p_name END"
STREET = "CASE {k} % 6 WHEN 0 THEN 'Bahnhofstraße' WHEN 1 THEN 'Haupt  Street' WHEN 2 THEN 'Am Alten Platz' WHEN 3 THEN 'Lindenstr.' WHEN 4 THEN 'Park Road' END"
PHONE = "CASE {k} % 8 WHEN 0 THEN NULL WHEN 1 THEN concat('+49 30 ', cast(1000000 + {k} % 700 AS string)) WHEN 2 THEN concat('030/', cast(1000000 + {k} % 700 AS string)) WHEN 3 THEN concat('(030) ', cast(1000000 + {k} % 700 AS string)) WHEN 4 THEN concat('0049 (0)30-', cast(1000000 + {k} % 700 AS string)) WHEN 5 THEN '123' ELSE concat(' +4930', cast(1000000 + {k} % 700 AS string)) END"
CITY = "CASE {k} % 5 WHEN 0 THEN 'München' WHEN 1 THEN 'Köln' WHEN 2 THEN 'Berlin' WHEN 3 THEN 'Bad Homburg' END"
WEBSITE = "CASE {k} % 9 WHEN 0 THEN concat('https://www.', replace(p.p_name, ' ', '-'), '.de/Kontakt#top') WHEN 1 THEN concat('HTTP://', replace(p.p_name, ' ', ''), '.Example.co.uk') WHEN 2 THEN concat('https://www.facebook.com/', replace(p.p_name, ' ', '.'), '/') WHEN 3 THEN 'https://www.yelp.de/biz/abc' WHEN 4 THEN concat('shop.', replace(p.p_name, ' ', ''), '.com?q=1') WHEN 5 THEN '' WHEN 6 THEN 'ftp://files.example.org/x' WHEN 7 THEN concat('instagram.com/p/', replace(p.p_name, ' ', '')) END"
HOURS = "CASE {k} % 8 WHEN 0 THEN 'Mo-Fr 09:00-18:00; Sa 10:00-14:00' WHEN 1 THEN 'Mo-Sa 10-12,14.30-19; We off' WHEN 2 THEN '24/7' WHEN 3 THEN 'Fr-Mo 18:00-02:00; PH off' WHEN 4 THEN NULL WHEN 5 THEN 'by appointment' WHEN 6 THEN 'Di,Do 08:00-12:00; Su-Tu 15:00-20:00; Mo geschlossen; Mo 9-10' ELSE '  ' END"
ZONE = "CASE {k} % 3 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'America/New_York' ELSE 'UTC' END"

VIEWS = {
    "v_business": f"""SELECT p.p_partkey AS k, concat('b', lpad(cast(p.p_partkey AS string), 10, '0')) AS id, {NAME} AS name, {STREET} AS street,
        CASE WHEN {{k}} % 11 = 0 THEN NULL ELSE cast({{k}} % 90 + 1 AS string) END AS house_number, CASE WHEN {{k}} % 13 = 0 THEN NULL ELSE cast(10115 + ({{k}} % 40) * 7 AS string) END AS postal_code,
        {CITY} AS city, 'DE' AS country_code, CASE WHEN {{k}} % 17 = 0 THEN NULL ELSE 48 + cast({{k}} % 40 AS double) / 100 + cast({{k}} % 9 AS double) / 5000 END AS lat,
        CASE WHEN {{k}} % 17 = 0 THEN NULL ELSE 11 + cast({{k}} % 30 AS double) / 100 + cast({{k}} % 7 AS double) / 3000 END AS lon, {PHONE} AS phone,
        CASE WHEN {{k}} % 8 IN (0, 5) THEN NULL ELSE concat('+4930', cast(1000000 + {{k}} % 700 AS string)) END AS phone_e164, {WEBSITE} AS website, {HOURS} AS opening_hours_raw, {ZONE} AS timezone,
        CASE WHEN {{k}} % 10 = 0 THEN NULL ELSE lower(c.c_mktsegment) END AS category, CASE {{k}} % 4 WHEN 0 THEN 'PROBABLE' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'CONFIRMED' ELSE CASE WHEN {{k}} % 3 = 0 THEN 'NEEDS_REVIEW' ELSE 'UNVERIFIED' END END AS identity_status,
        cast(50 + {{k}} % 51 AS int) AS identity_confidence, CASE {{k}} % 7 WHEN 0 THEN 'VERIFIED_WEBSITE' WHEN 1 THEN 'PROBABLE_WEBSITE' WHEN 2 THEN 'WEBSITE_UNCERTAIN' WHEN 3 THEN 'REQUIRES_MANUAL_CHECK' WHEN 4 THEN 'IDENTITY_UNVERIFIED' WHEN 5 THEN 'VERIFIED_NO_WEBSITE' ELSE CASE WHEN {{k}} % 2 = 0 THEN 'NOT_CHECKED' ELSE 'VERIFIED_NO_WEBSITE' END END AS website_status,
        CASE WHEN {{k}} % 12 = 0 THEN NULL ELSE cast(40 + {{k}} % 60 AS int) END AS website_confidence, CASE WHEN {{k}} % 6 = 0 THEN NULL ELSE {AS_OF} - cast({{k}} % 60 AS bigint) * 86400000 END AS checked_ms,
        CASE WHEN {{k}} % 19 = 0 THEN cast(1700000000000 AS bigint) ELSE NULL END AS excluded_ms, {{k}} % 23 = 0 AS is_demo
        FROM part p LEFT JOIN customer c ON c.c_custkey = p.p_partkey""".replace("{k}", "p.p_partkey"),
    "v_discovered": """SELECT concat('d', lpad(cast(b.k AS string), 10, '0')) AS id, CASE WHEN b.k % 2 = 0 THEN 'map' ELSE 'places' END AS provider, concat('x', cast(b.k AS string)) AS external_id,
        CASE b.k % 12 WHEN 0 THEN concat(upper(b.name), ' KG') WHEN 3 THEN concat(b.name, ' Filiale') WHEN 6 THEN ' ' ELSE b.name END AS name, CASE WHEN b.k % 15 = 0 THEN NULL ELSE b.street END AS street, b.house_number, b.postal_code,
        CASE WHEN b.k % 9 = 0 THEN NULL ELSE b.city END AS city, b.country_code, CASE WHEN b.k % 18 = 0 THEN NULL ELSE b.lat + cast(b.k % 4 AS double) / 4000 END AS lat, b.lon, CASE WHEN b.k % 21 = 0 THEN '+49 89 5551234' ELSE b.phone END AS phone, b.category, b.website
        FROM v_business b
        UNION ALL SELECT concat('s', lpad(cast(s.s_suppkey AS string), 10, '0')), 'places', concat('y', cast(s.s_suppkey AS string)), s.s_name, 'Ring Road', cast(s.s_suppkey % 40 AS string), '20095', 'Hamburg', 'DE',
        cast(53.5 AS double) + cast(s.s_suppkey % 50 AS double) / 2000, cast(10 AS double), concat('040 ', cast(7000000 + s.s_suppkey % 60 AS string)), NULL, NULL FROM supplier s""",
    "v_sources": """SELECT CASE WHEN s.s_suppkey % 2 = 0 THEN 'map' ELSE 'places' END AS provider, concat('x', cast(s.s_suppkey * 3 AS string)) AS external_id, concat('b', lpad(cast(s.s_suppkey * 3 AS string), 10, '0')) AS business_id,
        1700000000000 + cast((s.s_suppkey * 37) % 1000 AS bigint) * 1000 + s.s_suppkey AS fetched_ms, concat('{"n":', cast(s.s_suppkey AS string), '}') AS raw_json FROM supplier s""",
    "v_user": "SELECT concat('u', cast(s.s_suppkey AS string)) AS user_id, s.s_name AS user_name, s.s_suppkey % 5 <> 0 AS is_active FROM supplier s",
    "v_lead": f"""SELECT concat('l', cast(o.o_custkey AS string)) AS lead_id, concat('b', lpad(cast(o.o_custkey AS string), 10, '0')) AS business_id,
        CASE min(o.o_orderkey) % 9 WHEN 0 THEN 'new' WHEN 1 THEN 'ready_to_call' WHEN 2 THEN 'called' WHEN 3 THEN 'no_answer' WHEN 4 THEN 'callback' WHEN 5 THEN 'interested' WHEN 6 THEN 'converted' WHEN 7 THEN 'wrong_number' ELSE 'unknown_status' END AS status,
        CASE WHEN o.o_custkey % 4 = 0 THEN NULL ELSE concat('u', cast(cast(floor(o.o_custkey / 15.0) AS bigint) AS string)) END AS assigned_user_id, cast(o.o_custkey % 3 AS int) AS priority, cast(count(*) % 5 AS bigint) AS call_count,
        CASE WHEN count(*) % 5 = 0 THEN NULL ELSE {AS_OF} - cast(max(o.o_orderkey) AS bigint) * 60000 END AS last_call_ms,
        CASE WHEN o.o_custkey % 5 = 0 THEN {AS_OF} + (cast(o.o_custkey % 7 AS bigint) - 3) * 3600000 ELSE NULL END AS next_callback_ms
        FROM orders o GROUP BY o.o_custkey""",
    "v_change": """SELECT o.o_orderkey AS change_id, concat('l', cast(o.o_custkey AS string)) AS lead_id, CASE o.o_orderstatus WHEN 'O' THEN 'called' WHEN 'F' THEN 'no_answer' ELSE 'interested' END AS to_status,
        1600000000000 + cast((o.o_orderkey * 7919) % 100000 AS bigint) * 60000 AS created_ms, concat('u', cast(cast(floor(o.o_orderkey / 150.0) AS bigint) AS string)) AS user_id FROM orders o""",
    "v_call": f"""SELECT e.event_id AS call_id, concat('l', cast(e.user_id AS string)) AS lead_id, concat('u', cast(cast(floor(e.event_id / 100.0) AS bigint) AS string)) AS user_id, {AS_OF} - cast((e.event_id * 7919) % 20000 AS bigint) * 60000 AS started_ms, {AS_OF} - cast((e.event_id * 31) % 20000 AS bigint) * 60000 AS updated_ms,
        CASE e.event_type WHEN 'click' THEN 'no_answer' WHEN 'view' THEN 'reached' WHEN 'purchase' THEN 'interested' WHEN 'error' THEN 'wrong_number' ELSE 'other' END AS outcome,
        CASE WHEN e.event_id % 6 = 0 THEN {AS_OF} + cast(e.event_id AS bigint) * 1000 ELSE NULL END AS callback_ms, CASE WHEN e.event_id % 10 = 0 THEN 'meeting' ELSE NULL END AS explicit_status, CASE WHEN e.event_id % 3 = 0 THEN 'new' ELSE 'callback' END AS lead_status FROM events e""",
    "v_use": "SELECT e.event_id AS use_id, e.event_type AS provider, 1704067200000 + cast((e.event_id * 7919) % 250000 AS bigint) * 60000 AS ts_ms, cast(e.user_id AS string) AS key, e.event_id AS event_id FROM events e",
    "v_verification": f"""SELECT concat('v', cast(o.o_orderkey AS string)) AS verification_id, concat('b', lpad(cast(o.o_custkey AS string), 10, '0')) AS business_id, 1650000000000 + cast((o.o_orderkey * 7919) % 99991 AS bigint) * 60000 AS finished_ms,
        CASE o.o_orderkey % 4 WHEN 0 THEN 'VERIFIED_WEBSITE' WHEN 1 THEN 'VERIFIED_NO_WEBSITE' WHEN 2 THEN 'REQUIRES_MANUAL_CHECK' ELSE 'WEBSITE_UNCERTAIN' END AS status, CASE WHEN o.o_orderkey % 8 = 0 THEN NULL ELSE concat('https://site', cast(o.o_orderkey AS string), '.de/') END AS url, cast(o.o_orderkey % 100 AS int) AS confidence FROM orders o""",
    "v_judged": """SELECT concat('v', cast(l.l_orderkey AS string)) AS business_id, concat('https://c', cast(l.l_partkey AS string), '.de/') AS url, cast(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS int) AS seq, cast(l.l_quantity * 2 AS int) AS score,
        CASE WHEN l.l_quantity >= 35 THEN 'ACCEPTED' WHEN l.l_quantity >= 23 THEN 'PROBABLE' WHEN l.l_returnflag = 'A' THEN 'UNREACHABLE' ELSE 'REJECTED' END AS decision, CASE WHEN l.l_quantity < 23 AND l.l_returnflag = 'R' THEN 'parked' WHEN l.l_quantity < 23 THEN 'weak' END AS reject_code,
        CASE l.l_linenumber % 3 WHEN 0 THEN 'declared' WHEN 1 THEN 'found' ELSE 'derived' END AS origin, l.l_linestatus = 'O' AS is_named FROM lineitem l""",
    "v_channel": """SELECT concat('v', cast(l.l_orderkey AS string)) AS business_id, CASE l.l_linenumber % 5 WHEN 0 THEN 'provider_field' WHEN 1 THEN 'search_engine' WHEN 2 THEN 'social_profile' WHEN 3 THEN 'domain_guess' ELSE 'directory' END AS channel,
        CASE WHEN max(l.l_discount) >= 0.09 THEN 'error' WHEN max(l.l_discount) >= 0.08 THEN 'unavailable' WHEN max(l.l_discount) < 0.02 THEN 'skipped' ELSE 'ok' END AS status FROM lineitem l GROUP BY l.l_orderkey, l.l_linenumber % 5""",
    "v_place": """SELECT n.n_nationkey AS ordinal, n.n_name AS label, concat('stadt ', cast(n.n_nationkey AS string)) AS alias, 48 + cast(n.n_nationkey AS double) / 50 AS lat, 11 + cast(n.n_nationkey AS double) / 70 AS lon FROM nation n""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark")


def needed(*names: str) -> list[str]:
    """The views with those that they read, in an order that works."""
    out: list[str] = []
    for name in names:
        for other in VIEWS:
            if other != name and f" {other} " in f" {VIEWS[name]} ":
                out += [x for x in needed(other) if x not in out]
        if name not in out:
            out.append(name)
    return out


def with_views(*names: str) -> str:
    """``WITH ...`` for SQL that reads the views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed(*names)) + " "


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    import re

    tables = "|".join(BASE)
    text = re.sub(rf"\b(FROM|JOIN) ({tables})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", with_views(name))
    return spark.sql(f"{text} SELECT * FROM {name}")
