"""Queries of identity, matching, merging, loads, places and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity as op
from ..operators import matching
from ..operators import places as pl
from ..refdata import CATEGORIES
from ..storage import cut, spread
from . import sqltext as q
from .catalog import query
from .standins import view, with_views


def identity_sql(source: str, extra: str = "") -> str:
    """CTEs ``f`` (normalised fields) and ``i`` (with confidence and status) over a view."""
    return f"""f AS (SELECT id, {extra} lat, lon, category, coalesce({q.clean("name")}, '') AS name, {q.clean("street")} AS street, {q.clean("house_number")} AS house_number, {q.postal("postal_code")} AS postal_code, {q.clean("city")} AS city, 'DE' AS country_code, {q.e164("phone")} AS phone_e164, {q.norm("coalesce(name, '')")} AS nn FROM {source}),
g AS (SELECT *, {q.business_key("nn")} AS name_key, {q.address_key("country_code", "postal_code", "street", "house_number")} AS address_key FROM f),
h AS (SELECT *, least(100, CASE WHEN phone_e164 IS NOT NULL THEN 35 ELSE 0 END + CASE WHEN street IS NOT NULL AND house_number IS NOT NULL AND postal_code IS NOT NULL AND city IS NOT NULL THEN 30 WHEN street IS NOT NULL AND (city IS NOT NULL OR postal_code IS NOT NULL) THEN 15 ELSE 0 END + CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN len({q.tokens("name_key")}) > 0 THEN 8 ELSE 0 END + CASE WHEN category IS NOT NULL THEN 4 ELSE 0 END)::int AS identity_confidence FROM g),
i AS (SELECT *, CASE WHEN name = '' THEN 'UNVERIFIED' WHEN identity_confidence >= 70 THEN 'CONFIRMED' WHEN identity_confidence >= 45 THEN 'PROBABLE' ELSE 'UNVERIFIED' END AS identity_status FROM h)"""


B, D = with_views("v_business"), with_views("v_discovered")


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.build_identity(spread(view(spark, sf_dir, "v_discovered"), "id"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.build_identity(spread(view(spark, sf_dir, "v_business"), "id").drop("identity_status", "identity_confidence", "phone_e164"))


@query(f"{D}, {identity_sql('v_discovered')} SELECT id, name_key, phone_e164, address_key, identity_confidence, identity_status, (phone_e164 IS NOT NULL)::int + (lat IS NOT NULL)::int + (category IS NOT NULL)::int + (name <> '')::int + (len({q.tokens('name_key')}) > 0)::int + (street IS NOT NULL AND (city IS NOT NULL OR postal_code IS NOT NULL))::int AS present FROM i")
def d1_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of each discovered record."""
    return incoming(spark, sf_dir).select("id", "name_key", "phone_e164", "address_key", "identity_confidence", "identity_status", F.size(F.filter("signals", lambda s: s["present"])).alias("present"))


TWO = f"{D}, {identity_sql('v_discovered')}, inc AS (SELECT * FROM i), {identity_sql('v_business').replace('f AS', 'f2 AS', 1).replace('FROM f)', 'FROM f2)').replace('g AS', 'g2 AS', 1).replace('FROM g)', 'FROM g2)').replace('h AS', 'h2 AS', 1).replace('FROM h)', 'FROM h2)').replace('i AS (SELECT', 'pool AS (SELECT', 1)}"
BOX = "inc.lat IS NOT NULL AND pool.lat IS NOT NULL AND abs(pool.lat - inc.lat) <= 0.25 / 111.32::double AND abs(pool.lon - inc.lon) <= (0.25 / 111.32::double) / greatest(0.01, cos(radians(inc.lat)))"
PAIRS = f"{TWO}, pairs AS (SELECT inc.id AS incoming_id, pool.id AS business_id, inc.name_key AS ka, pool.name_key AS kb, inc.phone_e164 AS pa, pool.phone_e164 AS pb, inc.address_key AS aa, pool.address_key AS ab, {q.metres('inc.lat', 'inc.lon', 'pool.lat', 'pool.lon')} AS m FROM inc JOIN pool ON inc.phone_e164 = pool.phone_e164 OR inc.address_key = pool.address_key OR (inc.name_key = pool.name_key AND inc.name_key <> '') OR ({BOX}))"
RULES = """CASE WHEN ph = 'match' THEN CASE WHEN sim >= 0.4 THEN ['same', '100', 'same_phone'] ELSE ['review', '60', 'shared_phone'] END WHEN aa = ab AND ph = 'mismatch' AND sim < 0.6 THEN ['none', '0', 'same_building'] WHEN aa = ab AND sim >= 0.6 THEN ['same', '90', 'same_address']
WHEN m <= 60 AND sim >= 0.85 THEN CASE WHEN ph = 'mismatch' THEN ['review', '55', 'same_point_other_phone'] ELSE ['same', '80', 'same_point'] END WHEN sim >= 0.85 THEN CASE WHEN ph = 'mismatch' OR aa <> ab OR m > 60 THEN ['branch', '40', 'same_name_elsewhere'] ELSE ['review', '50', 'same_name_only'] END END"""
DECIDED = f"{PAIRS}, s AS (SELECT *, {q.key_sim('ka', 'kb')} AS sim, {q.compare('pa', 'pb')} AS ph FROM pairs), r AS (SELECT incoming_id, business_id, {RULES} AS rule FROM s), dec AS (SELECT incoming_id, business_id, rule[1] AS kind, rule[2]::int AS score, rule[3] AS reason_code FROM r WHERE rule IS NOT NULL), best AS (SELECT * FROM dec QUALIFY row_number() OVER (PARTITION BY incoming_id ORDER BY CASE kind WHEN 'same' THEN 0 WHEN 'review' THEN 1 WHEN 'branch' THEN 2 ELSE 3 END, score DESC, business_id) = 1)"


@query(f"{TWO} SELECT inc.id AS incoming_id, pool.id AS business_id FROM inc JOIN pool ON {BOX}")
def j3_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points near each other, by grid cells."""
    return op.near_pairs(incoming(spark, sf_dir), pool(spark, sf_dir))


@query(f"{PAIRS} SELECT incoming_id, business_id FROM pairs")
def j2_u1_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of the four keys."""
    return op.blocking_pairs(cut(incoming(spark, sf_dir)), cut(pool(spark, sf_dir)))


@query(f"{DECIDED} SELECT * FROM best")
def j02_d02_w04_match_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best decision of each discovered record."""
    return matching.match_records(incoming(spark, sf_dir), pool(spark, sf_dir))


@query(f"""{DECIDED}, m AS (SELECT business_id, min(incoming_id) AS incoming_id FROM best WHERE kind = 'same' GROUP BY business_id), j AS (SELECT p.*, m.incoming_id IS NOT NULL AS touched, x.phone_e164 AS xp, x.street AS xs, x.postal_code AS xc, x.city AS xt, x.lat AS xlat, coalesce(p.phone_e164 <> x.phone_e164, false) AS c1, coalesce(p.postal_code <> x.postal_code, false) AS c2 FROM pool p LEFT JOIN m ON m.business_id = p.id LEFT JOIN inc x ON x.id = m.incoming_id)
SELECT id, coalesce(phone_e164, xp) AS phone_e164, coalesce(street, xs) AS street, coalesce(postal_code, xc) AS postal_code, coalesce(city, xt) AS city, coalesce(lat, xlat) AS lat, concat_ws(',', CASE WHEN c1 THEN 'phone' END, CASE WHEN c2 THEN 'postal_code' END) AS conflicts,
CASE WHEN c1 OR c2 THEN 'NEEDS_REVIEW' WHEN touched AND identity_status <> 'NEEDS_REVIEW' AND identity_confidence + 15 >= 70 THEN 'CONFIRMED' ELSE identity_status END AS identity_status, CASE WHEN touched AND NOT (c1 OR c2) THEN least(100, identity_confidence + 15) ELSE identity_confidence END AS identity_confidence FROM j""")
def d3_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: pool rows after matched records fill them."""
    i, p = cut(incoming(spark, sf_dir)), cut(pool(spark, sf_dir))
    best = matching.match_records(i, p).where("kind = 'same'")
    first = best.groupBy("business_id").agg(F.min("incoming_id").alias("id"))
    merged = op.merge_matched(p, i.join(first, "id"))
    return merged.select("id", "phone_e164", "street", "postal_code", "city", "lat", F.array_join("conflicts", ",").alias("conflicts"), "identity_status", "identity_confidence")


@query(f"{with_views('v_discovered', 'v_sources')} SELECT d.id, (SELECT min(s.business_id) FROM v_sources s WHERE s.provider = d.provider AND s.external_id = d.external_id) AS business_id FROM v_discovered d")
def j4_known_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known and unknown source records."""
    known, rest = op.split_known(view(spark, sf_dir, "v_discovered"), view(spark, sf_dir, "v_sources"))
    return known.select("id", "business_id").unionByName(rest.select("id", F.lit(None).cast("string").alias("business_id")))


@query()
def d4_load_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of one load."""
    return op.load_discovered(incoming(spark, sf_dir), pool(spark, sf_dir), view(spark, sf_dir, "v_sources"))


@query()
def u3_verification_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The businesses to verify after the load, new and touched."""
    return op.verification_queue(d4_load_outcomes(spark, sf_dir))


@query(f"""{B}, t AS (SELECT id, list_sort({q.tokens(q.business_key(q.norm("name")))}) AS t FROM v_business) SELECT lower('DE|' || array_to_string(t, '-')) AS brand, count(*) AS locations FROM t WHERE len(t) > 0 GROUP BY 1""")
def a5_branch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: locations of each brand."""
    return op.branch_groups(view(spark, sf_dir, "v_business"))


KEY = "concat_ws(',', printf('%.4f', lat), printf('%.4f', lon))"


@query(f"""{B}, c AS (SELECT {KEY} AS key, min(id) AS id FROM v_business WHERE lat IS NOT NULL AND street IS NOT NULL GROUP BY 1), e AS (SELECT c.key, b.street, b.postal_code, b.city FROM c JOIN v_business b USING (id)), r AS (SELECT *, CASE WHEN phone IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND k % 6 = 5 THEN {KEY} END AS key FROM v_business)
SELECT r.id, CASE WHEN k % 6 = 5 THEN e.street ELSE r.street END AS street, CASE WHEN k % 6 = 5 THEN e.postal_code ELSE r.postal_code END AS postal_code, CASE WHEN k % 6 = 5 THEN e.city ELSE r.city END AS city, coalesce(e.street, e.postal_code, e.city) IS NOT NULL AS from_reverse FROM r LEFT JOIN e USING (key)""")
def j7_address_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses read back from coordinates where a record has none."""
    b = view(spark, sf_dir, "v_business")
    key = F.concat_ws(",", F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"))
    fields = ("street", "house_number", "postal_code", "city")
    cache = b.where("lat is not null and street is not null").withColumn("key", key).groupBy("key").agg(F.min_by(F.struct(*fields), "id").alias("x")).select("key", "x.*")
    bare = b.withColumns({c: F.when(F.col("k") % 6 != 5, F.col(c)) for c in fields})
    return op.enrich_addresses(bare, cache).select("id", "street", "postal_code", "city", "from_reverse")


@query(f"""{with_views("v_business", "v_place")}, d AS (SELECT b.id, p.label, {q.metres("b.lat", "b.lon", "p.lat", "p.lon")} AS m, p.ordinal FROM v_business b, v_place p WHERE b.lat IS NOT NULL) SELECT id, label, round(m, 2) AS metres FROM d WHERE m <= 25000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, ordinal) = 1""")
def j8_nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest gazetteer place within 25 km."""
    return pl.nearest_place(view(spark, sf_dir, "v_business"), view(spark, sf_dir, "v_place")).select("id", "label", F.round("metres", 2).alias("metres"))


@query(f"""{with_views("v_business", "v_place")}, x AS (SELECT DISTINCT concat('Nähe STADT ', cast(k % 30 AS string), CASE WHEN k % 2 = 0 THEN ' Mitte' ELSE '' END) AS query FROM v_business), n AS (SELECT query, {q.norm("query")} AS t FROM x) SELECT query, arg_min(label, ordinal) AS label FROM n JOIN v_place p ON contains(n.t, p.alias) GROUP BY query""")
def j9_place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places named in a query; the first wins."""
    asked = view(spark, sf_dir, "v_business").selectExpr("concat('Nähe STADT ', cast(k % 30 AS string), CASE WHEN k % 2 = 0 THEN ' Mitte' ELSE '' END) AS query").distinct()
    return pl.lookup_places(asked, view(spark, sf_dir, "v_place")).select("query", "label")


@query(f"{B} SELECT id FROM v_business WHERE {q.metres('lat', 'lon', '48.2', '11.1')} <= 6000")
def f6_radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """businesses within six kilometres; the box is the part that a scan can push down."""
    return pl.within_radius(view(spark, sf_dir, "v_business"), 48.2, 11.1, 6.0).select("id")


@query(f"{B} SELECT id FROM v_business WHERE {q.metres('lat', 'lon', '48.2', '11.1')} <= 12000 AND category = 'furniture' ORDER BY id LIMIT 40")
def f7_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ten wanted of a category near a point, with the over-fetch of four times that."""
    return pl.discover(view(spark, sf_dir, "v_business"), 48.2, 11.1, 12.0, "furniture", 10).select("id")


F9 = "trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^a-z0-9 ]+', ' ', 'g'))"
SYN = "(VALUES " + ", ".join(f"({n}, '{key}', '{s}')" for n, (key, _, syn) in enumerate(CATEGORIES) for s in (key, *syn)) + ") c(n, key, s)"
TAG = "(VALUES " + ", ".join(f"({n}, '{key}', '{t}')" for n, (key, tags, _) in enumerate(CATEGORIES) for t in tags) + ") c(n, key, tag)"


@query(f"""{B}, x AS (SELECT id, {F9} AS t FROM (SELECT id, CASE k % 5 WHEN 0 THEN name WHEN 1 THEN concat('find ', name, 's near me') WHEN 2 THEN 'Frisëur & Barbers' WHEN 3 THEN category ELSE '' END AS text FROM v_business)) SELECT id, arg_min(key, n) AS category FROM x JOIN {SYN} ON t <> '' AND regexp_matches(t, '(^|\\s)' || s || '(s|es)?(\\s|$)') GROUP BY id""")
def f9_category_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """categories named in free text."""
    rows = view(spark, sf_dir, "v_business").selectExpr("id", "CASE k % 5 WHEN 0 THEN name WHEN 1 THEN concat('find ', name, 's near me') WHEN 2 THEN 'Frisëur & Barbers' WHEN 3 THEN category ELSE '' END AS text")
    return rows.select("id", pl.category_of_text(F.col("text")).alias("category")).where("category is not null")


@query(f"""{B}, x AS (SELECT id, unnest([CASE k % 4 WHEN 0 THEN 'shop=florist' WHEN 1 THEN 'amenity=cafe' WHEN 2 THEN 'craft=none' ELSE 'shop=beauty' END, CASE WHEN k % 3 = 0 THEN 'craft=plumber' ELSE 'a=b' END]) AS tag FROM v_business) SELECT id, arg_min(key, n) AS category FROM x JOIN {TAG} USING (tag) GROUP BY id""")
def f10_category_of_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """categories of source tags."""
    first = "CASE k % 4 WHEN 0 THEN struct('shop' AS k, 'florist' AS v) WHEN 1 THEN struct('amenity' AS k, 'cafe' AS v) WHEN 2 THEN struct('shop' AS k, 'none' AS v) ELSE struct('shop' AS k, 'beauty' AS v) END"
    second = "CASE WHEN k % 3 = 0 THEN struct('craft' AS k, 'plumber' AS v) ELSE struct('a' AS k, 'b' AS v) END"
    rows = view(spark, sf_dir, "v_business").withColumn("tags", F.expr(f"map_from_entries(array({first}, {second}))"))
    return rows.select("id", pl.category_of_tags(F.col("tags")).alias("category")).where("category is not null")


@query(f"""{B}, a AS (SELECT id, k, name FROM v_business) SELECT concat('node/', cast(k AS string)) AS external_id, trim(name) AS name, CASE WHEN k % 2 = 0 THEN 'hairdresser' ELSE 'cafe' END AS category, coalesce(lat, 1.5) AS lat, phone, CASE WHEN website <> '' THEN website END AS website FROM a JOIN (SELECT k, lat, nullif(trim(phone), '') AS phone, trim(website) AS website FROM v_business) USING (k) WHERE k % 10 <> 7""")
def s1_map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map-feature JSON, made from the business table and read with the fixed schema."""
    from ..sources.records import FEATURE, from_features

    b = view(spark, sf_dir, "v_business")
    tags = F.create_map(F.lit("name"), F.when(F.col("k") % 10 != 7, F.col("name")), F.when(F.col("k") % 2 == 0, "shop").otherwise("amenity"), F.when(F.col("k") % 2 == 0, "hairdresser").otherwise("cafe"), F.lit("phone"), F.col("phone"), F.lit("website"), F.col("website"))
    js = F.to_json(F.struct(F.lit("node").alias("type"), F.col("k").alias("id"), "lat", "lon", F.when(F.col("lat").isNull(), F.struct(F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"))).alias("center"), tags.alias("tags")))
    return from_features(b.select(F.from_json(js, FEATURE).alias("r")).select("r.*")).select("external_id", "name", "category", "lat", "phone", "website")


@query(f"""{B} SELECT concat('p', cast(k AS string)) AS external_id, coalesce(name, '(no name)') AS name, CASE WHEN k % 2 = 0 THEN {q.clean("street")} ELSE 'Long Lane' END AS street, CASE WHEN k % 2 = 0 THEN house_number ELSE '12' END AS house_number, postal_code, lat FROM v_business""")
def s2_place_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place JSON; address parts by type, else from the address line."""
    from ..functions.text import clean_string
    from ..sources.records import PLACE, from_places

    part = lambda c, kind: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("longText"), F.array(F.lit(kind)).alias("types")))
    b = view(spark, sf_dir, "v_business").withColumn("street", F.coalesce(clean_string(F.col("street")), F.lit(None)))
    route = F.when(F.col("k") % 2 == 0, part("street", "route"))
    number = F.when(F.col("k") % 2 == 0, part("house_number", "street_number"))
    line = F.when(F.col("k") % 2 == 1, F.lit("Long Lane 12, 10115 Berlin"))
    js = F.to_json(F.struct(F.concat(F.lit("p"), F.col("k").cast("string")).alias("id"), F.struct(F.col("name").alias("text")).alias("displayName"), F.array_compact(F.array(route, number, part("postal_code", "postal_code"))).alias("addressComponents"), line.alias("formattedAddress"), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("location")))
    return from_places(b.select(F.from_json(js, PLACE).alias("r")).select("r.*")).select("external_id", "name", "street", "house_number", "postal_code", "lat")


@query(f"""{B} SELECT id, checked_ms // 1000 AS checked_s, k % 23 = 0 AS is_demo, k % 5 AS n, CASE WHEN k % 7 <> 0 THEN name END AS label FROM v_business""")
def s3_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: stored rows in their types; malformed JSON gives null."""
    from ..sources.records import typed

    raw = view(spark, sf_dir, "v_business").select("id", "k", F.col("checked_ms").alias("checked_at"), F.col("is_demo").cast("int").alias("is_demo"), F.when(F.col("k") % 7 == 0, F.lit('{"label":')).otherwise(F.to_json(F.struct(F.col("name").alias("label")))).alias("extra"))
    rows = typed(raw, times=["checked_at"], flags=["is_demo"], nested={"extra": "label string"})
    return rows.select("id", F.unix_seconds("checked_at").alias("checked_s"), "is_demo", (F.col("k") % 5).alias("n"), "extra.label")
