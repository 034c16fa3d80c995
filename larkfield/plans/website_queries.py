"""Queries of website evidence: channels, candidates, scores, status, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hours import opening_status
from ..functions.html import page_signals
from ..operators import website as op
from ..operators.identity import build_identity
from ..operators.leads import page_of
from ..operators.schedules import with_hours
from ..storage import spread
from . import sqltext as q
from .catalog import query
from .identity_queries import B
from .lead_queries import VIEW, joined
from .standins import AS_OF, view, with_views
from .time_queries import LOCAL, WEEK

HOST = q.host("u")
QUERIES_SQL = "list_filter([CASE WHEN coalesce(city, '') <> '' THEN '\"' || trim(name) || '\" ' || city END, CASE WHEN coalesce(city, '') <> '' AND coalesce(street, '') <> '' THEN '\"' || trim(name) || '\" ' || street || ' ' || city END, CASE WHEN phone_e164 IS NOT NULL THEN '\"' || trim(name) || '\" ' || phone_e164 END], lambda x: x IS NOT NULL)"
RANK = "CASE {0} WHEN 'provider_field' THEN 0 WHEN 'search_engine' THEN 1 WHEN 'social_profile' THEN 2 WHEN 'domain_guess' THEN 3 ELSE 4 END"


@query(f"""{B}, u AS (SELECT *, nullif(trim(website), '') AS u FROM v_business), h AS (SELECT *, {HOST} AS h FROM u), d AS (SELECT *, {q.domain("h")} AS d, lower(coalesce(nullif(regexp_extract(u, '^([a-zA-Z]+)://', 1), ''), 'https')) AS scheme FROM h)
SELECT id, CASE WHEN u IS NULL THEN 'none' WHEN scheme NOT IN ('http', 'https') THEN 'unreadable' WHEN d IN ('facebook.com', 'instagram.com') THEN 'social' WHEN d = 'yelp.de' THEN 'directory' ELSE 'declared' END AS kind FROM d""")
def d5_provider_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a profile's website field is."""
    return view(spark, sf_dir, "v_business").withColumn("f", op.provider_field()).select("id", "f.kind")


@query(f"""{B}, l AS (SELECT id, {QUERIES_SQL} AS l, name FROM v_business) SELECT id, generate_subscripts(x, 1) - 1 AS q, unnest(x) AS query FROM (SELECT id, CASE WHEN len(l) = 0 THEN ['"' || trim(name) || '"'] ELSE l END AS x FROM l)""")
def d6_search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of each business."""
    rows = view(spark, sf_dir, "v_business").select("id", F.posexplode(op.search_queries()).alias("q", "query"))
    return rows.withColumn("q", F.col("q").cast("long"))


@query(f"""{B}, t AS (SELECT id, {q.tokens(q.business_key(q.norm("name")))} AS t, nullif(string_split({q.norm("city")}, ' ')[1], '') AS c FROM v_business), l AS (SELECT id, [array_to_string(t, ''), CASE WHEN len(t) > 1 THEN array_to_string(t, '-') END, t[1], t[1] || '-' || c, array_to_string(t, '') || '-' || c] AS l FROM t WHERE len(t) > 0),
f AS (SELECT id, generate_subscripts(l, 1) AS n, unnest(l) AS label FROM l), g AS (SELECT id, label, min(n) AS n FROM f WHERE length(label) >= 4 GROUP BY 1, 2), e AS (SELECT id, n, label, x.z, x.tld FROM g, (VALUES (0, 'de'), (1, 'com')) x(z, tld))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY n, z) - 1 AS ordinal, 'https://' || label || '.' || tld AS url FROM e QUALIFY ordinal < 6""")
def d8_domain_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses guessed from names."""
    return view(spark, sf_dir, "v_business").select("id", F.posexplode(op.domain_guesses()).alias("ordinal", "url")).withColumn("ordinal", F.col("ordinal").cast("long"))


def search_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results and statuses of the queries: made from the queries themselves, by their lengths."""
    asked = view(spark, sf_dir, "v_business").select(F.explode(op.search_queries()).alias("query")).distinct().withColumn("n", F.length("query"))
    statuses = asked.where("n % 11 <> 0").select("query", F.when(F.col("n") % 13 == 0, "error").otherwise("ok").alias("status"))
    results = asked.select("query", F.posexplode(F.expr(RESULTS)).alias("rank", "url")).withColumns({"title": F.lit("t"), "snippet": F.lit("see www.example-shop.de")})
    return results, statuses


RESULTS = "transform(sequence(0, 9), i -> concat('https://www.', CASE (n + i) % 5 WHEN 0 THEN 'facebook.com/p' WHEN 1 THEN 'yelp.de/biz' ELSE concat('site', cast((n + i * 3) % 17 AS string), '.de/x') END, cast(i AS string)))"
RESULTS_SQL = "list_transform(range(10), lambda i: concat('https://www.', CASE (n + i) % 5 WHEN 0 THEN 'facebook.com/p' WHEN 1 THEN 'yelp.de/biz' ELSE concat('site', cast((n + i * 3) % 17 AS string), '.de/x') END, cast(i AS string)))"
SEARCH = f"""l AS (SELECT id, {QUERIES_SQL} AS l, name FROM v_business), a AS (SELECT id, generate_subscripts(x, 1) - 1 AS q, unnest(x) AS query FROM (SELECT id, CASE WHEN len(l) = 0 THEN ['"' || trim(name) || '"'] ELSE l END AS x FROM l)), st AS (SELECT *, length(query) AS n, CASE WHEN length(query) % 11 = 0 THEN 'unavailable' WHEN length(query) % 13 = 0 THEN 'error' ELSE 'ok' END AS status FROM a),
fl AS (SELECT id, min(CASE WHEN status <> 'ok' THEN q END) AS fq FROM st GROUP BY id), hits AS (SELECT st.id, q, generate_subscripts({RESULTS_SQL}, 1) - 1 AS rank, unnest({RESULTS_SQL}) AS u FROM st JOIN fl USING (id) WHERE fq IS NULL OR q < fq), hd AS (SELECT *, {HOST} AS h FROM hits),
hk AS (SELECT *, {q.domain("h")} AS domain, CASE WHEN h = 'facebook.com' THEN 'social' WHEN h = 'yelp.de' THEN 'directory' ELSE 'candidate' END AS kind FROM hd), h1 AS (SELECT * FROM hk QUALIFY row_number() OVER (PARTITION BY id, kind, CASE WHEN kind = 'candidate' THEN domain ELSE u END ORDER BY q, rank) = 1), h2 AS (SELECT id AS business_id, kind, row_number() OVER (PARTITION BY id, kind ORDER BY q, rank) AS ordinal, u AS url, domain FROM h1)"""


@query(f"{B}, {SEARCH} SELECT * FROM h2 WHERE kind <> 'candidate' OR ordinal <= 6")
def d7_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each business, routed; at most six candidates."""
    hits, _ = op.search_channel(view(spark, sf_dir, "v_business"), *search_tables(spark, sf_dir))
    return hits.withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"{B}, {SEARCH} SELECT id AS business_id, coalesce(arg_min(status, q) FILTER (WHERE status <> 'ok'), 'ok') AS status, count_if(fq IS NULL OR q < fq)::bigint AS queries_run FROM st JOIN fl USING (id) GROUP BY id")
def d7_search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the search of each business."""
    _, rows = op.search_channel(view(spark, sf_dir, "v_business"), *search_tables(spark, sf_dir))
    return rows.select("business_id", "status", "queries_run")


@query(f"""{B} SELECT id, CASE WHEN k % 3 = 0 THEN 'skipped' ELSE 'ok' END AS status FROM v_business""")
def d10_directory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory channel."""
    return view(spark, sf_dir, "v_business").select("id", op.directory_status(F.col("k") % 3).alias("status"))


CANDIDATES = """SELECT concat('b', cast(l.l_orderkey % 500 AS string)) AS business_id, CASE l.l_linenumber % 4 WHEN 0 THEN 'provider_field' WHEN 1 THEN 'search_engine' WHEN 2 THEN 'social_profile' ELSE 'domain_guess' END AS channel, CASE l.l_linenumber % 3 WHEN 0 THEN 'declared' WHEN 1 THEN 'found' ELSE 'derived' END AS origin,
    cast(l.l_orderkey * 10000 + l.l_partkey AS bigint) AS ordinal, concat('https://d', cast(l.l_partkey % 40 AS string), '.de/') AS url, CASE WHEN l.l_partkey % 9 = 0 THEN NULL ELSE concat('d', cast(l.l_partkey % 40 AS string), '.de') END AS domain FROM lineitem l"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CANDIDATES.replace("FROM lineitem l", f"FROM parquet.`{sf_dir}/lineitem.parquet` l")).groupBy("business_id", "channel", "origin", "ordinal", "domain").agg(F.min("url").alias("url"))


FIRSTS = f"WITH c AS (SELECT business_id, channel, origin, ordinal, domain, min(url) AS url FROM ({CANDIDATES}) GROUP BY ALL), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY business_id, coalesce(domain, url) ORDER BY {RANK.format('channel')}, ordinal, CASE origin WHEN 'declared' THEN 0 WHEN 'found' THEN 1 ELSE 2 END, url) = 1)"


@query(f"{FIRSTS} SELECT business_id, url, row_number() OVER (PARTITION BY business_id ORDER BY CASE origin WHEN 'declared' THEN 0 WHEN 'found' THEN 1 ELSE 2 END, {RANK.format('channel')}, ordinal, url) AS seq FROM f QUALIFY seq <= 14")
def u2_w5_w7_fetch_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all channels, the first of each domain, fourteen for each business."""
    return op.cap_fetches(op.first_per_domain(candidates(spark, sf_dir))).select("business_id", "url", F.col("seq").cast("long"))


@query(f"{FIRSTS} SELECT business_id, url, domain FROM f WHERE origin = 'derived' AND domain IS NOT NULL AND (business_id, domain) NOT IN (SELECT (business_id, domain) FROM c WHERE origin <> 'derived' AND domain IS NOT NULL)")
def j11_unseen_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses whose domain no other channel has."""
    c = candidates(spark, sf_dir)
    return op.without_seen(op.first_per_domain(c).where("origin = 'derived' and domain is not null"), c.where("origin <> 'derived'")).select("business_id", "url", "domain")


HOPS = "SELECT concat('h', cast(p.p_partkey AS string), '.de') AS host_path, CASE WHEN p.p_partkey % 3 <> 0 THEN concat('https://h', cast(p.p_partkey - p.p_partkey % 3 + 7 * (p.p_partkey % 2) AS string), '.de/') WHEN p.p_partkey % 12 = 0 THEN concat('https://www.h', cast(p.p_partkey + 3 AS string), '.de') END AS redirect_to FROM part p"
_step = "SELECT id, coalesce(x.redirect_to, final_url) AS final_url, n + (x.redirect_to IS NOT NULL)::int AS n FROM {0} s LEFT JOIN hops x ON x.host_path = regexp_replace(regexp_replace(regexp_replace(final_url, '^https://', ''), '^www\\.', ''), '/$', '')"


@query(f"WITH hops AS ({HOPS}), s0 AS (SELECT p_partkey AS id, concat('https://h', cast(p_partkey AS string), '.de') AS final_url, 0 AS n FROM part), " + ", ".join(f"s{i + 1} AS ({_step.format(f's{i}')})" for i in range(5)) + ", s6 AS (" + _step.format("s5") + ") SELECT s5.id, s5.final_url, s5.n::bigint AS hops, s6.n > s5.n AS too_many FROM s5 JOIN s6 USING (id)")
def j5_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects followed up to five hops."""
    parts = f"parquet.`{sf_dir}/part.parquet`"
    hops = spark.sql(HOPS.replace("FROM part p", f"FROM {parts} p"))
    start = spark.sql(f"SELECT p_partkey AS id, concat('https://h', cast(p_partkey AS string), '.de') AS url FROM {parts}")
    return op.follow_redirects(start, hops).select("id", "final_url", F.size("redirects").cast("long").alias("hops"), "too_many")


JUDGED = """SELECT b.id, b.k, b.name, b.street, b.city, b.postal_code, b.phone_e164, CASE b.k % 3 WHEN 0 THEN 'declared' WHEN 1 THEN 'found' ELSE 'derived' END AS origin, concat('https://www.', replace(replace(lower(b.name), ' ', ''), '.', ''), '.de/') AS url,
    CASE WHEN b.k % 29 = 0 THEN 404 ELSE 200 END AS http_status, concat('Willkommen ', CASE WHEN b.k % 2 = 0 THEN b.name ELSE '' END) AS title,
    concat(CASE WHEN b.k % 4 <> 0 THEN coalesce(b.street, '') ELSE '' END, ' ', CASE WHEN b.k % 5 <> 0 THEN coalesce(b.city, '') ELSE '' END, CASE WHEN b.k % 31 = 0 THEN ' coming soon' WHEN b.k % 37 = 0 THEN ' this domain is parked' ELSE '' END, ' und vieles mehr, zum Beispiel unser Angebot an Dingen') AS text,
    CASE b.k % 3 WHEN 0 THEN b.phone_e164 WHEN 1 THEN '+49309999999' END AS page_phone, CASE b.k % 4 WHEN 0 THEN b.postal_code WHEN 1 THEN '99999' END AS page_postal FROM v_business b"""
_HAY = q.norm("concat(title, ' ', text)")
_STREET_HEAD = f"string_split({q.street('street')}, ' ')[1]"
_CITY_HEAD = f"string_split({q.norm('city')}, ' ')[1]"
_SIGNS = f"""j AS ({JUDGED}), k AS (SELECT *, {q.norm("text")} AS plain, {_HAY} AS hay, {q.tokens(q.business_key(q.norm("name")))} AS toks, {q.norm("name")} AS nn, replace({q.norm("replace(replace(lower(name), ' ', ''), '.', '')")}, ' ', '') AS label FROM j), s AS (SELECT *, len(text) < 60 AS is_empty, contains(plain, 'this domain is parked') AS parked, contains(plain, 'coming soon') AS holder,
coalesce({q.compare("phone_e164", "page_phone")} = 'match', false) AS phone_match, phone_e164 IS NOT NULL AND page_phone IS NOT NULL AND {q.compare("phone_e164", "page_phone")} = 'mismatch' AS phone_conflict, coalesce(postal_code = page_postal, false) AS postal_match, coalesce(postal_code <> page_postal, false) AS postal_conflict,
street IS NOT NULL AND length({_STREET_HEAD}) >= 4 AND contains(plain, {_STREET_HEAD}) AS street_match, city IS NOT NULL AND length({_CITY_HEAD}) >= 3 AND contains(plain, {_CITY_HEAD}) AS city_match, {q.coverage("toks", "hay")} AS cov, list_filter(string_split(nn, ' '), lambda w: length(w) >= 3) AS words FROM k),
p AS (SELECT *, CASE WHEN phone_match THEN 45 ELSE 0 END - CASE WHEN phone_conflict THEN 40 ELSE 0 END + CASE WHEN postal_match THEN 20 ELSE 0 END - CASE WHEN postal_conflict THEN 20 ELSE 0 END + CASE WHEN street_match THEN 15 ELSE 0 END + CASE WHEN city_match THEN 8 ELSE 0 END + CASE WHEN len(toks) = 0 THEN 0 WHEN cov >= 0.8 THEN 20 WHEN cov >= 0.5 THEN 10 ELSE -15 END
+ CASE WHEN regexp_matches(url, '^https://www\\.[a-z0-9äöüéß&.-]+\\.de/$') AND len(words) > 0 AND len(list_filter(words, lambda w: contains(label, w)))::double / len(words) >= 0.5 THEN 8 ELSE 0 END + CASE WHEN origin = 'declared' THEN 20 ELSE 0 END AS score, phone_match OR origin = 'declared' OR (postal_match AND street_match) AS strong FROM s)"""


@query(f"""{B}, {_SIGNS} SELECT id, CASE WHEN http_status >= 400 OR parked OR is_empty THEN 0 WHEN holder THEN least(score, 45) ELSE score END AS score, CASE WHEN http_status >= 400 OR parked OR is_empty THEN 'REJECTED' WHEN holder THEN 'PROBABLE' WHEN (phone_conflict OR postal_conflict) AND score < 70 THEN 'REJECTED' WHEN score >= 70 AND strong THEN 'ACCEPTED' WHEN score >= 45 THEN 'PROBABLE' ELSE 'REJECTED' END AS decision,
CASE WHEN http_status >= 400 THEN 'http' WHEN parked THEN 'parked' WHEN is_empty THEN 'empty' WHEN holder THEN NULL WHEN (phone_conflict OR postal_conflict) AND score < 70 THEN 'conflict' WHEN score >= 45 THEN NULL ELSE 'weak' END AS reject_code FROM p""")
def d11_d12_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and decisions of candidate pages."""
    from ..functions.text import normalize_text
    from ..functions.web import looks_parked, looks_unfinished

    rows = spread(view_sql(spark, sf_dir, JUDGED, "v_business"), "id")
    one = lambda c: F.array_compact(F.array(F.col(c)))
    structured = F.array().cast("array<struct<type:string,name:string,telephone:string,street:string,postal:string,locality:string,url:string>>")
    rows = rows.withColumns({"country_code": F.lit("DE"), "final_url": F.col("url"), "redirects": F.array().cast("array<string>"), "normalized": normalize_text(F.col("text")), "phones": one("page_phone"), "postal_codes": one("page_postal"), "structured": structured, "is_empty": F.length("text") < 60})
    rows = rows.withColumns({"is_parked": looks_parked(F.col("normalized")), "is_placeholder": looks_unfinished(F.col("normalized"))})
    return rows.withColumn("s", op.score_page()).select("id", "s.score", "s.decision", "s.reject_code")


def view_sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """SQL over views, as a DataFrame."""
    import re

    from .standins import BASE

    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(BASE)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", with_views(*names))
    return spark.sql(text + sql)


CHANNELS_SQL = "SELECT business_id, count_if(status = 'ok')::bigint AS ok_channels, count_if(status IN ('unavailable', 'error'))::bigint AS blocked, coalesce(array_to_string(list(channel ORDER BY channel) FILTER (WHERE status IN ('unavailable', 'error')), ','), '') AS blockers FROM v_channel GROUP BY business_id"


@query(f"{with_views('v_channel')} {CHANNELS_SQL}")
def a9_channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that ran and that block."""
    return op.channel_summary(view(spark, sf_dir, "v_channel")).withColumn("blockers", F.array_join("blockers", ","))


ROLLED = """SELECT business_id, arg_max(url, (score, -seq)) FILTER (WHERE decision = 'ACCEPTED') AS accepted_url, max(score) FILTER (WHERE decision = 'ACCEPTED') AS accepted, arg_max(url, (score, -seq)) FILTER (WHERE decision = 'PROBABLE') AS probable_url, max(score) FILTER (WHERE decision = 'PROBABLE') AS probable,
    count_if(decision = 'UNREACHABLE' AND origin <> 'derived')::bigint AS unreachable, count_if(coalesce(reject_code = 'parked', false) AND origin = 'declared')::bigint AS parked, count_if(decision = 'REJECTED' AND score > 0 AND is_named)::bigint AS ambiguous FROM v_judged GROUP BY business_id"""


def judged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_judged").withColumn("signals", F.when(F.col("is_named"), F.array(F.lit("name_match"))).otherwise(F.array(F.lit("name_absent"))))


@query(f"{with_views('v_judged')} {ROLLED}")
def a10_candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the best candidates of each verification."""
    s = op.candidate_summary(judged_view(spark, sf_dir))
    return s.select("business_id", F.col("accepted.url").alias("accepted_url"), F.col("accepted.score").alias("accepted"), F.col("probable.url").alias("probable_url"), F.col("probable.score").alias("probable"), "unreachable", "parked", "ambiguous")


IDENTITIES = "SELECT concat('v', cast(o.o_orderkey AS string)) AS business_id, CASE o.o_orderkey % 7 WHEN 0 THEN 'UNVERIFIED' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'PROBABLE' ELSE 'CONFIRMED' END AS identity_status, cast(o.o_orderkey % 101 AS int) AS identity_confidence, o.o_orderkey % 3 AS n_profiles, o.o_orderkey % 5 = 0 AS social_as_website FROM orders o"


@query(f"""{with_views("v_judged", "v_channel")}, r AS ({ROLLED}), c AS ({CHANNELS_SQL}), i AS ({IDENTITIES}), j AS (SELECT i.*, r.* EXCLUDE (business_id), c.* EXCLUDE (business_id), 90 + CASE WHEN coalesce(ok_channels, 0) >= 3 THEN 5 ELSE 0 END - CASE WHEN n_profiles > 0 THEN 12 ELSE 0 END - CASE WHEN social_as_website THEN 5 ELSE 0 END AS nn FROM i LEFT JOIN r USING (business_id) LEFT JOIN c USING (business_id)),
w AS (SELECT business_id, CASE WHEN identity_status IN ('UNVERIFIED', 'NEEDS_REVIEW') THEN ['IDENTITY_UNVERIFIED', identity_confidence::string] WHEN accepted IS NOT NULL AND identity_status = 'CONFIRMED' THEN ['VERIFIED_WEBSITE', least(100, accepted)::string] WHEN accepted IS NOT NULL THEN ['PROBABLE_WEBSITE', least(69, accepted)::string] WHEN probable IS NOT NULL THEN ['PROBABLE_WEBSITE', least(69, probable)::string]
WHEN coalesce(unreachable, 0) > 0 THEN ['REQUIRES_MANUAL_CHECK', '40'] WHEN coalesce(parked, 0) > 0 THEN ['REQUIRES_MANUAL_CHECK', '45'] WHEN coalesce(ambiguous, 0) > 0 THEN ['WEBSITE_UNCERTAIN', '40'] WHEN coalesce(blocked, 0) > 0 THEN ['REQUIRES_MANUAL_CHECK', '30'] WHEN identity_status <> 'CONFIRMED' THEN ['REQUIRES_MANUAL_CHECK', '35'] WHEN coalesce(ok_channels, 0) < 2 THEN ['REQUIRES_MANUAL_CHECK', '35'] WHEN nn >= 70 THEN ['VERIFIED_NO_WEBSITE', nn::string] ELSE ['REQUIRES_MANUAL_CHECK', nn::string] END AS w FROM j)
SELECT business_id, w[1] AS status, w[2]::int AS confidence FROM w""")
def d13_website_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each verification."""
    i = spark.sql(IDENTITIES.replace("FROM orders o", f"FROM parquet.`{sf_dir}/orders.parquet` o"))
    rows = i.join(op.candidate_summary(judged_view(spark, sf_dir)), "business_id", "left").join(op.channel_summary(view(spark, sf_dir, "v_channel")), "business_id", "left")
    return rows.withColumn("w", op.website_status()).select("business_id", "w.status", "w.confidence")


@query(f"""WITH d AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split({q.norm("text")}, ' '), lambda w: length(w) >= 2)) AS w FROM benchmark), x AS (SELECT doc_id, list_distinct(list_filter(string_split({q.norm("text")}, ' '), lambda w: length(w) >= 2)) AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT query_id, unnest(w) AS word FROM d), i AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM x),
h AS (SELECT query_id, doc_id, count(*) AS hits, count(*)::double / any_value(n) AS share FROM p JOIN i USING (word) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT query_id, doc_id, hits, round(share, 6) AS share, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, hits DESC, doc_id) AS rank FROM h QUALIFY rank <= 10""")
def j10_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by keyword overlap with each benchmark item; a document's keywords are the words of its whole text."""
    from ..functions.text import normalize_text

    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", F.split(normalize_text(F.col("text")), " ").alias("keywords"))
    return op.keyword_search(b, index).select("query_id", "doc_id", "hits", F.round("share", 6).alias("share"), F.col("rank").cast("long"))


@query()
def d9_d14_d15_verify_websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole verification of businesses against the given pages; its statements in order."""
    return op.evidence(verified(spark, sf_dir))


@query()
def d15_concluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conclusion for each business."""
    return verified(spark, sf_dir).concluded


#: Social pages that a source states beside the website.
STATED = "CASE k % 7 WHEN 1 THEN array(concat('https://www.instagram.com/shop', cast(k AS string)), 'https://example.com/no-profile') WHEN 3 THEN array(concat('https://www.facebook.com/p', cast(k AS string))) END"


def crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(search results, query statuses, pages, redirects)."""
    pages = page_table(spark, sf_dir)
    results, statuses = search_tables(spark, sf_dir)
    moved = pages.select(F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit(".de/old")).alias("host_path"), F.concat(F.lit("https://"), "host_path").alias("redirect_to"))
    hops = spark.sql(HOPS.replace("FROM part p", f"FROM parquet.`{sf_dir}/part.parquet` p")).unionByName(moved)
    return results_on_pages(results, pages), statuses, pages.drop("page_id"), hops


def verified(spark: SparkSession, sf_dir: str) -> op.Verified:
    b = view(spark, sf_dir, "v_business").drop("identity_status", "identity_confidence", "phone_e164").withColumn("social_urls", F.expr(STATED))
    return op.verify_websites(build_identity(b), *crawled(spark, sf_dir))


@query()
def d15_stale_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15 as a job: what is due is checked with the latest payload and the number of sources, and written back; every 50th check breaks off."""
    b, sources = view(spark, sf_dir, "v_business"), view(spark, sf_dir, "v_sources")
    payload = F.to_json(F.struct(F.when(F.col("fetched_ms") % 3 > 0, F.concat(F.lit("https://www.site"), (F.col("fetched_ms") % 90).cast("string"), F.lit(".de/x"))).alias("website"), F.array(F.concat(F.lit("https://www.facebook.com/"), "external_id")).alias("socialUrls")))
    failed = b.where("k % 50 = 0").select(F.col("id").alias("business_id"))
    after, _ = op.check_stale(b, sources.withColumn("raw_json", payload), *crawled(spark, sf_dir), as_of_ms=AS_OF, failed=failed)
    return after.select("id", "identity_status", "website_status", "website_confidence", "website_url", "checked_ms")


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every given page with its signals, under an address of its own, ``site{page_id}.de/x``; of rows that share a page_id the first by url and html."""
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy("page_id").agg(F.min(F.struct("url", "html")).alias("first")).select("page_id", "first.*").withColumn("s", page_signals(F.col("html"), F.col("url")))
    keyed = raw.withColumn("host_path", F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit(".de/x")))
    return keyed.withColumns({"http_status": F.when(F.col("page_id") % 23 == 0, 404).otherwise(200), "fetch_error": F.when(F.col("page_id") % 19 == 0, "timeout"), "retryable": F.lit(True)}).select("page_id", "host_path", "http_status", "fetch_error", "retryable", "s.*")


def results_on_pages(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Search results whose made addresses are those of pages, dealt by the hash of query and rank; every third by an old address that is redirected."""
    end = pages.agg((F.max("page_id") + 1).alias("end"))
    at = F.pmod(F.xxhash64("query", "rank"), F.col("end")).cast("string")
    url = F.concat(F.lit("https://www.site"), at, F.when(F.col("rank") % 3 == 0, ".de/old").otherwise(".de/x"))
    return results.crossJoin(F.broadcast(end)).withColumn("url", F.when(F.col("url").startswith("https://www.site"), F.coalesce(url, "url")).otherwise(F.col("url"))).drop("end")


@query(f"""{VIEW}{WEEK.removeprefix(with_views("v_business"))}, c AS (SELECT id, isodow(l) % 7 AS w, hour(l) * 60 + minute(l) AS m FROM (SELECT h.id, {LOCAL.format(str(AS_OF))} AS l FROM h WHERE raw <> '')), o AS (SELECT DISTINCT c.id FROM c JOIN parts p ON p.id = c.id AND p.weekday = c.w AND p.a <= c.m AND c.m < p.b)
SELECT lv.id, row_number() OVER (ORDER BY name_lower, lv.id) AS place FROM lv JOIN o ON o.id = lv.id WHERE excluded_ms IS NULL QUALIFY place <= 100""")
def f5_open_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what is open now in its own zone, filtered before the page is cut."""
    from pyspark.sql import Window

    state = lambda h: opening_status(h, F.timestamp_millis(F.lit(AS_OF)))["state"]
    rows = with_hours(joined(spark, sf_dir).where("excluded_ms is null"), state, "state").where("state = 'open'")
    return page_of(rows, "name").select("id", F.row_number().over(Window.orderBy("name_lower", "id")).cast("long").alias("place"))
