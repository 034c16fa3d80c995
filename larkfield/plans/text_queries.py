"""Queries of the scalar functions: names, addresses, phones, URLs, free text, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address, html, phone, text, web
from ..refdata import CONTENT_PARTS, DIRECTORY_HOSTS, ENTITIES, LINK_PAGE_HOSTS, NAME_PREFIXES, NUMBER_FIRST, NUMBER_LAST, PARKED_TEXTS, PLATFORMS, POSTAL_BRITISH, POSTAL_DIGITS, SHORTENERS, SOCIAL_HOSTS, TEXT_TLDS, UNFINISHED_TEXTS
from ..sources.records import read_pages
from . import sqltext as q
from .catalog import query
from .standins import view, with_views

B = with_views("v_business", "v_discovered")


@query(f"""{B}, pair AS (SELECT b.id, b.name AS a, d.name AS b, {q.norm("b.name")} AS na, {q.norm("d.name")} AS nb FROM v_business b JOIN v_discovered d ON d.external_id = concat('x', cast(b.k AS string))),
keyed AS (SELECT *, {q.business_key("na")} AS ka, {q.business_key("nb")} AS kb FROM pair), t AS (SELECT *, {q.tokens("ka")} AS ta FROM keyed)
SELECT id, na AS normalized, ka AS name_key, array_to_string(ta, ' ') AS tokens, round({q.edit_sim("ka", "kb")}, 4) AS edit_similarity, round({q.key_sim("ka", "kb")}, 4) AS name_similarity,
round({q.coverage("ta", "nb")}, 4) AS coverage, {q.clean("b")} AS cleaned FROM t""")
def x01_x07_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text and names, tokens, similarities, coverage, cleaning."""
    b, d = view(spark, sf_dir, "v_business"), view(spark, sf_dir, "v_discovered")
    rows = b.join(d.select("external_id", F.col("name").alias("other")), F.concat(F.lit("x"), b["k"].cast("string")) == F.col("external_id"))
    name, other = F.col("name"), F.col("other")
    keyed = rows.withColumns({"name_key": text.business_name(name), "other_key": text.business_name(other), "normalized": text.normalize_text(name), "t": text.distinctive_tokens(name), "hay": text.normalize_text(other)})
    return keyed.select("id", "normalized", "name_key", F.array_join("t", " ").alias("tokens"), F.round(text.edit_similarity(F.col("name_key"), F.col("other_key")), 4).alias("edit_similarity"), F.round(text.key_similarity(F.col("name_key"), F.col("other_key")), 4).alias("name_similarity"), F.round(text.coverage_of(F.col("t"), F.col("hay")), 4).alias("coverage"), text.clean_string(other).alias("cleaned"))


LINE = "CASE WHEN k % 3 = 0 THEN concat(coalesce(house_number, '7 b'), ', ', coalesce(street, 'Weg')) ELSE concat(coalesce(street, ''), ' ', coalesce(house_number, '')) END"
BACK, FRONT = NUMBER_LAST, NUMBER_FIRST


@query(f"""{B}, l AS (SELECT *, {q.clean(LINE)} AS line FROM v_business), s AS (SELECT *, regexp_matches(line, '{BACK}') AND regexp_extract(line, '{BACK}', 1) <> '' AS at_end, regexp_matches(line, '{FRONT}') AS at_front FROM l)
SELECT id, {q.street("street")} AS street_key, CASE WHEN at_end THEN {q.clean(f"regexp_extract(line, '{BACK}', 1)")} WHEN at_front THEN {q.clean(f"regexp_extract(line, '{FRONT}', 2)")} ELSE line END AS split_street,
CASE WHEN at_end THEN {q.clean(f"regexp_extract(line, '{BACK}', 2)")} WHEN at_front THEN {q.clean(f"regexp_extract(line, '{FRONT}', 1)")} END AS split_number, replace({q.norm("house_number")}, ' ', '') AS number_key, {q.postal("postal_code")} AS postal_key,
{q.address_key("country_code", "postal_code", "street", "house_number")} AS address_key, nullif(concat_ws(', ', nullif(concat_ws(' ', street, house_number), ''), nullif(concat_ws(' ', postal_code, city), '')), '') AS formatted FROM s""")
def x08_x13_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street, number, postal and address keys, split lines, formatting."""
    b = view(spark, sf_dir, "v_business").withColumn("line", F.expr(LINE))
    split = address.split_street(F.col("line"))
    return b.select("id", address.street_key(F.col("street")).alias("street_key"), split["street"].alias("split_street"), split["house_number"].alias("split_number"), address.house_number_key(F.col("house_number")).alias("number_key"), address.postal_key(F.col("postal_code")).alias("postal_key"), address.address_key(F.col("country_code"), F.col("postal_code"), F.col("street"), F.col("house_number")).alias("address_key"), address.format_address(F.col("street"), F.col("house_number"), F.col("postal_code"), F.col("city")).alias("formatted"))


@query(f"""{B}, p AS (SELECT b.id, b.phone, {q.e164("b.phone")} AS e164, {q.e164("d.phone")} AS other FROM v_business b LEFT JOIN v_discovered d ON d.external_id = concat('x', cast(b.k AS string)))
SELECT id, {q.clean("phone")} AS raw, e164, CASE WHEN e164 IS NOT NULL THEN '0' || substr(e164, 4) END AS national, CASE WHEN e164 IS NOT NULL THEN 'DE' END AS country, e164 IS NOT NULL AS is_valid, {q.compare("e164", "other")} AS compared, {q.compare("e164", "substr(e164, 1, length(e164) - 2)")} AS extension FROM p""")
def x14_x16_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers and their comparison."""
    b, d = view(spark, sf_dir, "v_business"), view(spark, sf_dir, "v_discovered")
    rows = b.join(d.select("external_id", F.col("phone").alias("other")), F.concat(F.lit("x"), b["k"].cast("string")) == F.col("external_id"), "left")
    rows = rows.withColumns({"p": phone.normalize_phone(F.col("phone")), "o": phone.normalize_phone(F.col("other"))["e164"]})
    short = F.expr("substring(p.e164, 1, length(p.e164) - 2)")
    return rows.select("id", text.clean_string(F.col("phone")).alias("raw"), "p.e164", "p.national", "p.country", F.coalesce("p.is_valid", F.lit(False)).alias("is_valid"), phone.compare_phones(F.col("p.e164"), F.col("o")).alias("compared"), phone.compare_phones(F.col("p.e164"), short).alias("extension"))


PLATFORM_SQL = "CASE d " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLATFORMS.items()) + " END"


@query(f"""{B}, u AS (SELECT id, name, city, website, nullif(trim(website), '') AS u FROM v_business), h AS (SELECT *, {q.host("u")} AS h, CASE WHEN contains(u, '://') THEN u ELSE 'https://' || u END AS whole FROM u), r AS (SELECT *, {q.domain("h")} AS d,
lower(regexp_extract(whole, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(whole, '^[a-zA-Z]+://([^/?#]*)', 1)) AS full_host, regexp_replace(regexp_replace(whole, '^[a-zA-Z]+://[^/?#]*', ''), '#.*$', '') AS rest FROM h),
s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(rest, '[?].*$', ''), '/'), lambda x: lower(regexp_replace(x, '^@', ''))), lambda x: x <> '' AND x NOT IN ({q.quoted(NAME_PREFIXES)}))[1] AS part, {q.norm("string_split(d, '.')[1]")} AS label, list_filter(string_split({q.norm("name")}, ' '), lambda w: length(w) >= 3) AS toks FROM r),
t AS (SELECT *, {PLATFORM_SQL} AS platform, CASE WHEN part NOT IN ({q.quoted(CONTENT_PARTS)}) AND NOT regexp_matches(part, '^\\d+$') AND regexp_matches(part, '^[a-z0-9._-]{{2,60}}$') THEN part END AS handle_part FROM s),
v AS (SELECT *, CASE WHEN platform IS NOT NULL THEN handle_part END AS handle FROM t), w AS (SELECT *, regexp_replace(handle, '[^a-z0-9]', '', 'g') AS compact, regexp_replace(regexp_replace(handle, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS hyphens FROM v)
SELECT id, h AS host, d AS domain, CASE WHEN scheme IN ('http', 'https') AND h IS NOT NULL THEN scheme || '://' || full_host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS url, coalesce(d IN ({q.quoted(SOCIAL_HOSTS)}), false) AS is_social,
coalesce(d IN ({q.quoted(SOCIAL_HOSTS + DIRECTORY_HOSTS)}) OR ends_with(h, '.google.com') OR ends_with(h, '.business.site'), false) AS is_listed, coalesce(d IN ({q.quoted(SHORTENERS)}), false) AS is_shortener, coalesce(d IN ({q.quoted(LINK_PAGE_HOSTS)}) OR ends_with(h, '.bio.link'), false) AS is_link_page,
round(CASE WHEN len(toks) = 0 OR replace(label, ' ', '') = '' THEN 0.0 ELSE len(list_filter(toks, lambda x: contains(replace(label, ' ', ''), x)))::double / len(toks) END, 4) AS overlap, platform, handle,
CASE WHEN handle IS NULL THEN NULL WHEN length(handle) < 4 THEN '' ELSE array_to_string(list_filter([CASE WHEN length(compact) >= 4 THEN 'https://' || compact || '.de' END, CASE WHEN length(compact) >= 4 THEN 'https://' || compact || '.com' END, CASE WHEN length(hyphens) >= 4 AND hyphens <> compact THEN 'https://' || hyphens || '.de' END, CASE WHEN length(hyphens) >= 4 AND hyphens <> compact THEN 'https://' || hyphens || '.com' END], lambda x: x IS NOT NULL), ' ') END AS guesses,
'https://www.google.com/search?q=' || replace(url_encode(concat_ws(' ', name, city)), '+', '%20') AS search_url FROM w""")
def x17_x26_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, domains, canonical URLs, host classes, overlap, profiles, guesses, search address."""
    b = view(spark, sf_dir, "v_business").withColumn("u", F.nullif(F.trim("website"), F.lit("")))
    u = F.col("u")
    b = b.withColumns({"host": web.hostname(u), "domain": web.registrable_domain(u), "p": web.social_profile(u)})
    return b.select("id", "host", "domain", web.normalize_url(u).alias("url"), web.is_social(u).alias("is_social"), web.is_social_or_directory(u).alias("is_listed"), web.is_shortener(u).alias("is_shortener"), web.is_link_page(u).alias("is_link_page"), F.round(F.coalesce(web.domain_overlap(F.col("domain"), F.col("name")), F.lit(0.0)), 4).alias("overlap"), "p.platform", "p.handle", F.array_join(web.handle_domains(F.col("p.handle")), " ").alias("guesses"), web.manual_search_url(F.col("name"), F.col("city")).alias("search_url"))


DOMAIN_RE = rf"(?i)\b((?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{'|'.join(TEXT_TLDS)}))\b"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), x AS (SELECT doc_id, regexp_extract_all(text, '{POSTAL_DIGITS}', 1) AS p, list_transform(regexp_extract_all(text, '{POSTAL_BRITISH}', 1), lambda x: regexp_replace(upper(x), '\\s+', '', 'g')) AS uk,
list_transform(list_filter(regexp_extract_all(text, '((?:\\+|00)?[\\d][\\d\\s()/.\\-]{{5,24}}\\d)', 1), lambda r: length(regexp_replace(r, '\\D', '', 'g')) BETWEEN 6 AND 16), lambda r: {q.e164("r")}) AS ph,
list_transform(list_filter(list_transform(regexp_extract_all(text, '{DOMAIN_RE}', 1), lambda x: lower(x)), lambda x: NOT regexp_matches(x, '\\.(?:jpg|jpeg|png|gif|webp|pdf|mp4)$')), lambda x: regexp_replace(x, '^www\\.', '')) AS dom FROM d)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(p, uk))), ' ') AS postal_codes, array_to_string(list_sort(list_distinct(list_filter(ph, lambda x: x IS NOT NULL))), ' ') AS phones, array_to_string(list_sort(list_distinct(dom)), ' ') AS domains FROM x""")
def x12_x15_x25_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal codes, phone numbers and domains in whole documents."""
    t = F.coalesce("text", F.lit(""))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", joined(address.postal_codes_in(t)).alias("postal_codes"), joined(phone.phone_numbers_in(t)).alias("phones"), joined(web.domains_in(t)).alias("domains"))


def _decoded(x: str) -> str:
    for k, v in ENTITIES.items():
        x = f"replace({x}, '&{k};', '{v.replace(chr(39), chr(39) * 2)}')"
    return x


STRIPPED = "coalesce(html, '')"
for _tag in ("script", "style", "noscript"):
    STRIPPED = f"regexp_replace({STRIPPED}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
STRIPPED = f"regexp_replace(regexp_replace({STRIPPED}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x0b\\x{{a0}}]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT page_id, url, html, {_collapsed(_decoded(STRIPPED))} AS text, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS raw_title FROM pages), n AS (SELECT *, {q.norm("text")} AS plain FROM t)
SELECT page_id, CASE WHEN raw_title <> '' THEN {_collapsed(_decoded("raw_title"))} END AS title, md5(text) AS text_md5, md5(plain) AS plain_md5, length(text) < 60 AS is_empty, {" OR ".join(f"contains(plain, '{m}')" for m in PARKED_TEXTS)} AS is_parked, {" OR ".join(f"contains(plain, '{m}')" for m in UNFINISHED_TEXTS)} AS is_placeholder,
array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '{POSTAL_DIGITS}', 1), list_transform(regexp_extract_all(text, '{POSTAL_BRITISH}', 1), lambda x: regexp_replace(upper(x), '\\s+', '', 'g'))))), ' ') AS postal_codes,
array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(text, '((?:\\+|00)?[\\d][\\d\\s()/.\\-]{{5,24}}\\d)', 1), lambda r: length(regexp_replace(r, '\\D', '', 'g')) BETWEEN 6 AND 16), lambda r: {q.e164("r")}), lambda x: x IS NOT NULL))), ' ') AS phones,
array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(html, '(?i)<a\\b[^>]*href=["'']([^"'']+)["'']', 1), lambda h: NOT starts_with(h, '#') AND NOT starts_with(h, 'mailto:') AND NOT starts_with(h, 'tel:')), lambda h: CASE WHEN regexp_matches(h, '^https?://[^/?#]+$') THEN h || '/' WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN h
WHEN starts_with(h, '//') THEN regexp_extract(url, '^([a-z]+):', 1) || ':' || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || h ELSE regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+(/(?:.*/)?)', 1), ''), '/') || h END))), ' ') AS links FROM n""")
def x21_x27_x32_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21, X27 to X30 and X32 over whole pages (S4): title, text, codes, phones, links and page classes."""
    s = html.page_signals(F.col("html"), F.col("url"))
    rows = read_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", s.alias("s"))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    return rows.select("page_id", "s.title", F.md5("s.text").alias("text_md5"), F.md5("s.normalized").alias("plain_md5"), "s.is_empty", "s.is_parked", "s.is_placeholder", joined("s.postal_codes").alias("postal_codes"), joined("s.phones").alias("phones"), joined("s.links").alias("links"))


@query()
def x31_structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric entities and JSON-LD, on pages that get a block made from the business table."""
    b = view(spark, sf_dir, "v_business").withColumn("page_id", F.col("k"))
    address_part = F.struct(F.col("street").alias("streetAddress"), F.col("postal_code").alias("postalCode"), F.col("city").alias("addressLocality"))
    node = F.to_json(F.struct(F.lit("LocalBusiness").alias("@type"), "name", F.col("phone").alias("telephone"), address_part.alias("address")))
    block = F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"@graph":['), node, F.lit("]}"))).when(F.col("k") % 4 == 1, F.concat(F.lit("["), node, F.lit("]"))).when(F.col("k") % 4 == 2, node).otherwise(F.substring(node, 1, 20))
    page = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script><p>&#8364; "), "html", F.lit("</p>"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").join(b.select("page_id", "name", "street", "postal_code", "city", "phone", "k"), "page_id").withColumn("html", page)
    return rows.select("page_id", F.explode_outer(html.json_ld_of(F.col("html"))).alias("s"), F.substring(html.html_text(F.col("html")), 1, 1).alias("sign")).select("page_id", "s.*", "sign")
