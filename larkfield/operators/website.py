"""Evidence for a business's own website: channels, candidates, page scores, status.

Absence counts only if every channel ran: a channel's status is a column,
never inferred from an empty join. Pages are reduced to signals before any
join, so HTML is not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import postal_key, street_key
from ..functions.phone import compare_phones, normalize_phone
from ..functions.text import coverage_of, distinctive_tokens, let, normalize_text
from ..functions.web import domain_overlap, domains_in, handle_domains, hostname, is_link_page, is_social, is_social_or_directory, normalize_url, registrable_domain, social_profile
from ..refdata import WEIGHTS
from ..storage import cut, spread, stored
from .identity import build_identity
from .leads import stale

ACCEPT, PROBABLE = 70, 45
MAX_FETCHES, MAX_SEARCH, MAX_GUESSES, MAX_PROFILES, MAX_LINK_PAGES, MAX_HOPS, MAX_LISTINGS = 14, 6, 6, 3, 2, 5, 5
#: One of so many documents is searched first by keywords, for bounds.
FIRST = 64
CHANNELS = ("provider_field", "search_engine", "social_profile", "domain_guess", "directory")
ORIGINS = ("declared", "found", "derived")
CANDIDATE = ("business_id", "channel", "origin", "ordinal", "url", "domain")


def _rank(c: Column, values: tuple[str, ...]) -> Column:
    return sum((F.when(c == v, k).otherwise(0) for k, v in enumerate(values)), F.lit(0))


def first_per_domain(candidates: DataFrame) -> DataFrame:
    """The first candidate of each business and domain (or URL without one) in channel order."""
    w = Window.partitionBy("business_id", F.coalesce("domain", "url")).orderBy(_rank(F.col("channel"), CHANNELS), "ordinal", _rank(F.col("origin"), ORIGINS), "url")
    return candidates.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def cap_fetches(candidates: DataFrame, n: int = MAX_FETCHES) -> DataFrame:
    """Declared, found, derived candidates in this order, ``n`` for each business; ``seq`` is the place."""
    w = Window.partitionBy("business_id").orderBy(_rank(F.col("origin"), ORIGINS), _rank(F.col("channel"), CHANNELS), "ordinal", "url")
    return candidates.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= n)


def without_seen(guesses: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates whose domain no other channel has for the business."""
    return guesses.join(seen.select("business_id", "domain").distinct(), ["business_id", "domain"], "left_anti")


def provider_field() -> Column:
    """struct(kind, url) of a profile's website field: none, unreadable, social, directory or declared."""
    blank = F.coalesce(F.trim("website"), F.lit("")) == ""
    kind = lambda url: F.when(blank, "none").when(url.isNull(), "unreadable").when(is_social(url), "social").when(is_social_or_directory(url), "directory").otherwise("declared")
    return let(normalize_url(F.col("website")), lambda url: F.struct(kind(url).alias("kind"), F.when(~blank, url).alias("url")))


def search_queries() -> Column:
    """The queries of a business: name and city; name, street and city; name and phone; else the name alone."""
    name = F.trim("name")
    q = F.concat(F.lit('"'), name, F.lit('"'))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    found = F.array_compact(F.array(F.when(has("city"), F.concat_ws(" ", q, "city")), F.when(has("street") & has("city"), F.concat_ws(" ", q, "street", "city")), F.when(has("phone_e164"), F.concat_ws(" ", q, "phone_e164"))))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(q)).otherwise(found)


def domain_guesses(tlds: tuple[str, ...] = ("de", "com"), most: int = MAX_GUESSES) -> Column:
    """Addresses guessed from name and city: joined, hyphenated, first word, with the city; the cap comes before any exclusion."""
    t = distinctive_tokens(F.col("name"))
    city = F.nullif(F.element_at(F.split(normalize_text(F.col("city")), " "), 1), F.lit(""))
    first, joined = F.try_element_at(t, F.lit(1)), F.array_join(t, "")
    labels = F.array_distinct(F.array_compact(F.array(joined, F.when(F.size(t) > 1, F.array_join(t, "-")), first, F.when(city.isNotNull(), F.concat_ws("-", first, city)), F.when(city.isNotNull(), F.concat_ws("-", joined, city)))))
    urls = F.flatten(F.transform(F.filter(labels, lambda x: F.length(x) >= 4), lambda x: F.array(*[F.concat(F.lit("https://"), x, F.lit(f".{tld}")) for tld in tlds])))
    return F.when(F.size(t) > 0, F.slice(urls, 1, most)).otherwise(F.array().cast("array<string>"))


def search_channel(businesses: DataFrame, results: DataFrame, statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, channel rows). Hits are routed to social, directory or candidate; only those of queries before the first failed one count.

    ``results``: query, rank, url, title, snippet; ``statuses``: query, status
    (ok, unavailable or error). A query without a status was not run. A result
    is read and routed once, before the businesses that ask its query meet it.
    """
    asked = businesses.select(F.col("id").alias("business_id"), F.posexplode(search_queries()).alias("q", "query")).join(statuses, "query", "left").withColumn("status", F.coalesce("status", F.lit("unavailable")))
    failed = F.min(F.when(F.col("status") != "ok", F.struct("q", "status"))).over(Window.partitionBy("business_id"))
    asked = asked.withColumn("failed", failed)
    channel = asked.groupBy("business_id").agg(F.lit("search_engine").alias("channel"), F.coalesce(F.first("failed.status"), F.lit("ok")).alias("status"), F.count_if(F.col("failed").isNull() | (F.col("q") < F.col("failed.q"))).alias("queries_run"))
    found = results.withColumn("url", normalize_url(F.col("url"))).where("url is not null")
    kind = F.when(is_social(F.col("url")), "social").when(is_social_or_directory(F.col("url")), "directory").otherwise("candidate")
    found = found.select("query", "rank", "url", kind.alias("kind"), registrable_domain(F.col("url")).alias("domain"))
    hits = asked.where("failed is null or q < failed.q").select("business_id", "q", "query").join(found, "query").repartition("business_id")  # which both windows take
    w = Window.partitionBy("business_id", "kind", F.when(F.col("kind") == "candidate", F.col("domain")).otherwise(F.col("url"))).orderBy("q", "rank")
    hits = hits.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    order = F.row_number().over(Window.partitionBy("business_id", "kind").orderBy("q", "rank"))
    hits = hits.withColumn("ordinal", order).where((F.col("kind") != "candidate") | (F.col("ordinal") <= MAX_SEARCH))
    return hits.select("business_id", "kind", "ordinal", "url", "domain"), channel


def social_channel(businesses: DataFrame, urls: DataFrame, results: DataFrame, statuses: DataFrame, pages: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates, channel rows, profiles, link pages) from social profiles.

    ``urls``: business_id, ordinal, url of social pages; ``pages``: host_path,
    links and fetch_error of crawled pages. Three profiles are worked on, by
    platform. Handles give derived addresses and a search, whose hits and
    snippets give found ones and link pages; links on two link pages are
    declared. What was collected before a failure stays. Profiles are all
    distinct ones; link pages are those followed or, where something failed,
    all that were met before.
    """
    p = urls.withColumn("p", social_profile(F.col("url"))).where("p is not null").select("business_id", "ordinal", "p.*")
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("business_id", "platform", F.coalesce("handle", "url")).orderBy("ordinal"))).where("k = 1")
    profiles = p.select("business_id", "platform", "handle", "url", "ordinal")
    place = F.when(F.col("platform") == "facebook", 0).when(F.col("platform") == "instagram", 1).when(F.col("platform") == "tiktok", 2).otherwise(3)
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("business_id").orderBy(place, "ordinal"))).where(F.col("k") <= MAX_PROFILES)
    derived = p.where("handle is not null").select("business_id", F.lit("derived").alias("origin"), "k", F.posexplode(handle_domains(F.col("handle"))).alias("n", "url"))
    query = F.trim(F.concat(F.lit('"'), "handle", F.lit('" '), F.coalesce("city", F.lit(""))))
    asked = p.where("handle is not null").join(businesses.select(F.col("id").alias("business_id"), "city"), "business_id").select("business_id", "k", query.alias("query")).join(statuses, "query", "left").withColumn("status", F.coalesce("status", F.lit("unavailable")))
    failed = F.min(F.when(F.col("status") != "ok", F.struct("k", "status"))).over(Window.partitionBy("business_id"))
    asked = asked.withColumn("failed", failed)
    hits = asked.where("failed is null or k < failed.k").join(results, "query")
    named = F.transform(domains_in(F.concat_ws(" ", "title", "snippet")), lambda d: F.concat(F.lit("https://"), d))
    found = hits.select("business_id", F.lit("found").alias("origin"), "k", "rank", F.posexplode(F.concat(F.array(normalize_url(F.col("url"))), named)).alias("m", "url")).where("url is not null").withColumn("n", F.col("rank") * 1000 + F.col("m"))
    link_pages = found.where(is_link_page(F.col("url"))).groupBy("business_id", normalize_url(F.col("url")).alias("page")).agg(F.min(F.struct("k", "n")).alias("at"))
    whole = asked.groupBy("business_id").agg(F.first("failed").alias("failed"))
    met = link_pages.withColumn("j", F.row_number().over(Window.partitionBy("business_id").orderBy("at", "page")))
    link_pages = met.join(whole.where("failed is null").select("business_id"), "business_id").where(F.col("j") <= MAX_LINK_PAGES)
    key = F.concat(hostname(F.col("page")), F.regexp_replace(F.regexp_replace(F.regexp_replace("page", r"^[a-z]+://[^/?#]+", ""), r"[?#].*$", ""), "/$", ""))
    followed = link_pages.withColumn("host_path", key).join(pages.select("host_path", "links", "fetch_error", F.lit(True).alias("crawled")), "host_path", "left")
    bad = F.min(F.when(F.col("fetch_error").isNotNull() | F.col("crawled").isNull(), F.col("j"))).over(Window.partitionBy("business_id"))
    followed = followed.withColumn("bad", bad)
    declared = followed.where("bad is null or j < bad").select("business_id", F.lit("declared").alias("origin"), F.col("j").alias("k"), F.posexplode("links").alias("n", "url"))
    cols = ["business_id", "origin", "k", "n", "url"]
    every = derived.select(cols).unionByName(found.select(cols)).unionByName(declared.select(cols)).withColumn("url", normalize_url(F.col("url"))).where("url is not null")
    every = every.where(~is_social_or_directory(F.col("url")) & ~is_link_page(F.col("url"))).withColumn("domain", registrable_domain(F.col("url")))
    step = F.when(F.col("origin") == "derived", 0).when(F.col("origin") == "found", 1).otherwise(2)
    every = every.withColumn("rn", F.row_number().over(Window.partitionBy("business_id", "domain").orderBy(step, "k", "n"))).where("rn = 1")
    every = without_seen(every, seen).withColumn("ordinal", F.row_number().over(Window.partitionBy("business_id").orderBy(step, "k", "n")))
    status = F.coalesce(F.first("failed.status"), F.when(F.max("bad").isNotNull(), "error"), F.lit("ok"))
    channel = businesses.select(F.col("id").alias("business_id")).join(whole, "business_id", "left").join(followed.groupBy("business_id").agg(F.max("bad").alias("bad")), "business_id", "left").groupBy("business_id").agg(F.lit("social_profile").alias("channel"), status.alias("status"))
    shown = met.join(channel.select("business_id", "status"), "business_id").where((F.col("status") != "ok") | (F.col("j") <= MAX_LINK_PAGES)).select("business_id", F.col("page").alias("url"), F.col("j").alias("ordinal"))
    return every.select("business_id", F.lit("social_profile").alias("channel"), "origin", "ordinal", "url", "domain"), channel, profiles, shown


def directory_status(listings: Column) -> Column:
    """ok when listings were seen, else skipped."""
    return F.when(F.coalesce(listings, F.lit(0)) > 0, "ok").otherwise("skipped")


def host_path(url: Column) -> Column:
    """The key of a crawled page: host without www. and path without a slash at the end."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.concat(hostname(url), F.regexp_replace(rest, "/$", ""))


def redirect_paths(hops: DataFrame, steps: int) -> DataFrame:
    """(at, path): where each address leads in up to ``steps`` redirects, at the most 2 * steps - 1; ``hops``: host_path, redirect_to.

    Paths are put together from paths half as long, so log steps joins of the
    hop table resolve it for all candidates; of two redirects of one address
    the first in order counts.
    """
    one = hops.where("redirect_to is not null").groupBy(F.col("host_path").alias("at")).agg(F.min("redirect_to").alias("to"))
    paths, n = one.select("at", F.array("to").alias("path")), 1
    while n < steps:
        paths = cut(paths)
        on = paths.select(F.col("at").alias("end"), F.col("path").alias("more"))
        both = paths.withColumn("end", host_path(F.element_at("path", -1))).join(on, "end", "left")
        paths, n = both.select("at", F.concat("path", F.coalesce("more", F.array().cast("array<string>"))).alias("path")), 2 * n
    return paths


def follow_redirects(candidates: DataFrame, hops: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """Candidates with final_url and the chain of redirects. More than ``most`` hops leave too_many set; targets that are not there end a chain."""
    paths = redirect_paths(hops, most + 1).select("at", F.slice("path", 1, most).alias("redirects"), (F.size("path") > most).alias("too_many"))
    df = candidates.withColumn("at", host_path(F.col("url"))).join(paths, "at", "left").drop("at")
    df = df.withColumns({"redirects": F.coalesce("redirects", F.array().cast("array<string>")), "too_many": F.coalesce("too_many", F.lit(False))})
    return df.select(*candidates.columns, F.coalesce(F.try_element_at("redirects", F.lit(-1)), "url").alias("final_url"), "redirects", "too_many")


def score_page() -> Column:
    """struct(score, decision, reject_code, signals, strong, conflicts) of a candidate row with business fields and page signals.

    Read: name, street, city, postal_code, country_code, phone_e164; origin,
    url, final_url, redirects, http_status; title, text, normalized, phones,
    postal_codes, structured, is_parked, is_placeholder, is_empty.
    """
    tokens = distinctive_tokens(F.col("name"))
    hay = normalize_text(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    domain = let(F.coalesce(registrable_domain(F.col("final_url")), registrable_domain(F.col("url"))), lambda d: F.when(d.isNotNull(), domain_overlap(d, F.col("name"))))
    facts = {
        "tokens": tokens,
        "coverage": coverage_of(tokens, hay),
        "phones": F.transform("phones", lambda p: compare_phones(F.col("phone_e164"), p)),
        "postal": postal_key(F.col("postal_code")),
        "head": F.element_at(F.split(street_key(F.col("street")), " "), 1),
        "city": F.element_at(F.split(normalize_text(F.col("city")), " "), 1),
        "overlap": domain,
    }
    return let(F.struct(*[c.alias(k) for k, c in facts.items()]), _score_of)


def _score_of(x: Column) -> Column:
    """The score from what ``score_page`` worked out of a row."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    tokens, coverage, phones, postal, head, city = (x[k] for k in ("tokens", "coverage", "phones", "postal", "head", "city"))
    any_phone = has("phone_e164") & (F.size("phones") > 0)
    postal_there = postal.isNotNull() & (F.size("postal_codes") > 0)
    entry = lambda e: (coverage_of(tokens, normalize_text(e["name"])) >= 0.6) & F.coalesce((compare_phones(F.col("phone_e164"), normalize_phone(e["telephone"], F.col("country_code"))["e164"]) == "match") | (postal_key(e["postal"]) == postal), F.lit(False))
    named = F.size(tokens) > 0
    on = {
        "phone_match": any_phone & F.array_contains(phones, "match"),
        "phone_conflict": any_phone & F.forall(phones, lambda x: x == "mismatch"),
        "postal_match": postal_there & F.array_contains("postal_codes", postal),
        "postal_conflict": postal_there & ~F.array_contains("postal_codes", postal),
        "street_match": has("street") & (F.length(head) >= 4) & F.contains(F.col("normalized"), head),
        "city_match": has("city") & (F.length(city) >= 3) & F.contains(F.col("normalized"), city),
        "name_match": named & (coverage >= 0.8),
        "name_match_partial": named & (coverage >= 0.5) & (coverage < 0.8),
        "name_absent": named & (coverage < 0.5),
        "structured_match": F.exists("structured", entry),
        "domain_overlap": x["overlap"] >= 0.5,
        "declared_link": F.col("origin") == "declared",
    }
    flags = F.struct(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in on.items()])
    return let(flags, _decide)


def _decide(on: Column) -> Column:
    """Score, decision and signals from the flags of a row."""
    score = sum((F.when(on[k], points).otherwise(0) for k, points in WEIGHTS.items()), F.lit(0))
    address = on["postal_match"] & on["street_match"]
    hard = F.when(F.col("http_status") >= 400, "http").when(F.col("is_parked"), "parked").when(F.col("is_empty"), "empty")
    named = [F.when(on[k], F.lit(k)) for k in ("phone_match", "phone_conflict", "postal_match", "postal_conflict", "street_match", "city_match", "name_match", "name_match_partial", "name_absent", "structured_match", "domain_overlap", "declared_link")]

    def of(x: Column) -> Column:
        soft = x["hard"].isNull()
        decision = F.when(~soft, "REJECTED").when(F.col("is_placeholder"), "PROBABLE").when(x["conflict"] & (x["score"] < ACCEPT), "REJECTED").when((x["score"] >= ACCEPT) & x["strong"], "ACCEPTED").when(x["score"] >= PROBABLE, "PROBABLE").otherwise("REJECTED")
        points = F.when(~soft, 0).when(F.col("is_placeholder"), F.least(x["score"], F.lit(PROBABLE))).otherwise(x["score"])
        signals = F.array_compact(F.array(*named, F.when(address, "address_match"), F.when(F.size("redirects") > 0, "redirect")))
        conflicts = F.array_compact(F.array(F.when(on["phone_conflict"] & soft, "phone"), F.when(on["postal_conflict"] & soft, "postal_code")))
        code = lambda d: F.when(~soft, x["hard"]).when(d != "REJECTED", F.lit(None)).when(x["conflict"], "conflict").otherwise("weak")
        return let(decision, lambda d: F.struct(points.cast("int").alias("score"), d.alias("decision"), code(d).alias("reject_code"), F.when(soft, signals).otherwise(F.array().cast("array<string>")).alias("signals"), (x["strong"] & soft).alias("strong"), conflicts.alias("conflicts")))

    facts = F.struct(score.alias("score"), (on["phone_match"] | on["declared_link"] | address).alias("strong"), (on["phone_conflict"] | on["postal_conflict"]).alias("conflict"), hard.alias("hard"))
    return let(facts, of)


def judge_candidates(candidates: DataFrame, businesses: DataFrame, pages: DataFrame) -> DataFrame:
    """Each candidate with its page's score. A page that was not read is UNREACHABLE, or REJECTED if the address was only derived and a retry is no use.

    ``pages``: host_path, http_status, fetch_error, retryable and the signals
    of ``page_signals``, one row for each page.
    """
    b = businesses.select(F.col("id").alias("business_id"), "name", "street", "city", "postal_code", "country_code", "phone_e164")
    df = candidates.withColumn("host_path", host_path(F.col("final_url"))).join(pages, "host_path", "left").join(b, "business_id")
    missing = F.col("http_status").isNull() | F.col("fetch_error").isNotNull()
    s = F.when(~missing, score_page())
    lost = F.when((F.col("origin") == "derived") & ~F.coalesce("retryable", F.lit(False)), "REJECTED").otherwise("UNREACHABLE")
    return df.withColumn("s", s).select(*candidates.columns, F.coalesce("s.decision", lost).alias("decision"), F.coalesce("s.score", F.lit(0)).alias("score"), F.when(missing, "unreachable").otherwise(F.col("s.reject_code")).alias("reject_code"), F.coalesce("s.signals", F.array().cast("array<string>")).alias("signals"))


def channel_summary(channels: DataFrame) -> DataFrame:
    """For each business: channels that ran, those that block a conclusion, and their names."""
    blocks = F.col("status").isin("unavailable", "error")
    return channels.groupBy("business_id").agg(F.count_if(F.col("status") == "ok").alias("ok_channels"), F.count_if(blocks).alias("blocked"), F.array_sort(F.collect_list(F.when(blocks, F.col("channel")))).alias("blockers"))


def candidate_summary(judged: DataFrame) -> DataFrame:
    """For each business: the best accepted and probable candidate, and whether any is unreachable, parked though declared, or ambiguous."""
    best = lambda d: F.max_by(F.struct("url", "score"), F.when(F.col("decision") == d, F.struct(F.col("score"), (-F.col("seq")).alias("k"))))
    negative = F.exists("signals", lambda s: s.isin(*NEGATIVE))
    named = F.exists("signals", lambda s: s.isin("name_match", "name_match_partial"))
    return judged.groupBy("business_id").agg(
        best("ACCEPTED").alias("accepted"),
        best("PROBABLE").alias("probable"),
        F.count_if((F.col("decision") == "UNREACHABLE") & (F.col("origin") != "derived")).alias("unreachable"),
        F.count_if((F.col("reject_code") == "parked") & (F.col("origin") == "declared")).alias("parked"),
        F.count_if((F.col("decision") == "REJECTED") & (F.col("score") > 0) & ~negative & named).alias("ambiguous"),
    )


def website_status(least_channels: int = 2) -> Column:
    """struct(status, confidence) of a business with its summaries; the first rung that fits.

    Read: identity_status, identity_confidence, accepted, probable,
    unreachable, parked, ambiguous, ok_channels, blocked, n_profiles,
    social_as_website.
    """
    out = lambda s, c: F.struct(F.lit(s).alias("status"), F.greatest(F.lit(0), F.least(F.lit(100), c.cast("int") if isinstance(c, Column) else F.lit(c))).alias("confidence"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    confirmed = F.col("identity_status") == "CONFIRMED"
    none = 90 + F.when(n("ok_channels") >= 3, 5).otherwise(0) - F.when(n("n_profiles") > 0, 12).otherwise(0) - F.when(F.coalesce("social_as_website", F.lit(False)), 5).otherwise(0)
    manual = "REQUIRES_MANUAL_CHECK"
    return (
        F.when(F.col("identity_status").isin("UNVERIFIED", "NEEDS_REVIEW"), out("IDENTITY_UNVERIFIED", F.col("identity_confidence")))
        .when(F.col("accepted").isNotNull() & confirmed, out("VERIFIED_WEBSITE", F.col("accepted.score")))
        .when(F.col("accepted").isNotNull(), out("PROBABLE_WEBSITE", F.least(F.lit(69), F.col("accepted.score"))))
        .when(F.col("probable").isNotNull(), out("PROBABLE_WEBSITE", F.least(F.lit(69), F.col("probable.score"))))
        .when(n("unreachable") > 0, out(manual, 40))
        .when(n("parked") > 0, out(manual, 45))
        .when(n("ambiguous") > 0, out("WEBSITE_UNCERTAIN", 40))
        .when(n("blocked") > 0, out(manual, 30))
        .when(~confirmed, out(manual, 35))
        .when(n("ok_channels") < least_channels, out(manual, 35))
        .when(none >= 70, out("VERIFIED_NO_WEBSITE", none))
        .otherwise(out(manual, none))
    )


@dataclass
class Verified:
    """What ``verify_websites`` found: conclusions, judged candidates, channel rows, and the social profiles, link pages and directory listings met."""

    concluded: DataFrame
    judged: DataFrame
    channels: DataFrame
    profiles: DataFrame
    link_pages: DataFrame
    listings: DataFrame


#: Signals that count against a candidate.
NEGATIVE = ("phone_conflict", "postal_conflict", "name_absent")


def evidence(found: Verified) -> DataFrame:
    """(business_id, kind, code, url, stance, seq): the statements of each verification in a stable order.

    Identity, candidates, channels, social profiles, followed link pages, up to
    ``MAX_LISTINGS`` directory listings, conclusion. An accepted candidate
    supports; a rejected one contradicts only if a signal speaks against it; a
    channel that should have run and could not contradicts.
    """
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, part: int, k: Column, kind: Column, code: Column, url: Column, stance: Column) -> DataFrame:
        return df.select("business_id", F.lit(part).alias("part"), k.cast("long").alias("k"), kind.alias("kind"), code.cast("string").alias("code"), url.alias("url"), stance.alias("stance"))

    against = F.exists("signals", lambda s: s.isin(*NEGATIVE))
    of_candidate = F.when(F.col("decision") == "ACCEPTED", "supports").when((F.col("decision") == "REJECTED") & against, "contradicts").otherwise("neutral")
    of_channel = F.when(F.col("status").isin("ok", "skipped"), "neutral").otherwise("contradicts")
    neutral, zero = F.lit("neutral"), F.lit(0)
    sure = F.when(F.col("identity_status") == "CONFIRMED", "supports").otherwise("neutral")
    settled = F.when(F.col("website_status").isin("VERIFIED_WEBSITE", "VERIFIED_NO_WEBSITE"), "supports").otherwise("neutral")
    parts = [
        rows(found.concluded, 0, zero, F.lit("identity"), F.col("identity_status"), none, sure),
        rows(found.judged, 1, F.col("seq"), F.concat(F.lit("candidate_"), F.lower("decision")), F.col("domain"), F.coalesce("final_url", "url"), of_candidate),
        rows(found.channels, 2, _rank(F.col("channel"), CHANNELS), F.concat(F.lit("channel_"), "channel"), F.col("status"), none, of_channel),
        rows(found.profiles, 3, F.col("ordinal"), F.lit("social_profile"), F.concat_ws(":", "platform", "handle"), F.col("url"), neutral),
        rows(found.link_pages, 4, F.col("ordinal"), F.lit("link_in_bio"), registrable_domain(F.col("url")), F.col("url"), neutral),
        rows(found.listings.where(F.col("ordinal") <= MAX_LISTINGS), 5, F.col("ordinal"), F.lit("directory_listing"), registrable_domain(F.col("url")), F.col("url"), neutral),
        rows(found.concluded, 9, zero, F.lit("conclusion"), F.col("website_status"), F.col("website_url"), settled),
    ]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("seq", F.row_number().over(Window.partitionBy("business_id").orderBy("part", "k", "url"))).drop("part", "k")


def verify_websites(businesses: DataFrame, search: DataFrame, statuses: DataFrame, pages: DataFrame, hops: DataFrame, least_channels: int = 2, max_businesses: int | None = None) -> Verified:
    """All given businesses against search results, crawled pages and redirects.

    ``businesses`` may have ``social_urls``, social pages that the source
    states beside the website. A business that comes out of no step gets
    REQUIRES_MANUAL_CHECK with confidence 0, so a failed check never looks like
    a result. With ``max_businesses`` only the first by id are checked.
    """
    if max_businesses is not None:
        businesses = businesses.orderBy("id").limit(max_businesses)
    businesses, pages = cut(businesses), cut(pages)
    ready = businesses.where(~F.col("identity_status").isin("UNVERIFIED", "NEEDS_REVIEW"))
    field = ready.withColumn("f", provider_field()).select(F.col("id").alias("business_id"), "f.kind", "f.url")
    hits, search_rows = search_channel(ready, search, statuses)
    hits, search_rows = cut(hits), cut(search_rows)
    declared = field.where("kind = 'declared'").select("business_id", F.lit("provider_field").alias("channel"), F.lit("declared").alias("origin"), F.lit(1).alias("ordinal"), "url", registrable_domain(F.col("url")).alias("domain"))
    found = hits.where("kind = 'candidate'").select("business_id", F.lit("search_engine").alias("channel"), F.lit("found").alias("origin"), "ordinal", "url", "domain")
    seen = declared.unionByName(found)
    social_urls = field.where("kind = 'social'").select("business_id", F.lit(0).alias("ordinal"), "url").unionByName(hits.where("kind = 'social'").select("business_id", "ordinal", "url"))
    if "social_urls" in ready.columns:  # they come before the website field
        stated = ready.select(F.col("id").alias("business_id"), F.posexplode("social_urls").alias("n", "url")).where(is_social(F.col("url")))
        social_urls = social_urls.unionByName(stated.select("business_id", (F.col("n") - (1 << 20)).alias("ordinal"), "url"))
    social_urls = cut(social_urls.groupBy("business_id", "url").agg(F.min("ordinal").alias("ordinal")))
    social, social_rows, profiles, link_pages = (cut(x) for x in social_channel(ready, social_urls, search, statuses, pages, seen))
    guesses = ready.select(F.col("id").alias("business_id"), F.posexplode(domain_guesses()).alias("ordinal", "url")).withColumn("domain", registrable_domain(F.col("url")))
    guesses = without_seen(guesses, seen.select("business_id", "domain").unionByName(social.select("business_id", "domain"))).select("business_id", F.lit("domain_guess").alias("channel"), F.lit("derived").alias("origin"), "ordinal", "url", "domain")
    queue = cap_fetches(first_per_domain(seen.unionByName(social).unionByName(guesses)))
    judged = cut(judge_candidates(follow_redirects(cut(queue), hops), ready, pages))
    listings = hits.where("kind = 'directory'").select("business_id", "url", "ordinal")
    counted = listings.groupBy("business_id").agg(F.count("*").alias("n"))
    ids = ready.select(F.col("id").alias("business_id"))
    rows = search_rows.select("business_id", "channel", "status").unionByName(social_rows)
    for name in ("provider_field", "domain_guess"):
        rows = rows.unionByName(ids.select("business_id", F.lit(name).alias("channel"), F.lit("ok").alias("status")))
    rows = cut(rows.unionByName(ids.join(counted, "business_id", "left").select("business_id", F.lit("directory").alias("channel"), directory_status(F.col("n")).alias("status"))))
    n_profiles = profiles.groupBy("business_id").agg(F.count("*").alias("n_profiles"))
    as_site = field.select("business_id", (F.col("kind") == "social").alias("social_as_website"))
    joined = businesses.select(F.col("id").alias("business_id"), "identity_status", "identity_confidence")
    for part in (channel_summary(rows), candidate_summary(judged), n_profiles, as_site):
        joined = joined.join(part, "business_id", "left")
    joined = joined.withColumn("w", website_status(least_channels))
    concluded = joined.select("business_id", "identity_status", F.coalesce("w.status", F.lit("REQUIRES_MANUAL_CHECK")).alias("website_status"), F.coalesce("w.confidence", F.lit(0)).alias("website_confidence"), F.coalesce("accepted.url", "probable.url").alias("website_url"), "ok_channels", "blocked")
    return Verified(cut(concluded), judged, rows, profiles, link_pages, listings)


#: What a source's JSON says of websites.
STATED = "website string, socialUrls array<string>"


def check_stale(businesses: DataFrame, sources: DataFrame, search: DataFrame, statuses: DataFrame, pages: DataFrame, hops: DataFrame, as_of_ms: int, ttl_days: int = 30, failed: DataFrame | None = None) -> tuple[DataFrame, Verified]:
    """(the businesses after the check, what was found): verify those that were never checked or too long ago.

    ``sources``: provider, external_id, business_id, fetched_ms, raw_json. One
    aggregation gives the latest payload, whose website and social pages are
    looked at, and the number of sources, which corroborates the identity;
    the stored identity status and confidence win over the computed ones.
    Checked rows get website_status, website_confidence, website_url and
    checked_ms; those in ``failed`` (business_id), whose check broke off, get
    REQUIRES_MANUAL_CHECK with confidence 0 and no address. Others stay as
    they are, so a second run at the same instant checks nothing.
    """
    due = stale(businesses, as_of_ms, ttl_days)
    latest = sources.groupBy("business_id").agg(F.max_by("raw_json", F.struct("fetched_ms", "provider", "external_id")).alias("raw_json"), F.count("*").cast("int").alias("n_sources"))
    raw = F.from_json("raw_json", STATED)
    joined = due.join(latest.withColumnRenamed("business_id", "id"), "id", "left").withColumns({"stored_status": F.col("identity_status"), "stored_confidence": F.col("identity_confidence"), "website": raw["website"], "social_urls": raw["socialUrls"], "sources": F.coalesce("n_sources", F.lit(0)), "phone": F.coalesce(F.nullif("phone_e164", F.lit("")), "phone")})
    built = build_identity(joined.drop("identity_status", "identity_confidence", "phone_e164")).withColumns({"identity_status": F.col("stored_status"), "identity_confidence": F.col("stored_confidence")})
    found = verify_websites(built, search, statuses, pages, hops)
    done = found.concluded.select(F.col("business_id").alias("id"), F.col("website_status").alias("new_status"), F.col("website_confidence").alias("new_confidence"), F.col("website_url").alias("new_url"))
    if failed is not None:
        broke = failed.select(F.col("business_id").alias("id"), F.lit(True).alias("broke")).distinct()
        lost = F.coalesce("broke", F.lit(False))
        done = done.join(broke, "id", "left").select("id", F.when(lost, "REQUIRES_MANUAL_CHECK").otherwise(F.col("new_status")).alias("new_status"), F.when(lost, 0).otherwise(F.col("new_confidence")).alias("new_confidence"), F.when(~lost, F.col("new_url")).alias("new_url"))
    new = {"website_status": F.col("new_status"), "website_confidence": F.col("new_confidence"), "website_url": F.col("new_url"), "checked_ms": F.lit(as_of_ms).cast("long")}
    checked = F.col("new_status").isNotNull()
    out = businesses if "website_url" in businesses.columns else businesses.withColumn("website_url", F.lit(None).cast("string"))
    names = out.columns
    out = out.join(done, "id", "left").withColumns({c: F.when(checked, x).otherwise(F.col(c)) for c, x in new.items()})
    return out.select(*names), found


def keyword_search(queries: DataFrame, index: DataFrame, least: int = 2, k: int = 10) -> DataFrame:
    """(query_id, doc_id, hits, share, rank): documents with at least ``least`` distinct keywords in the query, by share of their keywords, then hits, then id.

    ``queries``: query_id, text; ``index``: doc_id, keywords (normalised), one
    row for each document. Documents are dealt by their ids and asked for the
    queries' words, so hits of a document are counted where it lies, and no
    word is a key. One document in ``FIRST`` is searched first: the k-th share
    that these give is a bound that all results must reach, and what does not
    reach it is left before rows are shuffled and sorted by query. Null texts
    and keywords have no words; a query for which the first documents give
    fewer than ``k`` results has no bound and loses nothing.
    """
    q = stored(queries.where("text is not null").select("query_id", F.explode(F.array_distinct(F.split(normalize_text(F.col("text")), " "))).alias("word")).where("length(word) >= 2").distinct())

    def hits_in(documents: DataFrame) -> DataFrame:
        words = spread(documents.select("doc_id", F.array_distinct(F.filter("keywords", lambda w: F.length(w) >= 2)).alias("words")), "doc_id")
        d = words.select("doc_id", F.size("words").alias("n"), F.explode("words").alias("word"))
        hits = d.join(q, "word").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"), F.max("n").alias("n"))
        return hits.where(F.col("hits") >= least).select("query_id", "doc_id", "hits", (F.col("hits") / F.col("n")).alias("share"))

    of_query = Window.partitionBy("query_id")
    first = hits_in(index.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST)) == 0)).withColumn("rn", F.row_number().over(of_query.orderBy(F.desc("share")))).where(F.col("rn") <= k)
    bound = stored(first.where(F.col("rn") == k).select("query_id", F.col("share").alias("bound")))
    able = hits_in(index).join(bound, "query_id", "left").where("bound is null or share >= bound").drop("bound")
    w = of_query.orderBy(F.desc("share"), F.desc("hits"), "doc_id")
    return able.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
