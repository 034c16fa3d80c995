"""Scalar functions on our own invented values, each with null and blank inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkfield.functions import address, geo, hours, html, phone, text, web
from larkfield.storage import cut


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def test_text(spark):
    row = spark.range(1).select(
        text.normalize_text(F.lit("  Äpfel & Söhne – Größe  ")).alias("a"), text.normalize_text(lit(None)).alias("b"), text.business_name(F.lit("GmbH & Co. KG")).alias("c"), text.business_name(F.lit("Tischlerei Muster GmbH")).alias("d"),
        text.distinctive_tokens(F.lit("Salon zur Alten Mühle")).alias("e"), text.name_similarity(F.lit("Bäckerei Holzer"), F.lit("Baeckerei Holzer GmbH")).alias("f"), text.name_similarity(F.lit("Nordlicht Optik"), F.lit("Pizzeria Roma")).alias("g"),
        text.clean_string(F.lit("  a  b ")).alias("h"), text.clean_string(F.lit("   ")).alias("i"), text.token_coverage(F.lit("Optik Nordlicht"), F.lit("Willkommen bei nordlicht")).alias("j"),
    ).first()
    assert row[:5] == ("aepfel und soehne groesse", "", "und", "tischlerei muster", ["alten", "muehle"])
    assert row.f == 1.0 and row.g < 0.3 and row.h == "a b" and row.i is None and row.j == 0.5


def test_phone(spark):
    forms = ["030 1234567", "+49 (0)30 1234567", "0049-30-1234567"]
    assert {one(spark, phone.normalize_phone(F.lit(f))["e164"]) for f in forms} == {"+49301234567"}
    assert one(spark, phone.normalize_phone(F.lit("123"))["is_valid"]) is False
    assert one(spark, phone.normalize_phone(F.lit(" "))) is None
    assert one(spark, phone.compare_phones(F.lit("+49301234567"), F.lit("+4930123456789"))) == "unknown"
    assert one(spark, phone.compare_phones(F.lit("+49301234567"), F.lit("+49309999999"))) == "mismatch"
    assert one(spark, phone.phone_numbers_in(F.lit("Tel. 030/1234567 oder 030 123 45 67, Nr. 12"))) == ["+49301234567"]


def test_address(spark):
    assert one(spark, address.street_key(F.lit("Lindenstraße"))) == one(spark, address.street_key(F.lit("Linden-Str."))) == "linden str"
    assert one(spark, address.split_street(F.lit("Am Ufer 12 b"))) == ("Am Ufer", "12 b")
    assert one(spark, address.split_street(F.lit("12 Long Lane"))) == ("Long Lane", "12")
    assert one(spark, address.address_key(F.lit("de"), F.lit("10115"), F.lit("Ufer"), lit(None))) == "de|10115|ufer|"
    assert one(spark, address.address_key(F.lit("de"), lit(None), F.lit("Ufer"), F.lit("1"))) is None
    assert one(spark, address.postal_codes_in(F.lit("10115 Berlin, SW1A 1AA London, 10115"))) == ["10115", "SW1A1AA"]


def test_web(spark):
    assert one(spark, web.registrable_domain(F.lit("www.shop.muster.co.uk/x"))) == "muster.co.uk"
    assert one(spark, web.normalize_url(F.lit("Muster.DE?q=1#top"))) == "https://muster.de/?q=1"
    assert one(spark, web.normalize_url(F.lit("ftp://muster.de"))) is None
    assert one(spark, web.is_social(F.lit("https://m.facebook.com/x"))) and not one(spark, web.is_social(lit(None)))
    assert one(spark, web.is_social_or_directory(F.lit("https://maps.google.com/x")))
    assert one(spark, web.social_profile(F.lit("https://instagram.com/@cafe.muster/")))[:2] == ("instagram", "cafe.muster")
    assert one(spark, web.social_profile(F.lit("https://instagram.com/p/abc")))[:2] == ("instagram", None)
    assert one(spark, web.handle_domains(F.lit("cafe.muster"))) == ["https://cafemuster.de", "https://cafemuster.com", "https://cafe-muster.de", "https://cafe-muster.com"]
    assert one(spark, web.domains_in(F.lit("see www.muster.de and photo.jpg.com or bild.jpg"))) == ["muster.de", "photo.jpg.com"]


def test_html(spark):
    page = "<html><title>A &amp;lt; B</title><script>no</script><!-- no --><p>Tel &#8364;&#x41; caf&eacute; &unknown;</p><a href='/x'>x</a><a href='mailto:a'>m</a></html>"
    assert one(spark, html.html_text(F.lit(page))) == "A &lt; B Tel €A café &unknown; x m"
    assert one(spark, html.title_of(F.lit(page))) == "A &lt; B"
    assert one(spark, html.links_of(F.lit(page), F.lit("https://Muster.de/a/b?c"))) == ["https://muster.de/x"]
    block = '<script type="application/ld+json">{"@graph":[{"@type":"Shop","name":"M","address":{"postalCode":"1"}}]}</script><script type="application/ld+json">{bad</script>'
    found = one(spark, html.json_ld_of(F.lit(block)))
    assert [(r.type, r.name, r.postal) for r in found] == [("Shop", "M", "1")]


def test_hours(spark):
    raws = {"blank": "  ", "none": None, "week": "Mo-Fr 9-12,14-18; Fr 20:00-02:00; We off; PH off", "always": "24/7", "text": "nach Vereinbarung", "sat": "Sa 10:00-13:00", "sat_berlin": "Sa 10:00-13:00", "su": "Su 10-12"}
    rows = [(k, v, "Europe/Berlin" if "berlin" in k else "UTC") for k, v in raws.items()]
    df = spark.createDataFrame(rows, "k string, raw string, zone string").repartition(1)
    df = cut(df.withColumn("h", hours.parse_opening_hours(F.col("raw"), F.col("zone"))))
    at = F.timestamp_millis(F.lit(1_717_243_200_000))  # Saturday 12:00 UTC, 14:00 in Berlin
    got = {r.k: r for r in df.withColumn("s", hours.opening_status(F.col("h"), at)).collect()}
    assert got["blank"].h is None and got["none"].h is None
    h = got["week"].h
    days = {d.weekday: [tuple(x) for x in d.intervals] for d in h.days}
    assert days[1] == [(540, 720), (840, 1080)] and days[3] == [] and days[5] == [(0, 120), (540, 720), (840, 1080), (1200, 1440)] and h.unparsed == ["PH off"]
    assert all(d.intervals == [(0, 1440)] for d in got["always"].h.days)
    assert got["text"].h.unparsed == ["nach Vereinbarung"] and got["text"].s.state == "unknown"
    assert got["sat"].s[:2] == ("open", "Closes 13:00") and got["sat_berlin"].s[:2] == ("closed", "Opens Saturday 10:00")
    assert got["su"].s[:2] == ("closed", "Opens tomorrow 10:00") and got["none"].s == ("unknown", None, False)
    assert [one(spark, hours.parse_clock(F.lit(x))) for x in ("24:00", "25:00", "9.30")] == [1440, None, 570]


def test_geo(spark):
    assert 50_000 < one(spark, geo.distance_m(F.lit(52.52), F.lit(13.40), F.lit(52.40), F.lit(12.60))) < 60_000
    assert one(spark, geo.is_valid_point(F.lit(91.0), F.lit(0.0))) is False and one(spark, geo.is_valid_point(F.lit(None).cast("double"), F.lit(0.0))) is False
