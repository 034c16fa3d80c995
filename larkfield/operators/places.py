"""Places, radius and category lookups."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE, distance_m
from ..functions.text import normalize_text
from ..refdata import CATEGORIES, accent_table
from ..storage import stored


def within_radius(rows: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Rows within ``km`` of a point: a box that a scan can push down, then the exact distance."""
    dlat = km / KM_PER_DEGREE
    dlon = km / (KM_PER_DEGREE * max(0.01, cos(radians(lat))))
    box = F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon)
    return rows.where(box).where(distance_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= km * 1000)


def discover(rows: DataFrame, lat: float, lon: float, km: float, category: str | None, wanted: int) -> DataFrame:
    """Rows near a point, of a category if one is given: four times as many as wanted, 20 to 200, by id."""
    near = within_radius(rows, lat, lon, km)
    return (near.where(F.col("category") == category) if category else near).orderBy("id").limit(min(200, max(20, 4 * wanted)))


def nearest_place(rows: DataFrame, places: DataFrame, km: float = 25.0) -> DataFrame:
    """(id, label, metres): the nearest place within ``km`` of each row with a point.

    Both sides meet in grid cells as wide as the radius: a place is put in
    the cells that its circle can reach, and the places of a cell are one
    list, so a point is joined once, with its own cell, and never multiplied.
    Rows of one point are looked up once.
    Ties go to the smaller ordinal; of rows that share an id the nearest counts.
    """
    step = km / KM_PER_DEGREE
    width = lambda band: step / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(band), F.abs(band + 1)) * step))))
    band = F.floor(F.col("lat") / step)
    p = places.where("lat is not null and lon is not null").select("ordinal", "label", "lat", "lon", F.explode(F.sequence(band - 1, band + 1)).alias("band"))
    w = width(F.col("band"))
    # a place near the 180th meridian is also on its other side
    ways = F.explode(F.array_compact(F.array("lon", F.when(F.abs("lon") > 180 - 2 * w, F.col("lon") - 360 * F.signum("lon")))))
    p = p.withColumn("at", ways).withColumn("cell", F.explode(F.sequence(F.floor(F.col("at") / w) - 1, F.floor(F.col("at") / w) + 1)))
    cells = p.groupBy("band", "cell").agg(F.collect_set(F.struct("ordinal", "label", "lat", "lon")).alias("places"))
    placed = rows.where("lat is not null and lon is not null").select("id", "lat", "lon")
    points = stored(placed.select("lat", "lon").distinct()).repartition("lat", "lon")
    points = points.withColumn("band", band).withColumn("cell", F.floor(F.col("lon") / width(F.col("band"))))
    far = lambda x: distance_m(F.col("lat"), F.col("lon"), x["lat"], x["lon"])
    near = F.array_min(F.filter(F.transform("places", lambda x: F.struct(far(x).alias("metres"), x["ordinal"].alias("ordinal"), x["label"].alias("label"))), lambda x: x["metres"] <= km * 1000))
    found = stored(points.join(cells, ["band", "cell"]).select("lat", "lon", near.alias("x")).where("x is not null"))
    nearest = placed.join(found, ["lat", "lon"]).select("id", "x").repartition("id").groupBy("id").agg(F.min("x").alias("x"))
    return nearest.select("id", "x.label", "x.metres")


def lookup_places(queries: DataFrame, places: DataFrame) -> DataFrame:
    """(query, label): the first place whose alias the normalised query contains.

    The pieces of a query that are as long as some alias meet the aliases in
    an equality join, so the gazetteer may have any size; the driver sees only
    the lengths that occur.
    """
    known = places.select("ordinal", "label", normalize_text(F.col("alias")).alias("alias")).where("alias <> ''")
    lengths = sorted(r.n for r in known.select(F.length("alias").alias("n")).distinct().collect())
    asked = queries.select("query", normalize_text(F.col("query")).alias("text")).distinct()
    spots = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda k: F.substring("text", k, F.lit(n)))
    pieces = F.flatten(F.array(*[F.when(F.length("text") >= n, spots(n)).otherwise(F.array().cast("array<string>")) for n in lengths])) if lengths else F.array().cast("array<string>")
    hits = asked.select("query", F.explode(F.array_distinct(pieces)).alias("alias")).join(known, "alias")
    return hits.groupBy("query").agg(F.min(F.struct("ordinal", "label")).alias("x")).select("query", "x.label")


def category_of_text(text: Column) -> Column:
    """The first category whose key or synonym the text holds as a word, also with s or es; accents go before umlauts are spelled out."""
    low = F.translate(F.translate(F.lower(text), "äöü", "aou"), *accent_table())
    needle = F.trim(F.regexp_replace(F.replace(low, F.lit("ß"), F.lit("ss")), "[^a-z0-9 ]+", " "))
    out = F.lit(None).cast("string")
    for key, _, synonyms in reversed(CATEGORIES):
        out = F.when(needle.rlike(rf"(^|\s)({'|'.join((key, *synonyms))})(s|es)?(\s|$)"), key).otherwise(out)
    return F.when(needle != "", out)


def category_of_pairs(pairs: Column) -> Column:
    """The first category that has one of the source's key=value pairs."""
    out = F.lit(None).cast("string")
    for key, tags, _ in reversed(CATEGORIES):
        out = F.when(F.arrays_overlap(pairs, F.array(*[F.lit(t) for t in tags])), key).otherwise(out)
    return out


def category_of_tags(tags: Column) -> Column:
    """The same for a map of tags."""
    return category_of_pairs(F.transform(F.map_entries(tags), lambda e: F.concat_ws("=", e["key"], e["value"])))
