"""Discovery records from source JSON, typed tables, crawled pages; keyed and related writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURE = "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
PLACE = "id string, displayName struct<text:string>, addressComponents array<struct<longText:string,types:array<string>>>, formattedAddress string, location struct<latitude:double,longitude:double>, internationalPhoneNumber string, websiteUri string, primaryType string"
SOCIAL_TAGS = ("contact:facebook", "facebook", "contact:instagram", "instagram", "contact:tiktok")


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of ``feature`` or ``place`` records with their fixed schema."""
    return spark.read.schema({"feature": FEATURE, "place": PLACE}[kind]).json(path)


def from_features(features: DataFrame) -> DataFrame:
    """Map features as discovery records: the first tag of each list that is there; unnamed ones are dropped; a centre stands in for a point."""
    tag = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at("tags", F.lit(k))), F.lit("")) for k in keys])
    return features.select(
        F.lit("map").alias("provider"), F.concat_ws("/", "type", F.col("id").cast("string")).alias("external_id"), tag("name", "brand", "operator").alias("name"),
        F.coalesce(tag("shop"), tag("amenity"), tag("craft")).alias("category"), tag("addr:street").alias("street"), tag("addr:housenumber").alias("house_number"),
        tag("addr:postcode").alias("postal_code"), tag("addr:city", "addr:town", "addr:village").alias("city"), tag("addr:country").alias("country_code"),
        F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), tag("contact:phone", "phone", "contact:mobile").alias("phone"),
        tag("contact:website", "website", "url").alias("website"), F.array_compact(F.array(*[tag(k) for k in SOCIAL_TAGS])).alias("social_urls"), tag("opening_hours").alias("opening_hours_raw"),
    ).where("name is not null")


def from_places(places: DataFrame, unnamed: str = "(no name)") -> DataFrame:
    """Place records as discovery records: address parts by component type, else from the first line of the address; a missing name gets a placeholder."""
    from ..functions.address import split_street

    part = lambda kind: F.try_element_at(F.filter("addressComponents", lambda c: F.array_contains(c["types"], kind)), F.lit(1))["longText"]
    line = split_street(F.element_at(F.split("formattedAddress", ","), 1))
    return places.select(
        F.lit("places").alias("provider"), F.col("id").alias("external_id"), F.coalesce("displayName.text", F.lit(unnamed)).alias("name"), F.col("primaryType").alias("category"),
        F.coalesce(part("route"), line["street"]).alias("street"), F.coalesce(part("street_number"), F.when(part("route").isNull(), line["house_number"])).alias("house_number"),
        part("postal_code").alias("postal_code"), F.coalesce(part("locality"), part("postal_town")).alias("city"), part("country").alias("country_code"),
        F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lon"), F.col("internationalPhoneNumber").alias("phone"), F.col("websiteUri").alias("website"),
    )


def typed(df: DataFrame, times: Sequence[str] = (), flags: Sequence[str] = (), nested: dict[str, str] | None = None) -> DataFrame:
    """Stored columns in their types: epoch milliseconds as timestamps, 0 and 1 as booleans, JSON text as nested values (null where malformed)."""
    new: dict[str, Column] = {c: F.timestamp_millis(F.col(c)) for c in times} | {c: F.col(c) == 1 for c in flags}
    return df.withColumns(new | {c: F.from_json(F.col(c), kind) for c, kind in (nested or {}).items()})


def read_pages(pages: DataFrame, most_chars: int = 1_500_000, url: str = "url", body: str = "html") -> DataFrame:
    """Crawled pages with their bodies cut at a size."""
    return pages.withColumn(body, F.substring(F.col(body), 1, most_chars)).withColumn("truncated", F.length(F.col(body)) >= most_chars)


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], newest: str) -> DataFrame:
    """The newest row of each key; an incoming one wins a tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc(newest), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


#: The related tables of a verification run.
RELATED = ("verifications", "candidates", "evidence")


def write_verifications(concluded: DataFrame, judged: DataFrame, statements: DataFrame, path: str, run: str) -> None:
    """Three related tables of one run under ``path``, visible all at once.

    Each attempt writes folders of its own; the run's row in ``manifest``,
    which names the attempt, is written last and replaces an earlier one. What
    a broken attempt has left is named by no row and so never read.
    """
    spark, attempt = concluded.sparkSession, uuid.uuid4().hex
    for name, df in zip(RELATED, (concluded, judged, statements), strict=True):
        df.write.parquet(f"{path}/{name}/run={run}/attempt={attempt}")
    spark.range(1).select(F.lit(attempt).alias("attempt")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/run={run}")


def read_verifications(spark: SparkSession, path: str, schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """The related tables of all committed runs, each with ``run``; only the folders of the attempts that the manifest names are read."""
    manifest = spark.read.schema("attempt string, run string").option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")
    committed = sorted((r.run, r.attempt) for r in manifest.collect())  # a row for each run
    out = {}
    for name in RELATED:
        folders = [f"{path}/{name}/run={run}/attempt={attempt}" for run, attempt in committed]
        reader = spark.read if schemas is None else spark.read.schema(schemas[name])
        out[name] = reader.option("basePath", f"{path}/{name}").parquet(*folders).drop("attempt").withColumn("run", F.col("run").cast("string"))
    return out


def run_items(outcomes: DataFrame, run_id: str | Column) -> DataFrame:
    """The log rows of a run, or of the runs that a column names: one for each record, its outcome, and whether it met a conflict."""
    return outcomes.select(F.lit(run_id).alias("run_id"), "incoming_id", "business_id", "outcome", "conflict")
