"""Repeated loads: snapshots, marks, replays and streams that follow one another."""

from __future__ import annotations

import shutil
import tempfile

from pyspark.sql import functions as F

from larkfield.streaming import jobs

RECORD = "id string, provider string, external_id string, name string, street string, house_number string, postal_code string, city string, country_code string, lat double, lon double, phone string, category string"


def record(key: str, name: str, phone: str | None, k: int):
    return (key, "map", key, name, f"Gasse{k}", "1", f"{10115 + 100 * k}", "Berlin", "DE", 40.0 + k, 10.0, phone, "cafe")


def pool(spark, folder):
    return sorted((r.id, r.phone_e164) for r in jobs.current_pool(spark, folder).collect())


def test_reads_stay_level_and_replays_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 2)
    folder, read = tempfile.mkdtemp(dir="/tmp", prefix="spark-"), []
    state = jobs.pool_state
    monkeypatch.setattr(jobs, "pool_state", lambda *a: read.append(len(found := state(*a)) and sum(len(df.inputFiles()) > 0 for df in found)) or found)
    names = ("Optik Nordlicht", "Blumen Petra", "Autohaus Zentrum", "Salon Schere")

    def load(k: int, checkpoint: str = "state", key: str | None = None, phone: str | None = None) -> None:
        spark.createDataFrame([record(key or f"r{k}", names[k % 4], phone, k % 4)], RECORD).write.mode("append").parquet(f"{folder}/in-{checkpoint}")
        stream = spark.readStream.schema(RECORD).parquet(f"{folder}/in-{checkpoint}")
        jobs.research_stream(stream, f"{folder}/out", f"{folder}/{checkpoint}").awaitTermination()

    for k in range(3):
        load(k)
    assert jobs._marked(spark, f"{folder}/out/log/snapshots") == [1] and jobs._marked(spark, f"{folder}/out/log/batches") == [0, 1, 2]
    assert pool(spark, f"{folder}/out") == [("r0", None), ("r1", None), ("r2", None)]
    shutil.rmtree(f"{folder}/out/businesses/batch=0")  # what a snapshot holds is not read again
    load(0, "other", "again", "030 1234567")  # another stream, the same business
    assert jobs._marked(spark, f"{folder}/out/log/batches") == [0, 1, 2, 3]
    assert pool(spark, f"{folder}/out") == [("r0", "+49301234567"), ("r1", None), ("r2", None)]
    spark.range(1).select(F.lit("half").alias("id")).write.parquet(f"{folder}/out/businesses/batch=9")  # no mark
    before = pool(spark, f"{folder}/out")
    shutil.rmtree(f"{folder}/other/commits")  # the last batch of this stream is run again
    stream = spark.readStream.schema(RECORD).parquet(f"{folder}/in-other")
    jobs.research_stream(stream, f"{folder}/out", f"{folder}/other").awaitTermination()
    assert pool(spark, f"{folder}/out") == before


def test_admission_over_late_and_idle_keys(spark):
    """Runs with pauses give the batch form's rows for all events that come in time; a key that was idle past its window's end has no state left."""
    from larkfield.operators import leads

    folder, minute, start = tempfile.mkdtemp(dir="/tmp", prefix="spark-"), 60_000, 1_700_000_000_000
    runs = [
        [("a", 0, 1), ("a", 1, 2), ("b", 2, 3)],
        [("a", 3, 4), ("b", 9, 5), ("c", 400, 6)],  # the watermark passes the windows of a and b
        [("a", 399, 7), ("a", 402, 8), ("a", 403, 9), ("c", 404, 10), ("b", 401, 11)],
        [("a", 300, 12)],  # too late
        [("b", 900, 13)],
    ]
    schema = "key string, ts_ms long, event_id long"
    for own in runs:
        spark.createDataFrame([(k, start + t * minute, n) for k, t, n in own], schema).write.mode("append").parquet(f"{folder}/in")
        out = jobs.admission_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), 2, 10 * minute, "5 minutes")
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()}
    in_time = spark.createDataFrame([(k, start + t * minute, n) for own in runs for k, t, n in own if n != 12], schema)
    assert got == {tuple(r) for r in leads.admissions(in_time, 2, 10 * minute).collect()}
