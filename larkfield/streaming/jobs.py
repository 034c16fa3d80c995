"""Incremental jobs: repeated research loads, and admission with state."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.identity import build_identity, load_discovered, refreshed_pool
from ..storage import cut


#: Batches between two snapshots of the pool.
COMPACT = 8
TABLES = ("businesses", "sources")


def research_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Load a stream of discovery records into the pool under ``path``, one micro-batch after the other.

    A batch writes the new businesses, those that its records changed, and the
    source keys to folders named by its number, then its mark in ``log``; what
    a broken batch has left has no mark and is not read, and a batch that is
    run again reads what was there before it and replaces what it wrote. After
    every ``COMPACT`` batches the state is written as a whole under
    ``snapshots``, marked last, so a batch reads one snapshot and at most that
    many batches, however long the history is. A stream with another
    ``checkpoint`` goes on after the numbers that are there. Of records with
    one source key in a batch that with the smallest id counts.
    """
    first = _first_number(records.sparkSession, path, checkpoint)

    def load(batch: DataFrame, number: int) -> None:
        spark, number = batch.sparkSession, first + number
        one = batch.groupBy("provider", "external_id").agg(F.min_by(F.struct(*batch.columns), F.struct("id", F.to_json(F.struct(*batch.columns)))).alias("row")).select("row.*")
        rows = build_identity(one)
        keys = rows.select("provider", "external_id", F.col("id").alias("business_id"))
        pool, sources = pool_state(spark, path, (rows.schema, keys.schema), number)
        out = cut(load_discovered(rows, pool, sources).where("outcome <> 'rejected'"))
        new = out.where("business_id = incoming_id and outcome in ('new', 'needs_review')")
        added = rows.join(new.select(F.col("incoming_id").alias("id"), "outcome"), "id").withColumn("identity_status", F.when(F.col("outcome") == "needs_review", "NEEDS_REVIEW").otherwise(F.col("identity_status"))).select(*rows.columns)
        changed = refreshed_pool(pool.unionByName(added), rows, out)
        added.join(changed.select("id"), "id", "left_anti").unionByName(changed).write.mode("overwrite").parquet(f"{path}/businesses/batch={number}")
        rows.join(out.where("outcome <> 'refreshed'").select(F.col("incoming_id").alias("id"), "business_id"), "id").select("provider", "external_id", "business_id").write.mode("overwrite").parquet(f"{path}/sources/batch={number}")
        _mark(spark, f"{path}/log/batches", number)
        if (number + 1) % COMPACT == 0:
            for name, df in zip(TABLES, pool_state(spark, path, (rows.schema, keys.schema), number + 1), strict=True):
                df.write.mode("overwrite").parquet(f"{path}/snapshots/{name}/batch={number}")
            _mark(spark, f"{path}/log/snapshots", number)

    return records.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _mark(spark: SparkSession, folder: str, number: int) -> None:
    """One row that says that a batch or snapshot is whole."""
    spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/number={number}")


def _marked(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that are marked as whole, in order; none where nothing has been written."""
    try:
        rows = spark.read.schema("done boolean, number long").option("basePath", folder).parquet(folder)
    except AnalysisException:
        return []
    return sorted(r.number for r in rows.select("number").collect())


def _first_number(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The number of a stream's batch 0: that of its first start, which is the first free one then."""
    folder = f"{path}/log/streams/{sha256(checkpoint.encode()).hexdigest()[:16]}"
    found = _marked(spark, folder)
    if not found:
        found = [max(_marked(spark, f"{path}/log/batches"), default=-1) + 1]
        _mark(spark, folder, found[0])
    return found[0]


def pool_state(spark: SparkSession, path: str, schemas: tuple[T.StructType, T.StructType], before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(businesses, sources) as the whole batches with a number under ``before`` have left them: the last snapshot and the batches after it."""
    upto = lambda numbers: [n for n in numbers if before is None or n < before]
    last = max(upto(_marked(spark, f"{path}/log/snapshots")), default=-1)
    batches = [n for n in upto(_marked(spark, f"{path}/log/batches")) if n > last]
    out = []
    for name, schema in zip(TABLES, schemas, strict=True):
        kind = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        df = spark.createDataFrame([], kind)
        for base, numbers in ((f"{path}/snapshots/{name}", [last] if last >= 0 else []), (f"{path}/{name}", batches)):
            if numbers:
                df = df.unionByName(spark.read.schema(kind).option("basePath", base).parquet(*[f"{base}/batch={n}" for n in numbers]))
        out.append(df)
    keys = ("provider", "external_id")
    return latest_rows(out[0]), out[1].groupBy(*keys).agg(F.min_by("business_id", "batch").alias("business_id"))


def latest_rows(rows: DataFrame) -> DataFrame:
    """The row of the latest batch of each id."""
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), "batch").alias("row")).select("row.*")


def current_pool(spark: SparkSession, path: str) -> DataFrame:
    """The pool under ``path`` as all whole loads have left it."""
    numbers = _marked(spark, f"{path}/log/batches")
    named = spark.read.option("basePath", f"{path}/businesses").parquet(f"{path}/businesses/batch={numbers[-1]}").drop("batch")
    return pool_state(spark, path, (named.schema, T._parse_datatype_string("provider string, external_id string, business_id string")))[0]


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """The window of one key: typed state with its end and count, and a timer at its end in event time."""

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.window = handle, handle.getValueState("window", "reset long, n int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        reset, n = self.window.get() if self.window.exists() else (None, 0)
        before, out = reset, []
        for r in pd.concat(list(rows)).sort_values(["ts_ms", "event_id"]).itertuples():
            if reset is None or r.ts_ms >= reset:
                reset, n = r.ts_ms + self.window_ms, 0
            n += 1
            out.append((key[0], r.ts_ms, r.event_id, n <= self.limit, max(0, self.limit - n), 0 if n <= self.limit else reset - r.ts_ms))
        self.window.update((int(reset), int(n)))
        if reset != before:
            if before is not None:
                self.handle.deleteTimer(int(before))
            self.handle.registerTimer(int(reset))
        yield pd.DataFrame(out, columns=["key", "ts_ms", "event_id", "allowed", "remaining", "retry_after_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, limit: int, window_ms: int, delay: str = "1 hour") -> DataFrame:
    """Stream form of ``admissions``: each key's state is its window's end and count, until event time passes the end.

    ``events``: key, ts_ms, event_id. Windows and their states live in event
    time, so pauses between micro-batches and replays change nothing; events
    more than ``delay`` behind the latest one are dropped. Events of a
    micro-batch are taken in time order. State with timers needs the RocksDB
    store, which is set for the session where nothing else has been.
    """
    spark = events.sparkSession
    if "RocksDB" not in (spark.conf.get(STATE_STORE, None) or ""):
        spark.conf.set(STATE_STORE, ROCKSDB)
    schema = "key string, ts_ms long, event_id long, allowed boolean, remaining int, retry_after_ms long"
    timed = events.select("key", "ts_ms", "event_id", F.timestamp_millis("ts_ms").alias("at")).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(Admission(limit, window_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
