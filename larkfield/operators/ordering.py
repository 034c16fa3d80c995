"""Order inside keys of any size: places, neighbours in time, and windows that open with the data.

All work on a key's order is cut into ranges of (key, order), so the rows of
one key may lie in many tasks. A range keeps what it can say by itself, and
one small row for each key and range carries on what the ranges before or
after have to add.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` dealt by ranges of keys and order, written, with the number ``part`` of the range they are in."""
    return cut(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with their place ``k`` (from 0) in each key."""
    dealt = in_ranges(rows, keys, order)
    sizes = dealt.groupBy(*keys, "part").agg(F.count("*").alias("m"))
    before = sizes.withColumn("k0", F.sum("m").over(Window.partitionBy(*keys).orderBy("part")) - F.col("m")).drop("m")
    own = dealt.withColumn("k1", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order)) - 1)
    return own.join(before, [*keys, "part"]).withColumn("k", F.col("k0") + F.col("k1")).drop("part", "k0", "k1")


def successors(times: DataFrame, gap: int) -> DataFrame:
    """(key, at, to): for each of the distinct (key, at) the first time of its key that is at least ``gap`` later; the last ones have none and are left out."""
    marks = times.select("key", F.col("at").alias("t"), F.lit(1).alias("kind"), "at").unionByName(times.select("key", (F.col("at") + gap).alias("t"), F.lit(0).alias("kind"), "at"))
    dealt = in_ranges(marks, ["key"], ["t", "kind"])
    seen = F.when(F.col("kind") == 1, F.col("t"))
    ahead = Window.partitionBy("key", "part").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)  # from behind: a frame up to the end would be read anew for every row
    firsts = dealt.groupBy("key", "part").agg(F.min(seen).alias("first"))
    later = firsts.select("key", "part", F.min("first").over(Window.partitionBy("key").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    return dealt.withColumn("here", F.min(seen).over(ahead)).where("kind = 0").join(later, ["key", "part"]).select("key", "at", F.coalesce("here", "later").alias("to")).where("to is not null")


def window_starts(times: DataFrame, width: int) -> DataFrame:
    """(key, at): the first time of each key, and again the first one at least ``width`` after a start.

    ``times`` has distinct (key, at). Starts are what the successor pointers
    reach from the first time; the pointers are doubled in each round, so a key
    with n windows takes log n rounds, and no round gathers a key.
    """
    jump = cut(successors(times, width))
    reached = times.groupBy("key").agg(F.min("at").alias("at"))
    while jump.limit(1).count():
        on = jump.select("key", F.col("at").alias("to"), F.col("to").alias("next"))
        reached = cut(reached.unionByName(reached.join(jump, ["key", "at"]).select("key", F.col("to").alias("at"))))
        jump = cut(jump.join(on, ["key", "to"]).select("key", "at", F.col("next").alias("to")))
    return reached


def with_last(rows: DataFrame, starts: DataFrame, ts: str) -> DataFrame:
    """``rows`` (with key) and ``start``, the last time in ``starts`` (key, at) that is not after theirs."""
    names = rows.columns
    marks = rows.withColumn("kind", F.lit(1)).unionByName(starts.select("key", F.col("at").alias(ts), F.lit(0).alias("kind")), allowMissingColumns=True)
    dealt = in_ranges(marks, ["key"], [ts, "kind"])
    seen = F.when(F.col("kind") == 0, F.col(ts))
    so_far = Window.partitionBy("key", "part").orderBy(ts, "kind").rowsBetween(Window.unboundedPreceding, 0)
    lasts = dealt.groupBy("key", "part").agg(F.max(seen).alias("last"))
    earlier = lasts.select("key", "part", F.max("last").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    return dealt.withColumn("here", F.max(seen).over(so_far)).where("kind = 1").join(earlier, ["key", "part"]).select(*names, F.coalesce("here", "earlier").alias("start"))
