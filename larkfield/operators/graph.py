"""Components of a table of links, in rounds that follow the logarithm of their diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node: the smallest node that it reaches.

    A round hangs every node's larger neighbours on the smallest node it sees,
    then all of its smaller ones on the smallest of them, until all links are
    those of stars. Links with a null end are left out.
    """
    stars = cut(links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("high") != F.col("low"))).distinct())
    mark = _mark(stars)
    while True:
        ways = stars.unionByName(stars.select(F.col("low").alias("high"), F.col("high").alias("low")))
        seen = ways.groupBy("high").agg(F.min("low").alias("least")).select("high", F.least("high", "least").alias("least"))
        large = ways.where("low > high").join(seen, "high").select(F.col("low").alias("high"), F.col("least").alias("low")).distinct()
        seen = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(seen, "high").select(F.col("low").alias("high"), F.col("least").alias("low")).where("high <> low")
        stars = cut(small.unionByName(seen.select("high", F.col("least").alias("low"))).distinct())
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    tops = stars.select(F.col("low").alias("node")).distinct()
    return stars.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))


def _mark(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
