"""Connected components of a link table, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, few


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link, except the smallest of each component, which is the component's name.

    Alternates the large-star and small-star steps: each node hangs its
    neighbours on the smallest one it sees, until every component is a star
    around its smallest node. The number of rounds follows the logarithm of a
    component's diameter, the number of links never grows, and each round is
    written to the checkpoint folder. Stars of any size are only aggregated
    and joined on, never gathered into one row.
    """
    edges = checkpoint(few(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()))
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()  # one shuffle for the rows, their least and both joined
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = checkpoint(few(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and is no other edge's v, so that each component is a star already."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").count() == 0
