"""SimHash document fingerprints and Hamming search over permuted block tables.

A fingerprint has 64 bits: every distinct word's hash votes for or against
each bit with a weight of 1 + ln(times the word occurs), and the sign of the
sum is the bit. For the search the 64 bits are cut into ``radius`` + 2 blocks.
Two fingerprints within ``radius`` bits agree on at least two whole blocks, so
there is one table for each two blocks: its permutation brings the two to the
front, and rows that share the front are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SLICE_ROWS, short_batches, slices, text_or_empty
from .hamming import BITS, signed
from .near_dedup import hex_of, word_fingerprint, words_of


def block_tables(radius: int) -> list[int]:
    """The masks of the tables' fronts, as signed longs."""
    edges = [BITS * k // (radius + 2) for k in range(radius + 3)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:], strict=False)]
    return [signed(a | b) for a, b in combinations(blocks, 2)]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, col: str = "fp") -> DataFrame:
    """(query, fp, distance): every different fingerprint of ``index`` within ``radius`` of each different one of ``queries``.

    Copies share a fingerprint and are folded before the tables are joined, so
    the output holds no pair of equal texts twice. Null fingerprints are left
    out.
    """
    masks = F.array(*[F.lit(m) for m in block_tables(radius)])

    def table(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(col).alias(name)).where(F.col(name).isNotNull()).distinct()
        return rows.select(F.posexplode(masks).alias("at", "mask"), name).select("at", F.col(name).bitwiseAND(F.col("mask")).alias("front"), name)

    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return table(queries, "query").join(table(index, "fp"), ["at", "front"]).where(distance <= radius).select("query", "fp", distance.cast("int").alias("distance")).distinct()


def in_order(rows: DataFrame, parts: int, id_col: str) -> DataFrame:
    """``rows`` dealt into ``parts`` ranges of ids, each followed by a copy (``ghost``) of the row that comes after it.

    Columns ``part`` and ``ghost`` are added; a partition holds one range,
    sorted. After the last range comes the first row of all. Range limits are
    quantiles of all ids, found by binary search; the driver sees only them
    and each range's first id. Ids are whole numbers.
    """
    shares = [k / parts for k in range(1, parts)]
    limits = np.array(sorted(set(rows.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", shares, 0.1 / parts) if shares else [])))

    @F.pandas_udf("int")
    def range_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), -1, np.searchsorted(limits, x, side="right")).astype(np.int32))

    placed = rows.withColumn("part", range_of(F.col(id_col).cast("double")))
    heads = sorted(placed.groupBy("part").agg(F.min(id_col).alias("head")).collect(), key=lambda r: r.part)
    before = [heads[k - 1].part for k in range(len(heads))]
    kind = dict(rows.dtypes)[id_col]
    to = placed.sparkSession.createDataFrame([(h.head, b) for h, b in zip(heads, before, strict=True)], f"head {kind}, earlier int")
    first = F.row_number().over(Window.partitionBy("head").orderBy(*[c for c in rows.columns if c != id_col]))
    lead = rows.join(F.broadcast(to), F.col(id_col).eqNullSafe(F.col("head"))).withColumn("nth", first).where("nth = 1")
    both = placed.withColumn("ghost", F.lit(False)).unionByName(lead.select(*rows.columns, F.col("earlier").alias("part"), F.lit(True).alias("ghost")))
    return both.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).sortWithinPartitions("part", "ghost", *rows.columns)


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of ``text`` replaced by as many code points from the front of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row for each document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and fp (the fingerprint as a long).

    The next document is the next larger id; after the largest comes the
    smallest. Edge cases: null and empty texts have fingerprint zero; rows that
    share an id follow each other in the order of their texts; rows with a
    null id come before all others; a single row follows itself; other columns
    are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), parts, "id")
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        of = lambda text: int.from_bytes(word_fingerprint(words_of(text)), "big", signed=True)
        for batch in (part for whole in batches for part in slices(whole, SLICE_ROWS, SLICE_BYTES)):
            out = []
            for key, text, part, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fp = of(text)
                if held is not None and held[3] == part:
                    edited = edited_text(held[1], text)
                    out.append((held[0], len(held[1]), hashlib.sha256(edited.encode()).hexdigest(), held[2], of(edited), fp))
                held = None if ghost else (key, text, fp, part)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    found = rows.mapInArrow(run, schema)
    near = lambda other: F.lit(1.0) - F.bit_count(F.col("fp").bitwiseXOR(F.col(other))) / BITS
    return found.select(id_col, "n_chars", "edited_sha256", hex_of("fp").alias("fingerprint"), hex_of("edited_fp").alias("edited_fingerprint"), near("edited_fp").alias("near_edited"), near("next_fp").alias("near_next"), "fp")


def with_near_counts(found: DataFrame, radius: int = 3, every: int = 50, id_col: str = "doc_id") -> DataFrame:
    """``found`` with n_near: for rows whose id is divisible by ``every`` the number of other rows within ``radius``, else null."""
    is_query = F.col(id_col) % every == 0
    sizes = found.groupBy("fp").agg(F.count("*").alias("n"))
    hits = within_radius(found.where(is_query), found, radius)
    counts = hits.join(sizes, "fp").groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    return found.join(counts, (found["fp"] == counts["query"]) & is_query, "left").drop("query")
