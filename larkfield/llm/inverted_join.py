"""Near duplicates by an inverted index over the coordinates of MinHash signatures.

Every distinct set of shingles is a node with a signature of ``COORDINATES``
values. Two sets of Jaccard similarity J agree in each coordinate with
probability J, so sets at 0.85 and more agree in at least ``MATCHES`` of 64
but for 2e-9.

A node is posted under its first ``POSTED`` (coordinate, value) pairs. Two
nodes that agree in ``MATCHES`` coordinates agree in all but ``COORDINATES -
MATCHES`` of these, and so share one of any ``COORDINATES - MATCHES + 1`` of
them, whatever their order, as long as it is one order for all: the pairs that
fewest nodes have come first. Pairs that one node alone has are counted, not
posted: most texts have enough of these to be left out as a whole. The lists
that come last, which are the long ones, and the coordinates that are not
posted are skipped: two nodes that a posted list brings together look up their
agreement there in their signatures. What agrees often enough is compared by
the full sets.

Nodes that long lists share are joined to classes in rounds, one node of a
list against its others, before pairs are met (``near_dedup.linked``), and
lists that then still bring together more pairs than a few for each posting
are compared by the shingles themselves, rarest first, which loses no link. So
no list gives the square of its nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, map_batches, stored, text_or_empty
from .near_dedup import linked, shingle_hashes, words_of

COORDINATES, MATCHES, POSTED = 64, 35, 40
#: Odd factors; each puts the hashes in another order.
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the hashes in each of the orders, cut to 32 bits. No hashes: no coordinates."""
    if not len(hashes):
        return np.zeros(0, np.int32)
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[k : k + 1024, None] * FACTORS).min(axis=0), out=least)
    least ^= least >> np.uint64(32)
    return ((least * FACTORS[0]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, values) of every row: the number of distinct shingles, a digest of their set, the signature."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_hashes(words_of(t), size) for t in batch.column(1).to_pylist()]
            digests = [hashlib.md5(h.tobytes()).digest() for h in sets]
            return batch_of(batch.column(0), [*map(len, sets)], digests, pa.array([signature(h) for h in sets], pa.list_(pa.int32())))

        return step

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("values", T.ArrayType(T.IntegerType()))])
    return map_batches(docs.select(docs[id_col], text_or_empty(text_col)), make, schema)


def postings(nodes: DataFrame) -> DataFrame:
    """(key, node, n): the rarest coordinate-value pairs of each node of ``nodes`` (node, n, values) of which it must share one with any node that it links to; pairs that no other node has are left out."""
    each = nodes.select("node", F.posexplode(F.slice("values", 1, POSTED)).alias("at", "value")).select("node", F.xxhash64("at", "value").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("lists")).where("lists > 1")
    of_node = Window.partitionBy("node")
    ranked = each.join(shared, "key").withColumns({"known": F.count("*").over(of_node), "at": F.row_number().over(of_node.orderBy("lists", "key"))})
    shared = MATCHES - (COORDINATES - POSTED)  # posted pairs that a link has in common
    return ranked.where(F.col("at") <= F.col("known") - shared + 1).select("key", "node").join(nodes.select("node", "n"), "node").select("key", "node", "n")


def retaining(values: DataFrame):
    """The function from collisions (a, b), a row for each list they share, to the pairs whose signatures in ``values`` (node, values) agree ``MATCHES`` times or more."""

    def retained(collisions: DataFrame) -> DataFrame:
        counted = collisions.groupBy("a", "b").agg(F.count("*").alias("met"))
        x, y = (values.select(F.col("node").alias(c), F.col("values").alias(f"{c}_values")) for c in "ab")
        agreed = F.aggregate(F.zip_with("a_values", "b_values", lambda v, w: (v == w).cast("int")), F.lit(0), lambda s, v: s + v)
        return counted.join(x, "a").join(y, "b").where((F.col("met") >= MATCHES) | (agreed >= MATCHES)).select("a", "b")

    return retained


def minhash_classes(docs: DataFrame, size: int = 3, similarity: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    A text's set is that of its distinct ``size``-word shingles (A-Z in lower
    case; fewer words: all of them as one). Texts are linked if their sets'
    Jaccard similarity is at least ``similarity``; component_id is the smallest
    id that a row reaches, kept says that it is the row's own. ``MATCHES`` is
    made for a similarity of 0.85 and more; lower ones are refused.

    Edge cases: texts without words, null and empty ones, have no shingles and
    are linked with nothing; texts with equal sets are one node, so copies cost
    nothing more; repeated rows come back each; a row with a null id takes part
    only through other rows with its set and is never kept; ids must be whole
    numbers, and rows that share an id the same document; other columns are not
    looked at; an empty table gives no rows.
    """
    if similarity < 0.85:
        raise ValueError("signatures are made for a similarity of 0.85 and more")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError("ids must be whole numbers")
    marked = stored(signatures(docs, size, id_col, text_col))
    found = marked.where("n > 0").groupBy("digest").agg(F.min("id").cast("long").alias("node"), F.first("n").alias("n"), F.first("values").alias("values"))
    nodes = stored(found.where("node is not null"))
    members = stored(postings(nodes))
    wanted = members.select("node").distinct()
    texts = docs.select(docs[id_col].cast("long").alias("node"), text_or_empty(text_col).alias("text")).join(wanted, "node").groupBy("node").agg(F.min("text").alias("text"))
    groups = linked(members, stored(texts), size, similarity, retaining(stored(nodes.join(wanted, "node").select("node", "values"))))
    classes = nodes.join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    kind = docs.schema[id_col].dataType
    known = F.coalesce(F.col("class").cast(kind), F.col("id")).alias("component_id")
    rows = marked.select("id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left").select(F.col("id").alias(id_col), "n_shingles", known)
    return rows.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
