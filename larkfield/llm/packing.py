"""Packing by power-of-two decomposition.

A document's tokens (with an end token) are cut into pieces whose lengths are
powers of two: as many of ``max_len`` as fit, then one for each bit of what is
left, longest first. Every piece is one training sequence, so sequences need
no padding and never cross documents; pieces of one length form one bucket,
from which batches are drawn.

The pass over the documents needs no shuffle. Sequence ids are the partition
and the place in it: the same when a task is run again, others when the input
is cut into other partitions. A long
document gives many rows, never one wide row. ``write_buckets`` lays the
pieces out by bucket with the writer's partitioning, so that no single task
gathers a bucket.

Edge cases: a null text counts as empty and gives the end token alone; repeated
rows are packed each; other columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, map_batches, text_or_empty, worker_state
from .tokens import SHARED_BYTES, SHARED_ROWS, PackedIds


def binary_pieces(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; ``max_len`` is a power of two."""
    whole = n // max_len
    pieces = [(k * max_len, max_len) for k in range(whole)]
    start, size = whole * max_len, max_len
    while start < n:
        size //= 2
        if (n - start) & size:
            pieces.append((start, size))
            start += size
    return pieces


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece: id, start, length, ids (array, if ``with_ids``), ids_crc32, doc_tokens, bucket (log2 of length), sequence_id, offset."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    def make():
        ids_of = worker_state(("packed", path), lambda: PackedIds(path)).of

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(rows, np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))) for rows, ids, bounds in ids_of(batch.column(1))]
            rows = np.concatenate([rows for rows, _, _ in found])
            totals = np.concatenate([np.diff(bounds) for _, _, bounds in found])
            pieces = [binary_pieces(n, max_len) for n in totals.tolist()]
            starts, sizes = np.array([p for own in pieces for p in own], np.int64).reshape(-1, 2).T
            views = [memoryview(ids).cast("B")[4 * x : 4 * y] for _, ids, bounds in found for x, y in pairwise(bounds.tolist())]
            sums = [zlib.crc32(view[4 * start : 4 * (start + size)]) for view, own in zip(views, pieces, strict=True) for start, size in own]
            of = np.repeat(np.arange(len(rows)), [*map(len, pieces)])
            out = [batch.column(0).take(pa.array(rows[of])), starts, sizes, sums, totals[of]]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([ids for _, ids, _ in found]).astype(np.int32))))
            return batch_of(*out)

        return step

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    pieces = map_batches(docs.select(docs[id_col], text_or_empty(text_col)), make, schema, SHARED_ROWS, SHARED_BYTES)
    return pieces.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences as one Parquet folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
