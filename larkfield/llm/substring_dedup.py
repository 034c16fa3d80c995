"""Removal of passages that repeat across documents, by relative Lempel-Ziv parsing.

Every document is factored against all reference blocks: word runs of any
document with a smaller id. A factor (id, start, length, source, source_start)
is a run of words that the source holds at source_start; factors of at least
``window`` words are duplicate spans.

The index must not hold a row for every word, so reference blocks are anchored
in content. Of all ``gram``-word runs inside a window the one with the
smallest hash is the window's anchor; equal windows have equal anchors, and
neighbouring windows mostly share one. The block of an anchor is the span of
all windows it anchors. The parse has four steps, joins and aggregations on
hashes:

1. Anchors that only one document has are dropped. They hold no repeat.
2. A block whose whole span (a second hash) is also in a document with a
   smaller id is taken into a factor whole.
3. Where blocks of one anchor differ, the first document of each span is
   extended window by window: these are the places where factors end, and
   every window that straddles a border is looked up by itself. Other
   documents with that span need no look, as step 2 has settled them.
4. Each document is then walked once from the front: a factor goes on greedily
   as long as its own source goes on; where the source changes, the next
   factor starts, and the two overlap in the words of the windows between.

So every window is judged on the input, by itself, also across the borders of
factors. Extending a factor against the texts of all its reference blocks
would compare every document of a hot anchor with every other; looking up
hashes extends against all of them at once. The texts are dealt by id once;
the windows and the result both read this one shuffle. Copies and common
passages are folded by partial aggregation before a shuffle; no group of rows
is gathered.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, columns, map_batches, stored, text_or_empty

#: Odd multipliers of the rolling hashes (one for anchors, two for spans) and their finish.
MULTIPLIERS, FINISH = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), 0xD6E8FEB86659FD93
#: A word with the ASCII white space before it.
SPACED_WORD = re.compile(rb"([\x20\x09-\x0d]*)([^\x20\x09-\x0d]*)")


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8", "surrogatepass").split()


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, bounds of each text in them); a word is hashed once for all texts."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    codes, distinct, bounds = words.indices.to_numpy(), words.dictionary.to_pylist(), lists.offsets.to_numpy()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(w.encode()) for w in distinct]), "<u8")[codes]
    bounds = bounds - bounds[0]
    if "" in distinct:  # white space at an end of a text
        real = codes != distinct.index("")
        hashes, bounds = hashes[real], np.concatenate([[0], np.cumsum(real)])[bounds]
    return hashes, bounds


def run_hashes(hashes: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` words, put together from runs of powers of two."""
    size, factor, part = 1, multiplier, hashes
    out, done = None, 0
    left = n
    while left:
        if left & 1:
            out, done = (part, size) if out is None else (part[: len(part) - done] * np.uint64(pow(multiplier, done, 1 << 64)) + out[size:], done + size)
        left >>= 1
        if left:
            part = part[: len(part) - size] * np.uint64(factor) + part[size:]
            size, factor = 2 * size, factor * factor % (1 << 64)
    out = out[: max(len(hashes) - n + 1, 0)]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(FINISH)
    return out ^ (out >> np.uint64(32))


def anchored_blocks(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of each block; windows are numbered by their first word. The first of equal hashes anchors."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = run_hashes(hashes, gram, MULTIPLIERS[0])
    width = window - gram + 1
    place = np.empty(len(hashes) - window + 1, np.int64)
    for k in range(0, len(place), 1 << 14):  # long documents in slices
        view = np.lib.stride_tricks.sliding_window_view(h[k : k + (1 << 14) + width - 1], width)
        place[k : k + len(view)] = view.argmin(axis=1) + np.arange(k, k + len(view))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    return h[place[first]], first, last


def blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, span, id, first, last) of every block of ``docs`` (id, text)."""

    def make():
        digest = xxhash.xxh3_64_intdigest

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, bounds = hashed_words(batch.column(1))
            rows, cols = [], ([], [], [], [])
            for k, (x, y) in enumerate(pairwise(bounds.tolist())):
                if y - x < window:
                    continue
                own = hashes[x:y]
                anchor, first, last = anchored_blocks(own, window, gram)
                view = memoryview(own).cast("B")
                spans = np.array([digest(view[8 * a : 8 * b]) for a, b in zip(first.tolist(), (last + window).tolist(), strict=True)], np.uint64)
                rows.append(np.full(len(anchor), k))
                for col, values in zip(cols, (anchor.view(np.int64), spans.view(np.int64), first, last), strict=True):
                    col.append(values)
            if not rows:
                return None
            anchor, span, first, last = map(np.concatenate, cols)
            return batch_of(anchor, span, batch.column(0).take(pa.array(np.concatenate(rows))), first, last)

        return step

    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("span", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    return map_batches(docs.select("id", "text"), make, schema)


def windows_of(rows: DataFrame, window: int) -> DataFrame:
    """(hash, check, id, start) of the windows that ``rows`` (id, text, parts: array of first and last) name."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, bounds = hashed_words(batch.column(1))
            if len(hashes) < window:
                return None
            one, two = (run_hashes(hashes, window, m).view(np.int64) for m in MULTIPLIERS[1:])
            parts = batch.column(2)
            rows = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
            first, last = (parts.flatten().field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
            n = last - first + 1
            starts = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows = np.repeat(rows, n)
            at = bounds[rows] + starts
            return batch_of(one[at], two[at], batch.column(0).take(pa.array(rows)), starts)

        return step

    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("check", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("start", T.IntegerType())])
    return map_batches(rows.where("parts is not null").select("id", "text", "parts"), make, schema)


def shared_blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, first, last, whole, source, source_start) of blocks of ``docs`` (id, text) that matter: ``whole`` ones repeat the span of ``source``, a row with a smaller id, the others have to be extended by window.

    The tables of anchors and spans are written before they are joined, so
    that a join reads both sides from a shuffle and Spark can split an anchor
    that very many rows share.
    """
    found = blocks(docs, window, gram)
    shared = stored(found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"))
    found = stored(found.join(shared, "anchor", "left_semi"))
    firsts = stored(found.groupBy("anchor", "span").agg(F.min(F.struct("id", "first")).alias("low")))
    varied = stored(firsts.groupBy("anchor").agg((F.min("span") != F.max("span")).alias("varied")))
    heads = stored(firsts.join(varied, "anchor"))
    whole = F.col("low.id") < F.col("id")
    return stored(found.join(heads, ["anchor", "span"]).where(F.col("varied") | whole).select("id", "first", "last", whole.alias("whole"), F.col("low.id").alias("source"), F.col("low.first").alias("source_start")))


def repeated_windows(dealt: DataFrame, marked: DataFrame, window: int) -> DataFrame:
    """(id, parts: array of first, last, source, source_start): runs of window starts that also stand in a row with a smaller id; ``dealt`` (id, text) are the documents, dealt by id."""
    wanted = marked.where("not whole").groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("parts"))
    seen = windows_of(dealt.join(wanted, "id"), window)
    lowest = seen.groupBy("hash", "check").agg(F.min(F.struct("id", "start")).alias("low"), F.max("id").alias("high")).where("low.id < high").drop("high")
    single = seen.join(lowest, ["hash", "check"]).where("low.id < id").select("id", F.col("start").alias("first"), F.col("start").alias("last"), F.col("low.id").alias("source"), F.col("low.start").alias("source_start"))
    parts = marked.where("whole").select(*single.columns).unionByName(single)
    return parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "source", "source_start"))).alias("parts"))


def factored(first: np.ndarray, last: np.ndarray, source: pa.Array, source_start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the part that a factor starts with, start, end) of the greedy factors of one document, from its parts in the order of their first windows."""
    ids = source.dictionary_encode().indices.to_numpy()
    goes_on = (ids[1:] == ids[:-1]) & (source_start[1:] - source_start[:-1] == first[1:] - first[:-1]) & (first[1:] <= last[:-1] + 1)
    head = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return head, first[head], np.maximum.reduceat(last, head) + window


def factors(docs: DataFrame, window: int = 50, gram: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, source, source_start) of every factor of at least ``window`` words; see ``drop_repeats`` for the edge cases."""
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")).where("id is not null")
    parts = repeated_windows(rows, shared_blocks(rows, window, gram), window)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = ([], [], [], [], [])
            lists = batch.column(1)
            for k in range(len(lists)):
                own = lists[k].values
                first, last, source_start = (own.field(c).to_numpy() for c in ("first", "last", "source_start"))
                head, start, end = factored(first, last, own.field("source"), source_start, window)
                for col, x in zip(out, (np.full(len(head), k), start, end - start, own.field("source").take(pa.array(head)), source_start[head]), strict=True):
                    col.append(x)
            return batch_of(batch.column(0).take(pa.array(np.concatenate(out[0]))), np.concatenate(out[1]), np.concatenate(out[2]), pa.concat_arrays(out[3]), np.concatenate(out[4]))

        return step

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("source", kind), T.StructField("source_start", T.IntegerType())])
    return map_batches(parts.select("id", "parts"), make, schema)


def covered(n: int, parts: pa.Scalar | None, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a factor of the parts of a document."""
    edges = np.zeros(n + 1, np.int64)
    if parts is not None and parts.is_valid:
        own = parts.values
        first, last, source_start = (own.field(c).to_numpy() for c in ("first", "last", "source_start"))
        _, start, end = factored(first, last, own.field("source"), source_start, window)
        np.add.at(edges, start, 1)
        np.add.at(edges, end, -1)
    return np.cumsum(edges)[:n] > 0


def without(text: str, gone: np.ndarray) -> str:
    """``text`` without the words marked in ``gone`` and the white space before each; the rest keeps its spacing."""
    raw = text.encode("utf-8", "surrogatepass")
    parts = [m for m in SPACED_WORD.findall(raw) if m[1]]
    return b"".join([gap + word for (gap, word), out in zip(parts, gone, strict=True) if not out]).lstrip().decode("utf-8", "surrogatepass")


def drop_repeats(docs: DataFrame, window: int = 50, gram: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with columns n_words, n_removed, kept (the text without the removed words) and kept_sha256 (of the kept words joined by one space).

    A word goes if a window of ``window`` consecutive words that covers it also
    starts, word for word, in a row with a smaller id. Edge cases: a null text
    has no words; texts under a window keep all; rows that share an id must
    hold one text (they never count as smaller than each other); a row with a
    null id keeps all its words and is no reference; columns with the names of
    the new ones are replaced.
    """
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")).where("id is not null")
    marked = shared_blocks(rows, window, gram)
    new = ("n_words", "n_removed", "kept", "kept_sha256")
    carried = [c for c in docs.columns if c not in new]
    dealt = docs.select(docs[id_col].alias("id"), F.struct(*columns(carried)).alias("row")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).alias("text")
    parts = repeated_windows(dealt.select("id", text), marked, window)
    joined = dealt.join(parts, "id", "left").select("row", text, "parts")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, removed, kept, sums = [], [], [], []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = split_words(text)
                gone = covered(len(words), parts, window)
                counts.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(without(text, gone) if removed[-1] else text)
                sums.append(hashlib.sha256(b" ".join([w for w, out in zip(words, gone.tolist(), strict=True) if not out] if removed[-1] else words)).hexdigest())
            return batch_of(batch.column(0), counts, removed, kept, sums)

        return step

    schema = T.StructType([joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    return map_batches(joined, make, schema).select(*[F.col("row")[c].alias(c) for c in carried], *new)
