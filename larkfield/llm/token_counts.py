"""Token counts of whole texts by the whole-token shortcut.

Before a job starts, the driver proves which strings of the vocabulary are one
token when they stand alone as a pre-token: the merges, applied to the
string's bytes, must end in that one token. The proven strings (at most one
for each id, so bounded by the vocabulary) go to the workers as a broadcast.
A worker cuts a text at its white space, counts the strings in the set as one
each, cuts the rest into pre-tokens, and merges only those that are not in the
set either; their counts are cached.

The job is one pass without a shuffle. Edge cases: a null text counts as an
empty one (0 bytes, 0 tokens); repeated rows are counted each; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, map_batches, text_or_empty, worker_state
from .tokens import SHARED_BYTES, SHARED_ROWS, SPECIAL, WordCache, coded, letter_bytes, letters_of, load_bpe


def whole_tokens(path: str) -> frozenset[str]:
    """The strings that are one pre-token and encode alone as exactly one token.

    Vocabulary entries that are not valid UTF-8 by themselves are left out:
    they never are a whole pre-token.
    """
    bpe, back = load_bpe(path), letter_bytes()
    proven = set()
    for spelled in bpe.ids:
        core = spelled.removesuffix(bpe.end) if bpe.end else spelled
        if not core or any(c not in back for c in core) or len(bpe.merge(bpe.symbols(core))) != 1:
            continue
        try:
            word = bytes([back[c] for c in core]).decode()
        except UnicodeDecodeError:
            continue
        if [w for chunk in bpe.chunks(word) for w in bpe.words_of(chunk)] == [word]:
            proven.add(word)
    return frozenset(proven)


class Counts:
    """Tokens of whole texts; the cache serves all tasks of a worker."""

    def __init__(self, path: str, proven: frozenset[str]):
        self.bpe = bpe = load_bpe(path)
        tokenize, special = bpe.library.model.tokenize, {SPECIAL + s for s in bpe.special}
        self.is_whole = proven.__contains__

        def merged(chunk: str) -> int:
            if chunk in special or chunk in proven:
                return 1
            words = bpe.words_of(chunk)
            return sum(map(self.known.__getitem__, words)) if len(words) > 1 else sum(len(tokenize(letters_of(w))) for w in words)

        self.known = WordCache(merged)

    def of(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for rows, bounds, codes, chunks in coded(self.bpe, texts):
            counts = np.ones(len(chunks), np.int64)
            rest = [k for k, c in enumerate(chunks) if not self.is_whole(c)]
            counts[rest] = [self.known[chunks[k]] for k in rest]
            ends = np.concatenate([[0], np.cumsum(counts[codes])])
            out[rows] = np.diff(ends[bounds])
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def make():
        count = worker_state(("counts", path), lambda: Counts(path, proven.value)).of

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1)
            return batch_of(batch.column(0), pc.binary_length(texts), count(texts))

        return step

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = map_batches(docs.select(docs[id_col], text_or_empty(text_col)), make, schema, SHARED_ROWS, SHARED_BYTES)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
