"""Byte-pair encoding and decoding over a trie of distinct words.

A greedy-merge encoding has one last token for every prefix of a word, and a
sequence of tokens is the encoding exactly if each neighbouring pair is
(merging the pair's text gives the pair back). So the last token of a prefix
of length i is the one token t that ends there and whose left neighbour, the
last token of the prefix without t, is compatible with it. The distinct words
of a slice of the input are put into a trie, and a depth-first walk carries
the last tokens of the path: what words share at the front is worked out once,
and only where some word below needs it. A word's encoding is read back from
its last tokens. A vocabulary with a word-end mark has a second table, of the
tokens that end a word. Whether two tokens are compatible follows from the
order of their merges: nothing may merge across their border before one of
the two sides goes on.

The job is one pass without a shuffle; a worker's tasks share a bounded cache
of words and of compatible pairs. Edge cases: a null text counts as empty (no
ids, empty decoded text); special strings inside texts give their own ids;
repeated rows are encoded each; other columns are not read; a word too long
for the cache is walked by itself, in memory of its length.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, map_batches, text_or_empty, worker_state
from .tokens import CACHE_CHARS, SHARED_BYTES, SHARED_ROWS, SPECIAL, Bpe, WordCache, coded, gathered, letters_of, load_bpe

#: Pairs of tokens whose compatibility a worker keeps.
CACHE_PAIRS = 500_000
#: A rank after all ranks.
NEVER = 1 << 60
#: Prefixes longer than this are settled from the front and not on demand, so that demands do not nest deeply.
DEEP = 200


class WordTrie:
    """A trie of distinct words as sorted words with the depth at which each leaves the path of the one before it."""

    def __init__(self, words: set[str]):
        self.words = sorted(words)
        self.shared = [0] * len(self.words)
        for k, (a, b) in enumerate(pairwise(self.words), 1):
            n = 0
            for x, y in zip(a, b, strict=False):
                if x != y:
                    break
                n += 1
            self.shared[k] = n

    def depth_first(self) -> Iterator[tuple[str, int]]:
        """Words in the order of a depth-first walk, with the length of the path they share with the one before."""
        return zip(self.words, self.shared, strict=True)


class TrieEncoder:
    """Encodes words (in byte letters) in groups that share their prefixes."""

    def __init__(self, bpe: Bpe):
        self.bpe, end = bpe, bpe.end
        self.inner = {t: k for t, k in bpe.ids.items() if not (end and t.endswith(end))}
        self.final = {t.removesuffix(end): k for t, k in bpe.ids.items() if t.endswith(end)} if end else self.inner
        self.names = {k: t for t, k in bpe.ids.items()}
        self.size = {k: len(t.removesuffix(end) if end else t) for t, k in bpe.ids.items()}
        self.longest = max(self.size.values())
        self.base = max(self.names) + 2
        self.merges = {bpe.ids[a] * self.base + bpe.ids[b]: rank for (a, b), rank in bpe.ranks.items()}
        self.halves = {bpe.ids[a + b]: (bpe.ids[a], bpe.ids[b], rank) for (a, b), rank in bpe.ranks.items()}
        #: Ranks are times if each token comes from one merge only, and after the merges of its halves.
        born = {k: rank for k, (_, _, rank) in self.halves.items()}
        self.timed = len(self.halves) == len(bpe.ranks) and all(rank > max(born.get(a, -1), born.get(b, -1)) for a, b, rank in self.halves.values())
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        #: The word of the walk, and the last token of each of its prefixes by length; None where no word has needed it yet.
        self.word, self.last = "", [-1]

    def _stands(self, left: int, right: int) -> bool:
        """Whether the text of the two is encoded as exactly these tokens; ``left`` is -1 at the front of a word."""
        if left >= 0 and self.timed:
            found = self._stays_apart(left, right)
        else:
            end, a, b = self.bpe.end, self.names.get(left, ""), self.names[right]
            ends = bool(end) and b.endswith(end)
            core = a + (b.removesuffix(end) if ends else b)
            found = self.bpe.merge(self.bpe.symbols(core) if ends else [*core]) == ([a, b] if a else [b])
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[left * self.base + right] = found
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one side (0: first, 1: last) while ``token`` is merged, each with the rank at which it goes into the next."""
        found = self.edges.get((token, side))
        if found is None:
            found, rank = [], NEVER
            at = token
            while True:
                found.append((at, rank))
                if at not in self.halves:
                    break
                rank = self.halves[at][2]
                at = self.halves[at][side]
            found.reverse()
            self.edges[token, side] = found
        return found

    def _stays_apart(self, left: int, right: int) -> bool:
        """Follow what touches between two tokens, each of which stands alone, as both are merged: nothing may merge across before one side goes on."""
        ends, starts, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            (a, a_until), (b, b_until) = ends[i], starts[j]
            across = self.merges.get(a * self.base + b, NEVER)
            if across < a_until and across <= b_until and across < NEVER:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def _last(self, n: int, vocab: dict[str, int]) -> int:
        """The last token of the word's first ``n`` letters, out of ``vocab``."""
        word, last, base, pairs = self.word, self.last, self.base, self.pairs
        for k in range(max(0, n - self.longest), n):
            token = vocab.get(word[k:n])
            if token is not None:
                left = last[k]
                if left is None:
                    left = last[k] = self._last(k, self.inner)
                stands = pairs.get(left * base + token)
                if stands or (stands is None and self._stands(left, token)):
                    return token
        raise ValueError(f"no encoding of a word that starts with {word[:n]!r}")

    def _encode_word(self) -> list[int]:
        """The tokens of the walk's word."""
        last, n = self.last, len(self.word)
        if n > DEEP:
            for k in range(1, n):
                if last[k] is None:
                    last[k] = self._last(k, self.inner)
        tokens = [self._last(n, self.final)]
        n -= self.size[tokens[0]]
        while n:
            token = last[n]
            if token is None:
                token = last[n] = self._last(n, self.inner)
            tokens.append(token)
            n -= self.size[token]
        tokens.reverse()
        return tokens

    def encode(self, words: set[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, its token ids) of every word."""
        self.last = [-1]
        for word, shared in WordTrie({w for w in words if len(w) <= CACHE_CHARS}).depth_first():
            self.word = word
            self.last[shared + 1 :] = [None] * (len(word) - shared)
            yield word, self._encode_word()
        for word in words:
            if len(word) > CACHE_CHARS:
                self.word, self.last = word, [-1] + [None] * len(word)
                yield word, self._encode_word()


class TrieTexts:
    """Encodes and decodes whole texts; the cache of chunks and the pairs serve all tasks of a worker."""

    def __init__(self, path: str):
        self.bpe = load_bpe(path)
        self.trie = TrieEncoder(self.bpe)
        self.known = WordCache()
        self.special = {SPECIAL + s: (struct.pack("<I", k), s) for s, k in self.bpe.special.items()}

    def learn(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """chunk -> (ids as little-endian 32-bit integers, decoded) of chunks that are not in the young cache; their new words go through one trie."""
        known, old, names = self.known, self.known.old, self.trie.names
        found = {c: v for c in chunks if (v := self.special.get(c) or old.get(c)) is not None}
        words_of = {c: self.bpe.words_of(c) for c in chunks if c not in found}
        spelled = {letters_of(w): w for ws in words_of.values() for w in ws}
        word = {}
        for letters, ids in self.trie.encode(set(spelled)):
            word[spelled[letters]] = struct.pack(f"<{len(ids)}I", *ids), " ".join([names[k] for k in ids])
        for chunk, ws in words_of.items():
            found[chunk] = word[ws[0]] if len(ws) == 1 else (b"".join([word[w][0] for w in ws]), " ".join([word[w][1] for w in ws]))
        for chunk, value in found.items():
            known.keep(chunk, value)
        return found

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """(rows, ids, bounds, decoded texts) of groups of texts: row ``rows[k]`` has ``ids[bounds[k] : bounds[k + 1]]``."""
        for rows, bounds, codes, chunks in coded(self.bpe, texts):
            values = [*map(self.known.get, chunks)]
            new = [k for k, v in enumerate(values) if v is None]
            for k, v in zip(new, map(self.learn([chunks[k] for k in new]).__getitem__, [chunks[k] for k in new]), strict=True):
                values[k] = v
            decoded = pa.array([d for _, d in values], pa.string()).take(pa.array(codes))
            yield rows, *gathered([x for x, _ in values], codes, bounds), pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), decoded), " ")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_values: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row; with ``with_values`` also ids (array) and decoded (text).

    Decoding writes the tokens of the ids with a space between, as the library
    does for a file that has no decoder.
    """

    def make():
        texts = worker_state(("trie", path), lambda: TrieTexts(path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, counts, sums, decoded_sums, ids, decoded = [], [], [], [], [], []
            for own, flat, bounds, lines in texts.of(batch.column(1)):
                view = memoryview(flat).cast("B")
                rows += own.tolist()
                counts += np.diff(bounds).tolist()
                sums += [hashlib.sha256(view[4 * x : 4 * y]).hexdigest() for x, y in pairwise(bounds.tolist())]
                decoded_sums += [hashlib.sha256(line.as_buffer()).hexdigest() for line in lines]
                if with_values:
                    ids += [flat[x:y].tolist() for x, y in pairwise(bounds.tolist())]
                    decoded += lines.to_pylist()
            return batch_of(batch.column(0).take(pa.array(rows)), counts, sums, decoded_sums, *([pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_values else []))

        return step

    values = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if with_values else []
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *values])
    return map_batches(docs.select(docs[id_col], text_or_empty(text_col)), make, schema, SHARED_ROWS, SHARED_BYTES)
