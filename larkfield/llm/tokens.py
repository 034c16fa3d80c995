"""Byte-pair vocabularies of public tokenizer files: pre-tokens, merges, ids.

The files are read where they are installed, once in each Python worker. Word
caches are bounded, so a worker's memory does not follow the input.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers

#: Words kept in one generation of a worker's cache, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS = 200_000, 48

#: Latin letters and number signs: their classes are the same in every Unicode version since 5.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼-¾"
#: Texts of these characters are split by `re`; any other text by the tokenizers library's own pre-tokenizer.
#: U+0130, U+023A and U+023E are left to it too: their lower case is not one Latin letter.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ȹȻ-Ƚȿ-ɏ‘’“”–—…€]*")
#: What `re` splits as the library does once letters are in lower case.
PLAIN_WORD = re.compile("[\t\n\r\x20-\x7e¡-ʯ‘’“”–—…€]*")
#: Rows and bytes of text whose words are looked at together.
SHARED_ROWS, SHARED_BYTES = 10_000, 16 << 20
#: What stands before a special string among chunks; no other chunk has it before letters.
SPECIAL = "\0"
#: White space that is more than one space or one line end between two words.
UNEVEN = ("  ", " \n", "\n ", "\n\n", "\t", "\r")

# The normalizers and pre-tokenizers of the files that this module reads.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
BYTE_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary files: printable bytes are themselves, the others follow from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


BYTE_LETTERS = byte_letters()
LETTER_OF = dict(enumerate(BYTE_LETTERS))


def letters_of(word: str) -> str:
    return word.encode("utf-8", "surrogateescape").decode("latin-1").translate(LETTER_OF)


class Bpe:
    """The merges of a tokenizer file, applied to one pre-token at a time.

    A file with another normalizer, pre-tokenizer or kind of added token than
    those known here is refused, as its texts would be split otherwise.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "unk_token", "continuing_subword_prefix", "fuse_unk")):
            raise ValueError(f"{path} is not a plain byte-pair encoding")
        kind = spec.get("normalizer"), spec.get("pre_tokenizer")
        if kind not in ((WORD_NORMALIZER, WORD_SPLIT), (None, BYTE_SPLIT)):
            raise ValueError(f"{path} splits texts in a way that is not known here")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take more than their own string")
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.lower = kind[0] is not None
        #: The library's own parts, for texts that are not PLAIN.
        self.library = tokenizers.Tokenizer.from_file(path)
        if self.lower:
            self.words = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+").findall
        else:
            self.words = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+").findall
        self.runs = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall

    def symbols(self, word: str) -> list[str]:
        """A pre-token (spelled in byte letters) as the symbols that merging starts from."""
        return [*word[:-1], word[-1] + self.end]

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges: lowest rank first, leftmost among equals."""
        if len(symbols) > 40:
            return self._merge_long(symbols)
        ranks = self.ranks
        while len(symbols) > 1:
            best = min([(ranks.get(pair, 1 << 60), k) for k, pair in enumerate(pairwise(symbols))])
            if best[0] == 1 << 60:
                break
            k = best[1]
            symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs and a linked list, for words of any length."""
        ranks, n = self.ranks, len(symbols)
        parts: list[str | None] = [*symbols]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(rank, k, pair) for k, pair in enumerate(pairwise(symbols)) if (rank := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, (a, b) = heapq.heappop(heap)
            nxt = after[k]
            if parts[k] != a or nxt >= n or parts[nxt] != b:
                continue
            parts[k], parts[nxt] = a + b, None
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if (rank := ranks.get(pair := (a + b, parts[after[k]]))) is not None:
                    heapq.heappush(heap, (rank, k, pair))
            if (prev := before[k]) >= 0 and (rank := ranks.get(pair := (parts[prev], a + b))) is not None:
                heapq.heappush(heap, (rank, prev, pair))
        return [p for p in parts if p is not None]

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(whether it is a special string, string) of the text's parts that are not empty."""
        if not any(map(text.__contains__, self.special)):
            if text:
                yield False, text
            return
        for k, part in enumerate(self.special_split(text)):
            if part:
                yield bool(k % 2), part

    def chunks(self, part: str) -> list[str]:
        """``part`` (without special strings) in runs that are encoded each by itself: non-space runs with the space before them, or pre-tokens."""
        if PLAIN.fullmatch(part):
            return part.lower().split() if self.lower else self.runs(part)
        return self._library_words(part)

    def words_of(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        if chunk.isalpha() or (chunk.startswith(" ") and chunk[1:].isalpha()):
            return [chunk]
        return self.words(chunk) if PLAIN_WORD.fullmatch(chunk) else [chunk]

    def _library_words(self, part: str) -> list[str]:
        if self.library.normalizer is not None:
            part = self.library.normalizer.normalize_str(part)
        back = letter_bytes()
        return [bytes([back[c] for c in w]).decode("utf-8", "surrogateescape") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]


class Coded(NamedTuple):
    """Texts as numbers of chunks: text ``rows[k]`` of the slice has ``codes[bounds[k] : bounds[k + 1]]``, and ``chunks`` holds each chunk once."""

    rows: np.ndarray
    bounds: np.ndarray
    codes: np.ndarray
    chunks: list[str]


def coded(bpe: Bpe, texts: pa.Array) -> list[Coded]:
    """The chunks of all texts; special strings are chunks after SPECIAL. Texts with even white space are split in Arrow, the others one by one."""
    strings = texts.to_pylist()
    plain = [PLAIN.fullmatch(t) is not None and not any(map(t.__contains__, bpe.special)) and (bpe.lower or even(t)) for t in strings]
    rows, odd = np.flatnonzero(plain), [k for k, p in enumerate(plain) if not p]
    out = []
    if len(rows):
        own = texts.take(pa.array(rows))
        out.append(Coded(rows, *(_lower_words(own) if bpe.lower else _spaced_words(own))))
    if odd:
        lists = [[w for special, part in bpe.parts(strings[k]) for w in ([SPECIAL + part] if special else bpe.chunks(part))] for k in odd]
        words = pa.array([w for own in lists for w in own], pa.string()).dictionary_encode()
        out.append(Coded(np.array(odd), np.cumsum([0, *map(len, lists)]), words.indices.to_numpy(), words.dictionary.to_pylist()))
    return out


def even(text: str) -> bool:
    """Whether the text has one space between words and one line end between lines, and none at its ends."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(map(text.__contains__, UNEVEN))


def _lower_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    words = lists.flatten().dictionary_encode()
    codes, bounds, chunks = words.indices.to_numpy(), _bounds(lists), words.dictionary.to_pylist()
    if "" in chunks:  # white space at an end of a text
        real = codes != chunks.index("")
        codes, bounds = codes[real], np.concatenate([[0], np.cumsum(real)])[bounds]
    return bounds, codes, chunks


def _spaced_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
    words = lists.flatten().dictionary_encode()
    codes, bounds, chunks = words.indices.to_numpy().astype(np.int64), _bounds(lists), words.dictionary.to_pylist()
    bare = np.zeros(len(codes), bool)  # words without a space before them
    bare[bounds[:-1]] = True
    if "\n" in chunks:
        ends = codes == chunks.index("\n")
        bare |= ends
        bare[1:] |= ends[:-1]
    codes = 2 * codes + bare
    used = np.zeros(2 * len(chunks), bool)
    used[codes] = True
    return bounds, (np.cumsum(used) - 1)[codes], [chunks[k >> 1] if k & 1 else " " + chunks[k >> 1] for k in np.flatnonzero(used).tolist()]


def _bounds(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0]


def gathered(values: list[bytes], codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds of each text in them) from each chunk's packed ids."""
    ids, sizes = np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) >> 2
    starts, n = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])], ends[bounds]


@lru_cache(1)
def letter_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(BYTE_LETTERS)}


@lru_cache(8)
def load_bpe(path: str) -> Bpe:
    return Bpe(path)


class WordCache(dict):
    """word -> what ``make`` gives for it.

    Two generations: when the young one is full it becomes the old one, from
    which words that come again are taken back, so frequent words stay.
    """

    def __init__(self, make: Callable[[str], object] | None = None, size: int = CACHE_WORDS):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self.keep(word, value)
        return value

    def keep(self, word: str, value: object) -> None:
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[word] = value


class PackedIds:
    """The ids of chunks as little-endian 32-bit integers; pre-tokens are merged by the library, and the cache serves all tasks of a worker."""

    def __init__(self, path: str):
        self.bpe = bpe = load_bpe(path)
        tokenize, words_of, special = bpe.library.model.tokenize, bpe.words_of, {SPECIAL + s: k for s, k in bpe.special.items()}

        def packed(chunk: str) -> bytes:
            if chunk in special:
                return struct.pack("<I", special[chunk])
            words = words_of(chunk)
            if len(words) > 1:
                return b"".join(map(self.known.__getitem__, words))
            ids = [t.id for w in words for t in tokenize(letters_of(w))]
            return struct.pack(f"<{len(ids)}I", *ids)

        self.known = WordCache(packed)

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids, bounds) of groups of texts: row ``rows[k]`` has ``ids[bounds[k] : bounds[k + 1]]``."""
        for rows, bounds, codes, chunks in coded(self.bpe, texts):
            yield rows, *gathered([*map(self.known.__getitem__, chunks)], codes, bounds)
