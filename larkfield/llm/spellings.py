"""Words that are one edit apart, and the more frequent form each of them is a variant of.

Two words are near if exactly one inserted, deleted or replaced code point
makes one of the other. What two near words have in common in front is as long
as some number of code points, and behind that all but one code point of the
shorter word agree again. So pairs are dealt by the length of the shorter word
and an interval [low, high) of that number: all words of a group share their
first ``low`` and their last (shorter length - ``high``) code points, and every
pair belongs to one group only. Groups start with half of a word and are split
in two halves while they have more than ``GROUP`` words; an interval of one
place leaves only the words that differ there, which the alphabet bounds.

A group is one sorted list (of reversed words, where the words share their
ends). The edit matrix of a word against the list is three cells wide. A row
is worked out once for a range of neighbours, as long as their LCPs say that
they share a prefix, and taken on by the ranges that share one code point more;
a range whose row exceeds one edit is skipped with all its words. The rows of
all words and groups of a slice are carried from one prefix length to the next
together.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, map_batches, stored, text_or_empty

#: Letters of a run.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a group above which it is split, and about the code points of groups that are scanned together.
GROUP, CELLS = 250, 100_000
#: A code point that no word has; more than one edit.
NONE, FAR = -1, 2


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, drop_of: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the lower-cased runs of Latin letters of all texts with at least ``least_length`` code points and ``least_count`` occurrences.

    With ``drop_of``, runs whose CRC-32 of "id:run" (lower-cased) it divides
    lose the code point of the CRC-32 modulo their length, which plants
    spelling errors that are the same at every reading. Counts are gathered
    for each slice of documents before they are dealt. A null text has no
    words; a null id counts as an empty string here.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            total: dict[str, int] = {}
            get = total.get
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))  # bytes lower A-Z only
                if drop_of:
                    head = crc32(f"{key}:".encode())
                    for word, n in own.items():
                        h = crc32(word.encode(), head)
                        if h % drop_of == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            total[word] = get(word, 0) + n
                else:
                    for word, n in own.items():
                        if len(word) >= least_length:
                            total[word] = get(word, 0) + n
            return batch_of([*total], [*total.values()]) if total else None

        return step

    texts = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")), text_or_empty(text_col))
    return map_batches(texts, make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def grouped(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, shorter, low, high, affix) for every group of two or more words of which one has the shorter length."""
    size = F.length("word")
    half = F.ceil(F.col("shorter") / 2).cast("int")
    affix = F.xxhash64(F.left("word", F.col("low")), F.right("word", F.col("shorter") - F.col("high")))
    each = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("shorter")).where("shorter >= 0")
    rows = each.select("*", F.explode(F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), (F.col("shorter") + 1).alias("high")))).alias("x")).select("word", "n", "shorter", "x.*").where("low < high")
    key, done = ["shorter", "low", "high", "affix"], None
    while True:
        rows = stored(rows.withColumn("affix", affix))
        sizes = rows.groupBy(*key).agg(F.count("*").alias("m"), F.min(F.length("word")).alias("least")).where("m > 1 and least = shorter")
        sizes = checkpoint(sizes.withColumn("split", (F.col("m") > group) & (F.col("high") - F.col("low") > 1)).select(*key, "split"))
        met = rows.join(sizes, key)
        whole = met.where("not split").drop("split")
        done = whole if done is None else done.unionByName(whole)
        if not sizes.where("split").limit(1).count():
            return done
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        rows = met.where("split").select("word", "n", "shorter", F.explode(halves).alias("x")).select("word", "n", "shorter", "x.*").where("low < high")


def shared_prefix(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        low, n = (mid, n) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def near_in_sorted(words: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of all words of one group that are one edit apart; ``words`` are distinct in a group and sorted by ``group`` and themselves.

    A range of the list is given by its first word, ``at``; the words of a
    range share a prefix, and ``word`` is compared with it: ``before``, ``on``
    and ``after`` are the edits between the prefix and the beginning of the
    word that is one code point shorter, as long, and one longer. Only words
    behind the first of the range are compared, so each pair is met once.
    """
    lengths = np.array([*map(len, words)])
    codes = np.full((len(words), lengths.max() + 3), NONE, np.int32)  # column j + 1 holds code point j
    inside = np.arange(lengths.max())[None] < lengths[:, None]
    codes[:, 1 : lengths.max() + 1][inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    lcp = np.full(len(words), -1)
    lcp[1:] = (codes[1:, 1:] != codes[:-1, 1:]).argmax(axis=1)
    lcp[1:][group[1:] != group[:-1]] = -1
    first = np.flatnonzero(lcp < 0)
    size = np.diff(np.append(first, len(words)))
    at, word = np.repeat(first, size), np.arange(len(words))
    at, word = at[word > at], word[word > at]
    before, on, after = np.full(len(at), FAR, np.int8), np.zeros(len(at), np.int8), np.ones(len(at), np.int8)
    found, depth = [], 0
    while len(at):
        ends = lengths[at] == depth  # the first word of the range is the prefix itself
        if ends.any():
            left = lengths[word[ends]] - depth
            edits = np.select([left == -1, left == 0, left == 1], [before[ends], on[ends], after[ends]], FAR)
            found.append((at[ends][edits == 1], word[ends][edits == 1]))
        heads = np.flatnonzero(lcp < depth)
        ranges = np.flatnonzero((lcp <= depth) & (lengths > depth))  # that share one code point more
        stop = np.append(heads, len(words))[np.searchsorted(heads, at, side="right")]
        low, high = np.searchsorted(ranges, at), np.searchsorted(ranges, stop)
        n = high - low
        own = np.repeat(np.arange(len(at)), n)
        at = ranges[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + low[own]]
        word = word[own]
        behind = word > at
        own, at, word = own[behind], at[behind], word[behind]
        depth += 1
        c = codes[at, depth]
        one = np.minimum(before[own] + (codes[word, depth - 1] != c), on[own] + 1)
        two = np.minimum(np.minimum(on[own] + (codes[word, depth] != c), after[own] + 1), one + 1)
        three = np.minimum(after[own] + (codes[word, depth + 1] != c), two + 1)
        left = lengths[word] - depth  # cells beyond a word's end do not count
        two, three = np.where(left >= 0, two, FAR), np.where(left >= 1, three, FAR)
        good = np.minimum(np.minimum(one, two), three) < FAR
        at, word, before, on, after = at[good], word[good], one[good], two[good], three[good]
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, int), np.zeros(0, int))


def near_in_groups(rows: list[tuple]) -> list[tuple]:
    """(word, n_near, near_n, near) from whole groups of rows (word, n, shorter, low, high, ...)."""
    line, last = [], None
    for k, (word, _, *key) in enumerate(rows):
        if key != last:
            last, number = key, k
        line.append((number, word if key[1] else word[::-1], k))  # words that share their ends are read from there
    line.sort()
    count: Counter = Counter()
    best: dict[tuple, tuple] = {}
    for i, j in zip(*(x.tolist() for x in near_in_sorted([w for _, w, _ in line], np.array([g for g, _, _ in line]))), strict=True):
        a, b = rows[line[i][2]], rows[line[j][2]]
        if min(len(a[0]), len(b[0])) == a[2] and a[3] <= shared_prefix(a[0], b[0]) < a[4]:
            for x, y in ((a, b), (b, a)):
                count[x[0]] += 1
                best[x[0]] = min(best.get(x[0], (0, "")), (-y[1], y[0]))
    return [(w, m, -best[w][0], best[w][1]) for w, m in count.items()]


def near_counts(groups: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word of a group its near words in this group and the most frequent of them (ties: the first in code-point order)."""
    def make():
        held: list[tuple] = []

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out, at, cells = [], 0, 0
            last = batch.column(2).to_pylist()
            held.extend(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True))
            shift = len(held) - len(last)
            for k, ends in enumerate(last):
                cells += held[shift + k][2] + 4
                if ends and (cells > CELLS or not any(last[k + 1 :])):
                    out += near_in_groups(held[at : shift + k + 1])
                    at, cells = shift + k + 1, 0
            del held[:at]
            return batch_of(*map(list, zip(*out, strict=True))) if out else None

        return step

    key = ("shorter", "low", "high", "affix")
    last = F.lead("word").over(Window.partitionBy(*key).orderBy("word")).isNull()
    rows = groups.select("word", "n", last.alias("last"), *key)
    found = map_batches(rows, make, "word string, n_near long, near_n long, near string")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("x")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("x.near").alias("near"), (-F.col("x.less")).alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) of words end. Forms must not go in circles. The way is halved in each round."""
    up = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = checkpoint(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            return up.drop("moved")
        up = up.drop("moved")


def group_spellings(words: DataFrame, ratio: int = 2, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n).

    n_near counts the near words of a word; form is the near word of largest n
    (ties: the first in code-point order), if that n is at least ``ratio``
    times the word's own, else null; root is where the forms end, from the
    word on, or the word itself; form_n is the form's n. ``ratio`` is at least
    2, so forms grow and their chains are short.

    Edge cases: rows with a null word are left out; counts of repeated words
    are added up; other columns are not looked at; the empty word is near to
    every word of one code point; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    words = stored(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = stored(near_counts(grouped(words, group)))
    named = F.col("near_n") >= ratio * F.col("n")
    all_ = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(named, F.col("near")).alias("form"), F.when(named, F.col("near_n")).alias("form_n"))
    all_ = stored(all_)
    roots = rooted(all_.where("form is not null"))
    return all_.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
