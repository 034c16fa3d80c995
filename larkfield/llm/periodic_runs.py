"""Stretches of words that repeat themselves with a period, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and a length of at least max(24, 3 * q) that no neighbouring
word extends keeping that period.

Periods up to ``DIRECT`` are found by comparing all words with those q places
on. Longer periods are found by minimizers, in scales: a scale of the periods
Q to R (half as much again) names every gram of R words by a hash and keeps
the grams that are smallest in a window of 2 * Q + 1 - R grams. A run of at
least three periods holds a window and the same window one period on, and both
have their smallest gram at the same place; a gram of at least q words of a
run comes again after q words and not before, as q is the smallest period. So
among the kept grams of a scale, two neighbours with one hash that lie q apart
are met in every run of a period of that scale. Such pairs are seeds: they are
extended word by word, comparing numbers of words, not hashes. What is then
too short is dropped, and of stretches with equal ends the one of the smallest
period stays.

All documents of a slice are scanned at once, with a separator of its own
after each; documents that are too short for a scale leave it. The work is
that of one task for each slice of documents, without a shuffle.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, columns, map_batches, text_or_empty

#: Least words of a run, and least periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Longest period that is found by direct comparison.
DIRECT = 8
#: Odd factors of the hashes.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15))
#: About the bytes of texts that are scanned together.
SLICE = 2 << 20
#: Words compared at first when a seed is extended; twice as many each time.
STRIDE = 64

NEW = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed", "collapsed_sha256")


def least_length(period):
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * period)


def mixed(x: np.ndarray) -> np.ndarray:
    """``x``, an array of nobody else's, after a step that is not linear, so that repetitive texts have no collisions of their own."""
    shifted = x >> np.uint64(32)
    x ^= shifted
    x *= MIX[0]
    np.right_shift(x, np.uint64(29), out=shifted)
    x ^= shifted
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two neighbouring hashes."""
    both = left * MIX[1]
    both += right
    return mixed(both)


class Grams:
    """Hashes of all runs of so many words of a line; sizes must not fall."""

    def __init__(self, words: np.ndarray) -> None:
        self.part, self.n = mixed(words.astype(np.uint64) + np.uint64(1)), 1

    def of(self, size: int) -> np.ndarray:
        """From the two runs of a power of two that cover each run."""
        while 2 * self.n <= size:
            self.part, self.n = joined(self.part[: -self.n], self.part[self.n :]), 2 * self.n
        more = size - self.n
        return joined(self.part[: len(self.part) - more], self.part[more:]) if more else self.part


def slid(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        values, n = pick(values[:-n], values[n:]), 2 * n
    return values if n == width else pick(values[: len(values) - (width - n)], values[width - n :])


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest value of some window of ``width`` values, all of equal ones."""
    least = slid(np.minimum, hashes, width)
    edge = np.zeros(width - 1, hashes.dtype)
    return np.flatnonzero(slid(np.maximum, np.concatenate([edge, least, edge]), width) == hashes)


def seeds(grams: Grams, length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of neighbouring equal minimizers whose lag is ``low`` to ``high``, by lag and place."""
    width = 2 * low + 1 - high
    if length < high + width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = grams.of(high)
    at = minimizers(hashes, width)
    own = hashes[at]
    order = np.argsort(own, kind="stable")
    at, own = at[order], own[order]
    lag = at[1:] - at[:-1]
    good = (own[1:] == own[:-1]) & (lag >= low) & (lag <= high)
    at, lag = at[:-1][good], lag[good]
    order = np.lexsort((at, lag))
    return at[order], lag[order]


def agree_after(words: np.ndarray, at: int, lag: int) -> int:
    """The first place from ``at`` on whose word is not the one ``lag`` on."""
    step, n = STRIDE, len(words)
    while at + lag < n:
        stop = min(at + step, n - lag)
        differ = words[at:stop] != words[at + lag : stop + lag]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = stop, 2 * step
    return at


def agree_before(words: np.ndarray, at: int, lag: int) -> int:
    """The first place of the stretch before ``at`` whose words are those ``lag`` on."""
    step = STRIDE
    while at > 0:
        start = max(at - step, 0)
        differ = words[start:at] != words[start + lag : at + lag]
        k = int(differ[::-1].argmax())
        if differ[len(differ) - 1 - k]:
            return at - k
        at, step = start, 2 * step
    return at


def scanned(words: np.ndarray, lag: int) -> list[tuple[int, int, int]]:
    """(start, length, lag) of all stretches that are long enough, by comparing every word with that ``lag`` on."""
    same = np.flatnonzero(words[:-lag] == words[lag:])
    if not len(same):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(same) > 1]))
    last = np.concatenate([first[1:], [len(same)]]) - 1
    length = same[last] - same[first] + 1 + lag
    good = np.flatnonzero(length >= least_length(lag))
    return [(s, n, lag) for s, n in zip(same[first[good]].tolist(), length[good].tolist(), strict=True)]


def extended(words: np.ndarray, at: np.ndarray, lag: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, lag) of the long enough stretches around seeds, which come by lag and place."""
    out, lag_before, end = [], 0, 0
    for x, q in zip(at.tolist(), lag.tolist(), strict=True):
        if q == lag_before and x < end:  # inside the stretch just looked at
            continue
        lag_before, end = q, agree_after(words, x, q)
        start = agree_before(words, x, q)
        if end > x and end - start + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
            out.append((start, end - start + q, q))
    return out


def runs_of(lists: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each array of word numbers, by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in lists]
    sizes = np.array([*map(len, lists)], np.int64)
    kept, line, starts, grams, low, least = None, None, None, None, 1, LEAST_WORDS
    while True:
        own = np.flatnonzero(sizes >= least)
        if not len(own):
            break
        if kept is None or sizes[own].sum() < 0.7 * sizes[kept].sum():
            kept = own
            parts = []
            for k in kept.tolist():  # separators are negative, each one another
                parts += [lists[k], np.array([-1 - k])]
            line = np.concatenate(parts).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes[kept] + 1)])
            grams = Grams(line)
        high = low if low <= DIRECT else low + low // 2
        hits = scanned(line, low) if low <= DIRECT else extended(line, *seeds(grams, len(line), low, high))
        for (start, length, q), k in zip(hits, np.searchsorted(starts, [h[0] for h in hits], side="right") - 1, strict=True):
            spot = (start - int(starts[k]), length)
            own_runs = found[kept[k]]
            own_runs[spot] = min(q, own_runs.get(spot, q))
        low = high + 1
        least = max(LEAST_WORDS, LEAST_PERIODS * low)
    return [sorted((s, n, q) for (s, n), q in own.items()) for own in found]


def numbered(lists: list[list[bytes]]) -> list[np.ndarray]:
    """The words as numbers, equal for equal words."""
    numbers: dict[bytes, int] = {}
    get = numbers.setdefault
    return [np.array([get(w, len(numbers)) for w in words], np.int64) for words in lists]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the runs of each text's words and the text without repeats.

    Words are what stands between ASCII white space. New columns: n_runs;
    start, length, period and exponent_milli (1000 * length / period, rounded
    down) of the run with the greatest exact length / period, of equal ones
    that with the smallest start, then period; runs, an array of all (start,
    length, period) by start, then period; runs_sha256 of their lines
    "start,length,period"; collapsed, the words that no run holds after its
    first period, joined by one space; collapsed_sha256.

    Edge cases: a null, empty or blank text has no words and no run (four
    nulls, the digests of the empty string); runs of one text may overlap;
    repeated rows come back each; an empty table gives no rows; columns with
    the names of the new ones are replaced.
    """
    carried = [c for c in docs.columns if c not in NEW]
    rows = docs.select(F.struct(*columns(carried)).alias("row"), text_or_empty(text_col).alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t.encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            found, out = runs_of(numbered(texts)), []
            for words, runs in zip(texts, found, strict=True):
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                kept = b" ".join(kept_words(words, runs))
                milli = 1000 * best[1] // best[2] if runs else None
                out.append((len(runs), *best, milli, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], hashlib.sha256(lines).hexdigest(), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            cols = [*map(list, zip(*out, strict=True))]
            run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            return batch_of(batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], run), cols[6], cols[7], cols[8])

        return step

    long, run = T.LongType(), T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    kinds = (long, long, long, long, long, T.ArrayType(run), T.StringType(), T.StringType(), T.StringType())
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, k) for c, k in zip(NEW, kinds, strict=True)]])
    return map_batches(rows, make, schema, size=SLICE).select(*[F.col("row")[c].alias(c) for c in carried], *NEW)
