"""All 64-bit fingerprints within a Hamming radius, by the generalised pigeonhole principle.

If two fingerprints differ in at most ``radius`` bits, and the bits are dealt
to m partitions with thresholds that add up to radius - m + 1, they differ in
at most its threshold in some partition. Bits that go together are put into
one partition, so that the others stay selective, and the thresholds are not
equal: dynamic programming takes those with the lowest cost, counted as the
keys to write plus the candidate pairs to look at. Both come from statistics
of all fingerprints: how often each pair of bits is set, and how often each
value of a partition occurs.

A threshold of t is probed by leaving out each choice of t bits: two
fingerprints within it share at least one of these keys. Rows are grouped by
key, sorted and streamed; a group of many rows is searched through narrower
tables over all bits instead of pair by pair, so no group's work or output is
the square of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 64
#: What writing one key costs, in candidate pairs looked at.
KEY_COST = 20.0
#: Rows of a key up to which all pairs are looked at; more go through narrower tables.
DENSE = 4096


def bit_statistics(fps: DataFrame, col: str = "fp") -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how often each two bits are set together (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array([*range(BITS * BITS), -1], pa.int32()), "n": pa.array([*total.ravel().astype(np.int64).tolist(), n], pa.int64())})

    found = dict(fps.select(col).where(F.col(col).isNotNull()).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect())
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def bits_of(values: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each value, lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of differing bits; unsigned, as the count of a negative number is that of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` partitions of nearly equal width: each starts at the bit most correlated with what is left and takes those most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, parts = [*range(BITS)], []
    for k in range(m):
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < (BITS * (k + 1)) // m - (BITS * k) // m:
            part.append(max(left, key=lambda b: (corr[b, part].sum(), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds (one of each partition's keys) that add up to ``total``, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t, more in options.items():
                if have + t not in nxt or cost + more < nxt[have + t][0]:
                    nxt[have + t] = cost + more, [*chosen, t]
        best = nxt
    return best[total]


def plan_masks(fps: DataFrame, radius: int, col: str = "fp") -> list[int]:
    """The key masks (as signed longs) that find all pairs of ``fps`` within ``radius``."""
    n, both = bit_statistics(fps, col)
    choices = {m: correlated_partitions(n, both, m) for m in range(2, min(radius + 1, 4) + 1)} if radius else {}
    if not choices:
        return [-1]
    p = np.diag(both) / max(n, 1)
    odds = (q := 2 * p * (1 - p)) / (1 - q)
    table = [(m, k, signed(sum(1 << b for b in part))) for m, parts in choices.items() for k, part in enumerate(parts)]
    keyed = fps.select(F.posexplode(F.array(*[F.lit(mask) for _, _, mask in table])).alias("at", "mask"), col).select("at", F.col(col).bitwiseAND(F.col("mask")).alias("key"))
    same = dict(keyed.groupBy("at", "key").count().groupBy("at").agg(F.sum(F.col("count").cast("double") * F.col("count"))).collect())
    plans = []
    for m, parts in choices.items():
        costs = []
        for part, at in zip(parts, [i for i, x in enumerate(table) if x[0] == m], strict=True):
            within, options = [1.0], {-1: 0.0}
            for b in part:  # elementary symmetric sums: candidates that differ in t bits, for each that differs in none
                within = [x + odds[b] * y for x, y in zip([*within, 0.0], [0.0, *within], strict=True)][: radius + 1]
            for t in range(min(2, radius) + 1):
                options[t] = comb(len(part), t) * KEY_COST * n + same.get(at, 0.0) * sum(within[: t + 1]) * (1 + t)
            costs.append(options)
        if 2 * m >= radius - m + 1:
            plans.append((*allocate(costs, radius - m + 1), m))
    _, thresholds, m = min(plans)
    masks = []
    for part, t in zip(choices[m], thresholds, strict=True):
        if t >= 0:
            masks += [signed(sum(1 << b for b in part if b not in out)) for out in combinations(part, t)]
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, radius: int, nearest: bool = False, id_col: str = "node", fp_col: str = "fp", masks: list[int] | None = None) -> DataFrame:
    """(a, b, distance) with a < b, distinct: pairs of nodes whose fingerprints differ in at most ``radius`` bits.

    All of them, or with ``nearest`` those in which one is the nearest (then
    smallest) that the other finds under some key, so a node is in as many
    pairs of its own as there are keys at most.
    """
    masks = plan_masks(nodes, radius, fp_col) if masks is None else masks
    rows = nodes.where(F.col(id_col).isNotNull() & F.col(fp_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(fp_col).alias("fp"))
    keyed = rows.select(F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("at", "mask"), "node", "fp").select("at", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "node", "fp")
    dealt = keyed.repartition("at", "key").sortWithinPartitions("at", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, fp, group in _whole_groups(batches):
            i, j = pairs_in_groups(fp, group, radius, nearest)
            if len(i):
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                own = a < b
                yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own]), pa.array(bits_apart(fp[i], fp[j])[own].astype(np.int32))], names=["a", "b", "distance"])

    return dealt.mapInArrow(run, "a long, b long, distance int").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches joined and cut anew between keys: (nodes, fingerprints, number of the key's group)."""
    kept: list[tuple[np.ndarray, ...]] = []
    last: tuple[int, int] | None = None
    for batch in batches:
        cols = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(cols[0]):
            continue
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        if last is not None and (cols[0][0], cols[1][0]) != last:
            new = np.concatenate([[0], new])
        last = cols[0][-1], cols[1][-1]
        if len(new):
            kept.append(tuple(c[: new[-1]] for c in cols))
            yield _grouped(kept)
            kept = [tuple(c[new[-1] :] for c in cols)]
        else:
            kept.append(cols)
    if kept:
        yield _grouped(kept)


def _grouped(kept: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, key, node, fp = (np.concatenate(c) for c in zip(*kept, strict=True))
    if not len(at):
        return node, fp, at
    return node, fp, np.concatenate([[0], np.cumsum((at[1:] != at[:-1]) | (key[1:] != key[:-1]))])


def pairs_in_groups(fp: np.ndarray, group: np.ndarray, radius: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group within ``radius``; rows stand in the order of their groups, which are numbered from 0."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(fp):
        sizes = np.bincount(group)
        small = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= 32))
        f, g = fp[small], group[small]
        for d in range(1, int(sizes[sizes <= 32].max(initial=1))):
            i = np.flatnonzero(g[d:] == g[:-d])
            i = i[bits_apart(f[i], f[i + d]) <= radius]
            found.append((small[i], small[i + d]))
        if nearest and found:
            found = [_nearest(fp, *map(np.concatenate, zip(*found, strict=True)))]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for k in np.flatnonzero(sizes > 32):
            best: tuple[np.ndarray, np.ndarray] | None = None
            for i, j in near_pairs(fp[starts[k] : starts[k + 1]], radius):
                i, j = i + starts[k], j + starts[k]
                if nearest:
                    best = _nearest(fp, *((i, j) if best is None else (np.concatenate([best[0], i]), np.concatenate([best[1], j]))))
                else:
                    found.append((i, j))
            if best is not None:
                found.append(best)
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    i, j = map(np.concatenate, zip(*found, strict=True))
    return i, j


def _nearest(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row in the pairs the one with its nearest partner."""
    x, y = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((y, bits_apart(fp[x], fp[y]), x))
    x, y = x[order], y[order]
    first = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    return x[first], y[first]


def near_pairs(fp: np.ndarray, radius: int, dense: int = DENSE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius``; up to ``dense`` values pair by pair, more through tables of three of radius + 3 blocks, which such pairs must agree on somewhere."""
    if len(fp) <= dense:
        yield from _all_pairs(fp, np.arange(len(fp)), radius)
        return
    edges = [BITS * k // (radius + 3) for k in range(radius + 4)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:], strict=False)]
    for chosen in combinations(blocks, 3):
        masked = fp & np.int64(signed(sum(chosen)))
        order = np.argsort(masked, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(masked[order][1:] != masked[order][:-1]) + 1, [len(fp)]])
        for x in np.flatnonzero(np.diff(cuts) > 1):
            own = order[cuts[x] : cuts[x + 1]]
            yield from _all_pairs(fp[own], own, radius)


def _all_pairs(fp: np.ndarray, ids: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(0, len(fp), 512):
        i, j = np.nonzero(bits_apart(fp[k : k + 512, None], fp[None, k:]) <= radius)
        own = j > i
        if own.any():
            yield ids[k + i[own]], ids[k + j[own]]
