"""SimHash fingerprints of word shingles, their classes within a Hamming radius, and near-duplicate removal.

``simhash_classes`` links fingerprints only; ``drop_near_duplicates`` takes the
classes of such links and MinHash bands, which see what fingerprints miss, as
candidates and checks the shingles themselves, so that what it removes really
is alike.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, columns, few, map_batches, stored, text_or_empty
from .components import components
from .hamming import near_links

#: Hashes whose bits are counted at a time.
CHUNK = 1 << 15
#: MinHash bands and the values in each: texts at Jaccard 0.8 agree in no band with a probability of (1 - 0.8 ** 6) ** 20 = 0.0023.
BANDS, ROWS = 20, 6
#: Odd factors; each puts the hashes in another order.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Pairs for each member of a key up to which keys are not compared in further rounds.
DIRECT = 4
#: Texts that are compared with one text in one task.
SHARE = 256
#: Differing bits up to which SimHash fingerprints are linked.
RADIUS = 2
#: One of so many shingles is looked at first, for texts that have too much of their own.
SLICES = 4


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of ``size`` words joined by a space, repeats included; fewer words give one run, none give none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    return [line[x : y - 1] for x, y in zip(at, at[size:], strict=False)]


def shingle_digests(words: list[bytes], size: int) -> bytes:
    """XXH64 with seed 42 of every shingle, repeats included, highest byte first."""
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, 42) for s in shingles(words, size)])


def shingle_fingerprint(words: list[bytes], size: int) -> bytes:
    """Eight bytes, highest first: a bit is set if it is in over half the shingles' XXH64 with seed 42. No words: zero."""
    return fingerprint_of(shingle_digests(words, size))


def fingerprint_of(digests: bytes) -> bytes:
    """``shingle_fingerprint`` from ``shingle_digests``."""
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[k : k + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def word_fingerprint(words: list[bytes]) -> bytes:
    """Eight bytes: each distinct word's hash votes on every bit, with a weight of 1 + ln(times it occurs)."""
    counts = Counter(words)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(w, 42) for w in counts]), np.uint8).reshape(-1, 8)
    weights = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    votes = np.zeros(64)
    for k in range(0, len(hashes), CHUNK):
        votes += weights[k : k + CHUNK] @ np.unpackbits(hashes[k : k + CHUNK], axis=1)
    return np.packbits(2 * votes > weights.sum()).tobytes()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles."""
    return np.unique(np.frombuffer(shingle_digests(words, size), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band: sets of hashes whose Jaccard similarity is J share one with probability J ** ROWS. No hashes: no keys."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[k : k + 1024, None] * FACTORS).min(axis=0), out=least)
    return _as_longs([xxhash.xxh64_digest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]).tolist()


def _as_longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64)


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp as a signed long) of every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch_of(batch.column(0), _as_longs([shingle_fingerprint(words_of(t), size) for t in batch.column(1).to_pylist()]))

        return step

    return map_batches(docs.select(F.col(id_col), text_or_empty(text_col)), make, f"{id_col} {dict(docs.dtypes)[id_col]}, fp long")


def hex_of(col: str):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def simhash_classes(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Rows of one fingerprint are folded to one node before anything is paired,
    so copies cost nothing more. Links are all pairs of different fingerprints
    within ``radius``; component_id is the smallest id that a row reaches.

    Edge cases: null and empty texts have fingerprint zero and are linked like
    any other; repeated rows come back each; a row whose id is null takes part
    only through other rows with its fingerprint; an empty table gives no rows.
    """
    fps = checkpoint(fingerprints(docs, size, id_col, text_col))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min(id_col).cast("long").alias("node")))
    found = components(near_links(nodes, radius))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp").select(id_col, hex_of("fp").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each group the row with the smallest id stays.

    Two texts are near duplicates if the Jaccard similarity of their sets of
    ``size``-word shingles is at least ``similarity``; groups are what such
    links connect. Texts of the same words are folded to one node. Candidates
    are nodes that one class of SimHash fingerprints holds (links of up to
    ``RADIUS`` bits, found as in ``simhash_classes``) or that share a MinHash
    band; no candidate pair that is alike is left out, except where other links
    have put its texts into one group.

    Edge cases: rows with the same words (null and empty texts among them) are
    copies, of which the smallest id stays; of rows that share id and text the
    one whose other columns come first as JSON stays; a row with a null id
    stays unless it is a copy; different texts that share an id count as one
    node and go together as near duplicates; columns of any name are kept as
    they are. Ids are whole numbers.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(hashlib.md5(b" ".join(words)).digest(), shingle_digests(words, size)) for words in map(words_of, batch.column(2).to_pylist())]
            sets = [np.unique(np.frombuffer(d, np.uint64)) for _, d in found]
            return batch_of(batch.column(0), batch.column(1), [w for w, _ in found], [*map(len, sets)], pa.array([band_keys(h) for h in sets], pa.list_(pa.int64())), _as_longs([fingerprint_of(d) for _, d in found]))

        return step

    key = F.unhex(F.md5(text_or_empty(text_col)))
    marked = map_batches(docs.select(docs[id_col], key, text_or_empty(text_col)), make, f"id {kind}, copy binary, words binary, n long, keys array<long>, fp long")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "copy")).alias("x")
    texts = stored(marked.groupBy("words").agg(first, F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")).select("x.id", "x.copy", "n", "keys", "fp"))
    known = texts.where("id is not null").select(F.col("id").cast("long").alias("node"), "n", "keys", "fp")
    keyed = known.select("node", "n", F.explode("keys").alias("key")).unionByName(simhash_keys(known.select("node", "n", "fp")))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    members = checkpoint(keyed.join(shared, "key").select("key", "node", "n"))
    whole = docs.select(F.struct(*columns(docs.columns)).alias("row"), docs[id_col].alias("id"), key.alias("copy"))
    own = whole.select(F.col("id").cast("long").alias("node"), "copy", F.col("row")[text_col].cast("string").alias("text"))
    chosen = texts.join(members.select(F.col("node").cast(kind).alias("id")).distinct(), "id").select(F.col("id").cast("long").alias("node"), "copy")
    groups = linked(members, stored(own.join(chosen, ["node", "copy"]).dropDuplicates(["node"]).select("node", F.coalesce("text", F.lit("")).alias("text"))), size, similarity)
    kept = texts.join(groups.select(F.col("node").cast(kind).alias("id")), "id", "left_anti").select(F.col("id").alias("kept_id"), F.col("copy").alias("kept_copy"))
    rest = [F.col("row")[c] for c in docs.columns if c not in (id_col, text_col)]
    of_one = whole.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("copy") == F.col("kept_copy"))).groupBy("id", "copy")
    return of_one.agg(F.min_by("row", F.to_json(F.struct(*rest)) if rest else F.lit("")).alias("row")).select("row.*")


def simhash_keys(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, n, key) of ``nodes`` (node, n, fp): a key for each class of fingerprints that links within ``radius`` connect.

    Equal fingerprints are folded before anything is paired, as in ``simhash_classes``.
    """
    firsts = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    classes = firsts.join(components(near_links(firsts, radius)), "node", "left").select("fp", F.coalesce("component", "node").alias("class"))
    return nodes.join(classes, "fp").select("node", "n", F.xxhash64(F.lit("class"), F.col("class")).alias("key"))


def linked(members: DataFrame, texts: DataFrame, size: int, similarity: float, retained: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) as ``components`` gives them, of the links among nodes that share a key.

    ``members``: key, node, n (distinct shingles of its text); ``texts``:
    node, text. While more pairs of different groups are left than a few for
    each member, every key names one of its nodes, and every node is compared
    with one of those that its keys name. Named is first the node whose keys
    hold most nodes, as the text that a group's other texts come from shares
    most with them, and other ones in the rounds after. This joins most of a
    large group in work that grows with its nodes. When that no longer halves what is left, or little is left, the
    nodes of keys that several groups share are compared across groups as far
    as their rarest shingles allow a link (``across_groups``), which misses no
    pair that is alike. With ``retained`` (rows (a, b), one for each key that
    they share, to distinct pairs worth a comparison) the keys with fewest
    pairs, which together give few enough, are met through to the end; of these
    pairs and those of the rounds before, what ``retained`` keeps is compared;
    only nodes of the other keys have their shingles sorted. A pair that shares a key is in one part or the other.
    """
    most = DIRECT * members.count()
    wide = members.join(members.groupBy("key").agg(F.count("*").alias("m")), "key").groupBy("node").agg(F.sum("m").cast("double").alias("central"))
    groups = checkpoint(few(wide.withColumn("group", F.col("node"))))
    tried, before = None, float("inf")
    for k in count():
        named = checkpoint(few(members.join(groups, "node")))
        sizes = named.groupBy("key", "group").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("all"), F.max(F.struct("m", "group")).alias("main")).where("main.m < all")
        sizes = checkpoint(few(sizes.select("key", ((F.col("all") - F.col("main.m")) * F.col("all")).cast("double").alias("pairs"))))
        left = sizes.agg(F.sum("pairs")).first()[0] or 0
        open_ = named.join(sizes.select("key"), "key")
        last = left <= most or left > before / 2
        prefixed = last and (retained is None or left > most)  # keys of more pairs than ``limit`` are compared by shingles
        limit = (_most_pairs(sizes, most) if retained else 0) if prefixed else 0
        found = []
        if not prefixed or limit:
            met = open_.join(sizes.where(F.col("pairs") <= limit).select("key"), "key", "left_semi") if prefixed else open_
            order = F.struct((-F.col("central") * (1 - F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1000)) / 2000 * int(k > 0))).alias("less"), "node")
            other = met if last else met.groupBy("key").agg(F.min_by(F.struct("node", "n", "group", order.alias("order")), order).alias("x")).select("key", "x.*")
            other = other.select("key", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("group").alias("a_group"), *([] if last else ["order"]))
            both = met.withColumnRenamed("node", "b").join(other, "key")  # the side with few rows of a key stands right, where a merge join holds a key's rows
            pairs = both.where((F.col("a_group") != F.col("group")) & (F.least("a_n", "n") >= similarity * F.greatest("a_n", "n")))
            if last:
                found.append((retained or DataFrame.distinct)(pairs.where("a < b").select(*_ordered("a", "b", k))))
            else:
                found.append((retained or DataFrame.distinct)(pairs.groupBy("b").agg(F.min("order").alias("x")).select(*_ordered("x.node", "b", k))))
        if prefixed:
            long = open_.join(sizes.where(F.col("pairs") > limit).select("key"), "key", "left_semi")
            found.append(across_groups(long.select("node", "group").distinct(), texts, size, similarity).select(*_ordered("a", "b", k)).distinct())
        pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select(*_ordered("a", "b", k)), ["a", "b"], "left_anti")
        new = checkpoint(few(alike(checkpoint(few(pairs)), texts, size, similarity)))
        tried = new.select("a", "b") if tried is None else tried.unionByName(new.select("a", "b"))
        ends = [groups.select(F.col("node").alias(c), F.col("group").alias(f"{c}_group")) for c in "ab"]
        links = new.where("alike").join(ends[0], "a").join(ends[1], "b").select("a_group", "b_group")
        merged = components(links, "a_group", "b_group").withColumnRenamed("node", "group")
        groups = checkpoint(few(groups.join(merged, "group", "left").select("node", "central", F.coalesce("component", "group").alias("group"))))
        if last:
            return groups.where("node <> group").select("node", F.col("group").alias("component"))
        before = left
    raise AssertionError


def _most_pairs(sizes: DataFrame, most: int) -> float:
    """The largest power of two so that the keys of ``sizes`` (key, pairs) with no more pairs than it have ``most`` together at most; 0 if there is none."""
    by_length = sizes.groupBy(F.ceil(F.log2("pairs")).alias("power")).agg(F.sum("pairs").alias("pairs")).orderBy("power").collect()  # a row for each power of two
    fit = [r.power for r, total in zip(by_length, accumulate(r.pairs for r in by_length), strict=True) if total <= most]
    return 2.0 ** fit[-1] if fit else 0


def across_groups(nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, group) of different groups, among them all whose shingle sets reach ``similarity``.

    Every node's shingles are put in one order: those that only one group has,
    which no pair has in common and which are only counted, then the others,
    the rarest first. If the first
    shingle that two sets of n and m have in common is the i-th of one and the
    j-th of the other, they have n - i + 1 and m - j + 1 in common at most, so
    the i-th shingle of a set can only be the first of a link to sets of up to
    ``cap`` shingles. Pairs that share no such shingle are not looked at. One
    side of a pair is never of the group that most sets of the shingle are in,
    so what a shingle makes grows with the sets outside that group.

    Before that, nodes go that one in ``SLICES`` of the shingles already shows to
    have more shingles of their group alone than a link leaves.
    """
    def hashed(chosen: DataFrame, one_in: int) -> DataFrame:
        """(node, group, n, h): a row for each distinct shingle of the texts of ``chosen`` whose hash ``one_in`` divides."""

        def make():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [shingle_hashes(words_of(t), size).view(np.int64) for t in batch.column(2).to_pylist()]
                sizes, found = np.array([*map(len, found)]), [h[h % one_in == 0] for h in found]
                rows = np.repeat(np.arange(len(found)), [*map(len, found)])
                return batch_of(batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), sizes[rows], np.concatenate(found)) if len(rows) else None

            return step

        return stored(map_batches(texts.join(chosen, "node").select("node", "group", "text"), make, "node long, group long, n int, h long"))

    first = hashed(nodes, SLICES)
    common = first.groupBy("h").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    held = first.join(common.select("h"), "h", "left_semi").groupBy("node").agg(F.count("*").alias("held"))
    own = first.groupBy("node").agg(F.count("*").alias("all"), F.max("n").alias("n")).join(held, "node", "left")
    apart = own.where(F.col("all") - F.coalesce("held", F.lit(0)) > (1 - similarity) * F.col("n") + 1e-6).select("node")
    shingle = hashed(nodes.join(apart, "node", "left_anti"), 1)
    of_node, of_shingle = Window.partitionBy("node"), Window.partitionBy("h")
    cap = (1 + 1 / similarity) * (F.col("n") - F.col("at") + 1) - F.col("n") + 1e-6
    shared = shingle.select("*", F.count("*").over(of_shingle).alias("sets"), F.min("group").over(of_shingle).alias("low"), F.max("group").over(of_shingle).alias("high")).where("low < high")
    mixed = shared.withColumns({"at": F.row_number().over(of_node.orderBy("sets", "h")), "mixed": F.count("*").over(of_node)})
    front = mixed.withColumn("at", F.col("n") - F.col("mixed") + F.col("at")).withColumn("cap", cap).where(F.col("cap") >= similarity * F.col("n"))
    front = stored(front.select("h", "node", "group", "n", "cap"))
    of_groups = front.groupBy("h", "group").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    of_all = of_groups.groupBy("h").agg(F.min("least").alias("least"), F.max(F.struct("m", "group")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    useful = stored(front.join(of_all, "h").where("cap >= least").select("h", "node", "group", "n", "cap", (F.col("group") == F.col("main.group")).alias("main")))
    x, y = useful.where("not main").alias("x"), useful.alias("y")
    met = y.join(x, (F.col("x.h") == F.col("y.h")) & (F.col("x.group") != F.col("y.group")) & (F.col("x.n") <= F.col("y.cap")) & (F.col("y.n") <= F.col("x.cap")))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _ordered(a: str, b: str, k: int) -> tuple[Column, Column]:
    """The two nodes in the order of their hashes in round ``k``, so that the node which a key compares with its others comes first."""
    x, y = (F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("node")) for c in (a, b))
    return F.least(x, y)["node"].alias("a"), F.greatest(x, y)["node"].alias("b")


def alike(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b, alike) of every pair: whether the Jaccard similarity of the texts' shingle sets reaches ``similarity``.

    The text of b travels with each pair; that of a is sent in front of its
    pairs, once for about ``SHARE`` of them, which are one task's. One join
    fetches the texts of both. Two texts without words are alike.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares")).where("shares > 1")
    pairs = pairs.join(shares, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).alias("share"))
    fronts = pairs.select(F.col("a").alias("node"), "a", "share").distinct().withColumn("b", F.lit(None).cast("long"))
    sent = texts.join(fronts.unionByName(pairs.select(F.col("b").alias("node"), "a", "share", "b")), "node")
    dealt = sent.select("a", "share", "b", "text").repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first()).drop("share")

    def make():
        held: list = [None, set()]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = set(shingles(words_of(text), size))
                if b is None:
                    held[:] = a, own
                else:
                    both = len(own & held[1])
                    out.append((a, b, both >= similarity * (len(own) + len(held[1]) - both)))
            return batch_of(*map(list, zip(*out, strict=True))) if out else None

        return step

    return map_batches(dealt, make, "a long, b long, alike boolean")
