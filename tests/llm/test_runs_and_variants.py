"""Signature joins, periodic runs and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkfield.llm import inverted_join, near_dedup, periodic_runs, queries, spellings

SCHEMA = "doc_id long, text string, n_runs string, word string, row string"
SF = "/root/testdata/sf0.001"


def words_like(rng: random.Random, n: int, letters: str = "abcdefghij") -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def table(spark, texts: list[str | None]):
    return spark.createDataFrame([(k, t, "clash", "clash", "clash") for k, t in enumerate(texts)], SCHEMA).repartition(3)


def shingle_set(text: str | None, size: int = 3) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))} if words else set()


def reached(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def linked_texts(seed: int) -> list[str | None]:
    """Chains of near copies on both sides of the threshold, exact copies, a common passage, short, empty, long and missing texts."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", "  \n", "one two", "ONE two", "one", "É é", "é é"]
    common = words_like(rng, 40)
    for _ in range(12):
        base = words_like(rng, rng.choice([4, 30, 90, 200]))
        texts += [" ".join(base), "\t".join(base)]
        for _ in range(5):
            own = list(base)
            for _ in range(rng.choice([1, 1, 2, 3])):
                own[rng.randrange(len(own))] = "new"
            texts.append(" ".join(own))
            if rng.random() < 0.5:
                base = own
        texts.append(" ".join(base[: len(base) * 7 // 8]))
    texts += [" ".join(common + words_like(rng, 7 * k)) for k in range(8) for _ in range(3)]
    return [*texts, " ".join(words_like(rng, 6000))]


@pytest.mark.parametrize("seed", [1, 2])
def test_signature_join_finds_all_links(spark, seed):
    texts = linked_texts(seed)
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = reached(len(texts), links)
    got = {r.doc_id: r for r in inverted_join.minhash_classes(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, c in enumerate(want):
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(sets[k]), c, c == k), (k, texts[k])


def test_hot_lists_are_compared_by_shingles(spark, monkeypatch):
    """A template below the threshold that all share, so that lists stay longer than direct pairs allow."""
    monkeypatch.setattr(near_dedup, "DIRECT", 0)
    rng = random.Random(5)
    base = words_like(rng, 120)
    texts = [" ".join(base[:100] + words_like(rng, 12)) for _ in range(30)] + [" ".join(base + words_like(rng, 3)) for _ in range(30)]
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in inverted_join.minhash_classes(table(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == reached(len(texts), links)


def test_signature_join_of_odd_tables(spark):
    empty = table(spark, []).where("false")
    assert inverted_join.minhash_classes(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"] and not inverted_join.minhash_classes(empty).count()
    text = " ".join(words_like(random.Random(3), 40))
    rows = spark.createDataFrame([(4, text), (4, text), (2, text + " end"), (None, text), (None, "alone here")], "doc_id long, text string")
    got = sorted(map(tuple, inverted_join.minhash_classes(rows).collect()), key=str)
    assert got == sorted([(4, 38, 2, False), (4, 38, 2, False), (2, 39, 2, True), (None, 38, 2, False), (None, 1, None, False)], key=str)
    with pytest.raises(ValueError):
        inverted_join.minhash_classes(rows, similarity=0.5)
    with pytest.raises(ValueError):
        inverted_join.minhash_classes(rows.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(2)
    for share in (0.85, 0.6):
        agreed = []
        for _ in range(60):
            both, own = int(1000 * share), (1000 - int(1000 * share)) // 2
            x = rng.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64)
            agreed.append((inverted_join.signature(x[: both + own]) == inverted_join.signature(np.concatenate([x[:both], x[both + own :]]))).sum())
        assert abs(np.mean(agreed) / inverted_join.COORDINATES - share) < 0.03
        assert share < 0.8 or min(agreed) >= inverted_join.MATCHES


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_signature_join_gives_the_sql_s_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({queries.MINHASH_SQL})").fetchall()
    assert sorted(map(tuple, queries.op11_minhash_near_dedup(spark, SF).collect())) == sorted(want)


def all_runs(w: list) -> list[tuple[int, int, int]]:
    found: dict = {}
    for q in range(1, len(w) // 3 + 1):
        k = 0
        while k + q < len(w):
            end = k
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end - k + q >= max(24, 3 * q) and end > k:
                found.setdefault((k, end - k + q), q)
            k = max(end, k + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def repeats(rng: random.Random) -> list[int]:
    parts: list[int] = []
    for _ in range(rng.randint(0, 6)):
        k = rng.choice([1, 2, 3, 30])
        parts += [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 11, 13, 14, 20, 22, 34, 40, 61]))] * rng.randint(1, 6)
        del parts[len(parts) - rng.randrange(3) :]
    return parts


def test_runs_are_all_runs():
    rng = random.Random(1)
    for _ in range(300):
        lists = [repeats(rng) for _ in range(rng.randint(1, 5))]
        assert periodic_runs.runs_of([np.array(x, np.int64) for x in lists]) == [all_runs(x) for x in lists]
    a, b = "0", "01"
    while len(b) < 2000:
        a, b = b, b + a
    thue = "0"
    while len(thue) < 1000:
        thue += thue.translate({48: 49, 49: 48})
    for text in (b, thue, b[:300] * 4, "0" * 500, "01" * 300 + "0" * 40):
        assert periodic_runs.runs_of([np.array([*map(int, text)])]) == [all_runs([*text])]


def expected_runs(words: list[str]) -> tuple:
    runs = all_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_a_table(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "a " * 24, "a " * 23, "\x1c \xa0 " * 12, "ü " * 30 + "x" * 200_000, " ".join(words_like(rng, 3000))]
    texts += [" ".join(f"w{x}" for x in repeats(rng)) for _ in range(40)]
    docs = table(spark, texts)
    got = periodic_runs.periodic_runs(docs.unionByName(docs.where("doc_id = 3")))
    assert got.columns == ["doc_id", "text", "word", "row", *periodic_runs.NEW]
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected_runs(words)
        assert [tuple(x) for x in r.runs] == all_runs(words) and hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0


def test_planted_repeats_are_the_contract_s(spark):
    rng = random.Random(6)
    docs = table(spark, [None, "", *[" ".join(words_like(rng, rng.choice([1, 2, 7, 40, 300]))) for _ in range(150)]])
    seen = 0
    for r in docs.select("doc_id", "text").join(queries.with_planted_repeats(docs).withColumnRenamed("text", "new"), "doc_id").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h, n = crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            seen += 1
        assert r.new.split() == w
    assert seen > 5


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_sorted_scan_finds_all_near_words():
    rng = random.Random(8)
    for _ in range(100):
        words, group = [], []
        for g in range(rng.randint(1, 5)):
            front = rng.choice(["", "x", "xé"])
            own = sorted({front + "".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 60))})
            words, group = words + own, group + [g] * len(own)
        want = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if group[i] == group[j] and one_edit(words[i], words[j])]
        assert sorted(zip(*(x.tolist() for x in spellings.near_in_sorted(words, np.array(group))), strict=True)) == want


def variants(counts: dict[str, int]) -> dict[str, tuple]:
    near = {a: [b for b in counts if one_edit(a, b)] for a in counts}
    form = {}
    for a, own in near.items():
        best = min(own, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= 2 * counts[a] else None
    out = {}
    for a in counts:
        root = a
        while form[root] is not None:
            root = form[root]
        out[a] = (form[a], root, counts[a], len(near[a]), counts.get(form[a]))
    return out


@pytest.mark.parametrize("group", [2, 7, 1000])
def test_variants_are_those_of_all_pairs(spark, group):
    """Small groups are split to single places; one prefix and one suffix hold a third of all words each."""
    rng = random.Random(group)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(150)} | {"hotword" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(150)} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + "tail" for _ in range(150)} | {"", "x" * 3000, "x" * 2999 + "y"}
    counts = {w: rng.choice([3, 3, 4, 6, 7, 12, 24, 100, 1000]) for w in words}
    rows = spark.createDataFrame([(w, n, "clash") for w, n in counts.items()] + [(None, 5, "clash")], "word string, n long, form string").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spellings.group_spellings(rows, group=group).collect()}
    assert got == variants(counts)


def test_counted_words_and_variants_of_a_table(spark):
    rng = random.Random(9)
    known = words_like(rng, 60, "abcÉéß")
    texts = [None, "", "42 -- ", "Éclair éclair ÉCLAIR éclair naïve×naïve"] + [" ".join(rng.choice(known).upper() if rng.random() < 0.2 else rng.choice(known) + rng.choice(["", ".", "s"]) for _ in range(200)) for _ in range(40)]
    docs = table(spark, texts)
    for drop_of in (None, 97, 3):
        counts: Counter = Counter()
        for key, text in enumerate(texts):
            for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = crc32(f"{key}:{run}".encode())
                if drop_of and h % drop_of == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                counts[run] += 1
        want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
        words = spellings.count_words(docs, drop_of=drop_of)
        assert {r.word: r.n for r in words.collect()} == want and len(want) > 10
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spellings.group_spellings(words).collect()}
    assert got == variants(want)
    empty = spellings.group_spellings(spellings.count_words(docs.where("false")))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def test_chains_of_forms_end_at_their_last(spark):
    chain = [("w" * k, "w" * (k + 1)) for k in range(1, 40)]
    got = {r.word: r.root for r in spellings.rooted(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w" * 40 for w, _ in chain}
