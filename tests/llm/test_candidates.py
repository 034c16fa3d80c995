"""Candidates of near duplicates: fingerprints first, few texts sent, texts that cannot link left out."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from larkfield.llm import near_dedup


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def long_texts() -> list[str]:
    rng = random.Random(3)
    texts = []
    for k in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        texts += [" ".join(words), " ".join("edit" if j == 700 + k else w for j, w in enumerate(words))]
    return texts


def test_fingerprint_classes_are_candidates(spark, monkeypatch):
    """Without any band, copies go whose fingerprints differ in two bits and fewer."""
    texts = long_texts()
    fps = np.array([int.from_bytes(near_dedup.shingle_fingerprint(near_dedup.words_of(t), 5), "big") for t in texts], np.uint64)
    close = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if int(np.bitwise_count(fps[a] ^ fps[b])) <= near_dedup.RADIUS}
    assert len(close) >= 3
    monkeypatch.setattr(near_dedup, "band_keys", lambda hashes: [])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(df).collect()}
    assert kept == set(range(len(texts))) - {b for _, b in close}
    classes = near_dedup.simhash_keys(spark.createDataFrame([(k, 1, int(fp)) for k, fp in enumerate(fps.view(np.int64))], "node long, n long, fp long"))
    of_class = {r.node: r.key for r in classes.collect()}
    assert all(of_class[a] == of_class[b] for a, b in close)
    assert len(set(of_class.values())) < len(texts)


def test_texts_are_fetched_once_for_a_comparison(spark):
    texts = spark.range(7).select(F.col("id").alias("node"), F.concat(F.lit("one two three "), F.floor(F.col("id") / 2).cast("string")).alias("text"))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (2, 3), (5, 4), (0, 6)], "a long, b long")
    got = near_dedup.alike(pairs, texts, 2, 0.8)
    assert plan_of(got).count("Range (0, 7") == 1
    assert {(r.a, r.b): r.alike for r in got.collect()} == {(0, 1): True, (0, 2): False, (2, 3): True, (5, 4): True, (0, 6): False}


def test_texts_of_their_own_are_not_sorted(spark, monkeypatch):
    """Of texts with one common passage only those that the rest of their words can link are kept; no pair that is alike is lost."""
    rng, tables, stored = random.Random(9), [], near_dedup.stored
    common = [f"c{k}" for k in range(40)]
    texts = [" ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(150)]) for _ in range(40)]
    texts += [t + " x" for t in texts[:5]]
    monkeypatch.setattr(near_dedup, "stored", lambda df: tables.append(stored(df)) or tables[-1])
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    pairs = near_dedup.across_groups(table.select("node", F.col("node").alias("group")), table, 3, 0.85)
    sets = [set(near_dedup.shingles(near_dedup.words_of(t), 3)) for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert want == {(k, 40 + k) for k in range(5)} and want <= {tuple(sorted((r.a, r.b))) for r in pairs.collect()}
    assert tables[1].select("node").distinct().count() < 20 < tables[0].select("node").distinct().count() == 45


def test_sampled_rows_come_to_the_driver_many_in_one_value(spark, monkeypatch):
    """The driver sees totals, features and blocks of rows; no call brings it a list of all sampled rows, and they are sorted as before."""
    from larkfield.llm import toxicity
    from pyspark.sql.classic.dataframe import DataFrame

    found = [(k % 2, np.array(sorted({k * 7 % 11, k * 5 % 300, 400}), "<i4").tobytes()) for k in range(70)] + [(1, b"")]
    rows, cols, toxic = toxicity.sparse_rows(spark.createDataFrame(found, "toxic int, found binary").repartition(5))
    expected = sorted(found)
    assert toxic.tolist() == [t for t, _ in expected] and rows.dtype.itemsize == 1
    assert [cols[rows == k].tobytes() for k in range(len(expected))] == [f for _, f in expected]

    taken, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: taken.append(len(rows := collect(self))) or rows)
    docs = spark.createDataFrame([(k, f"word{k % 9} other{k % 5} {'vile' if k % 3 else 'kind'} same") for k in range(90)], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(90)], "doc_id long, toxic int"))
    assert model.weights[b"=vile"] > 0 > model.weights[b"=kind"] and max(taken) <= 2


def test_shared_shingles_are_ranked_without_a_join_on_them(spark, monkeypatch):
    """What several groups share is counted in one shuffle by shingle; its rows do not come out of a join."""
    rng = random.Random(4)
    head = [f"h{k}" for k in range(90)]
    texts = [" ".join(head + [f"w{rng.randrange(10**6)}" for _ in range(6)]) for _ in range(20)]
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    plans, stored = [], near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df: plans.append(plan_of(df)) or stored(df))
    pairs = near_dedup.across_groups(table.select("node", F.col("node").alias("group")), table, 3, 0.85)
    assert {tuple(sorted((r.a, r.b))) for r in pairs.collect()} == {(a, b) for b in range(20) for a in range(b)}
    front = next(p for p in plans if "cap" in p and "row_number" in p)
    assert "Join Inner" not in front


def test_a_star_needs_no_round(spark, monkeypatch):
    from larkfield.llm import components

    written, checkpoint = [], components.checkpoint
    monkeypatch.setattr(components, "checkpoint", lambda df: written.append(1) or checkpoint(df))
    star = spark.createDataFrame([(3, 1), (1, 4), (9, 7)], "a long, b long")
    assert sorted(map(tuple, components.components(star).collect())) == [(3, 1), (4, 1), (9, 7)] and len(written) == 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(60, 60)], "a long, b long")
    assert sorted(map(tuple, components.components(chain).collect())) == [(k, 0) for k in range(1, 41)]
