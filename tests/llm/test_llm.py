"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkfield.llm import bpe_trie, components, fingerprints, hamming, inverted_join, licenses, media_mpeg, near_dedup, packing, substring_dedup, token_counts, tokens, toxicity, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, row string, id string"


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


TEXTS = [None, "", "  \n ", passage(1, 80), passage(1, 80), passage(1, 60) + " new " + passage(2, 70), "Größe <|endoftext|> İstanbul 日本語 it's  42", "x" * 3000, passage(3, 4000), "one two", passage(2, 70) + "\n\n" + passage(1, 80)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", "clash", "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoding_is_the_library_s(docs, empty):
    lib = Tokenizer.from_file(WORD)
    rows = bpe_trie.encode_decode(docs, WORD).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert bpe_trie.encode_decode(empty, WORD).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_random_texts_are_split_and_merged_as_by_the_library(path):
    """Words of every kind of letter, all kinds of white space, special strings in either case; the second batch meets a full cache."""
    import pyarrow as pa

    rng, lib = random.Random(11), Tokenizer.from_file(path)
    texts = []
    for _ in range(400):
        words = ["".join(rng.choice("abcdeéßÅɄIİ'.,!?42½日\u0301 ") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 20))]
        gaps = [rng.choice([" ", " ", " ", "\n", "  ", " \n", "\n\n", "\t", "\r\n", "\xa0", "\x1c", "<|endoftext|>", " <|EndOfText|> "]) for _ in words]
        texts.append("".join(w + g for w, g in zip(words, gaps, strict=True)))
        texts.append(" ".join("".join(rng.choice("abcdeéßÅɄ'.,42") for _ in range(rng.randint(1, 9))) for _ in range(20)) + rng.choice(["", "\nlast line", "it's"]))
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    packed, trie = tokens.PackedIds(path), bpe_trie.TrieTexts(path)
    for _ in range(2):
        for rows, ids, bounds in packed.of(pa.array(texts)):
            assert all(ids[x:y].tolist() == want[k] for k, x, y in zip(rows, bounds, bounds[1:], strict=False))
        seen = 0
        for rows, ids, bounds, lines in trie.of(pa.array(texts)):
            seen += len(rows)
            assert all(ids[x:y].tolist() == want[k] for k, x, y in zip(rows, bounds, bounds[1:], strict=False))
            if path == WORD:
                assert all(line == lib.decode(want[k], skip_special_tokens=False) for k, line in zip(rows, lines.to_pylist(), strict=True))
        assert seen == len(texts)
    assert token_counts.Counts(path, token_counts.whole_tokens(path)).of(pa.array(texts)).tolist() == [*map(len, want)]


def test_pairs_of_tokens_stay_apart_as_the_merges_say():
    rng = random.Random(12)
    for path in (WORD, BYTE):
        trie = bpe_trie.TrieEncoder(tokens.load_bpe(path))
        inner = [k for k in trie.inner.values() if trie._stands(-1, k)]
        wrong = 0
        for _ in range(3000):
            a, b = rng.choice(inner), rng.choice(inner)
            core = trie.names[a] + trie.names[b]
            wrong += trie._stays_apart(a, b) != (trie.bpe.merge([*core]) == [trie.names[a], trie.names[b]])
        assert trie.timed and not wrong


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["normalizer"] = {"type": "NFKC"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="not known here"):
        tokens.Bpe(str(tmp_path / "other.json"))


def test_token_counts_are_the_library_s(docs, empty):
    lib = Tokenizer.from_file(BYTE)
    for r in token_counts.token_counts(docs, BYTE).collect():
        text = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(lib.encode(text, add_special_tokens=False).ids)) and r.over_limit == (r.n_tokens > 512)
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_whole_tokens_are_proven():
    bpe, lib = tokens.load_bpe(BYTE), Tokenizer.from_file(BYTE)
    proven = sorted(token_counts.whole_tokens(BYTE))
    assert len(proven) > 40_000 and all(len(bpe.merge(bpe.symbols(tokens.letters_of(w)))) == 1 for w in proven[::500])
    assert all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in proven[::500] if w.strip())


def test_packing_covers_each_token_once(docs, empty):
    lib = Tokenizer.from_file(BYTE)
    rows = packing.pack_documents(docs, BYTE).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 for r in rows)
    for k, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: (r.start, r.sequence_id))
        if k == 3:  # a repeated row is packed twice
            assert [(r.start, r.length, r.ids) for r in own[::2]] == [(r.start, r.length, r.ids) for r in own[1::2]]
            own = own[::2]
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        assert [i for r in own for i in r.ids] == ids and [r.start for r in own] == [sum(x.length for x in own[:j]) for j in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) and r.doc_tokens == len(ids) and 1 << r.bucket == r.length for r in own)
    assert packing.pack_documents(empty, BYTE).count() == 0 and packing.binary_pieces(1027, 1024) == [(0, 1024), (1024, 2), (1026, 1)]


def brute_classes(fps: dict[int, int], radius: int) -> dict[int, int]:
    parent = {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def test_simhash_classes(docs, empty):
    fps = {k: int.from_bytes(near_dedup.shingle_fingerprint(near_dedup.words_of(t), 3), "big") for k, t in enumerate(TEXTS)}
    want = brute_classes(fps, 2)
    rows = near_dedup.simhash_classes(docs).collect()
    assert len(rows) == len(TEXTS) + 1 and all((r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id]) for r in rows)
    assert near_dedup.simhash_classes(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 5, 7])
def test_hamming_links_are_complete(spark, radius):
    rng = random.Random(radius)
    fps = {}
    for k in range(300):
        base = fps[rng.randrange(k)] if k and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            base ^= 1 << rng.randrange(64)
        fps[k] = base
    nodes = spark.createDataFrame([(k, hamming.signed(v)) for k, v in fps.items()], "node long, fp long")
    got = {(r.a, r.b): r.distance for r in hamming.near_links(nodes, radius).collect()}
    assert got == {(a, b): d for a in fps for b in fps if a < b and (d := (fps[a] ^ fps[b]).bit_count()) <= radius}


def test_dense_groups_go_through_tables():
    import numpy as np

    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 12, 3000).astype(np.int64))
    pairs = lambda dense: {(min(i, j), max(i, j)) for a, b in hamming.near_pairs(fp, 2, dense) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert pairs(10) == pairs(10_000)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 380)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_near_duplicates_go(spark, empty):
    words = passage(9, 300).split()
    changed = lambda k: " ".join("edit" if j == 7 * k + 3 else w for j, w in enumerate(words))
    rows = [(0, passage(8, 200)), (1, " ".join(words)), (2, changed(1)), (3, changed(2)), (4, " ".join(words)), (5, passage(7, 100)), (6, None), (7, ""), (8, " ".join(words[:150]) + passage(6, 150)), (None, "alone")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, copy string")
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 1, 5, 6, 8, None}
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def kept_by_brute_force(texts: list[str]) -> set[int]:
    """Positions of the texts that stay: the first of each component of five-word-shingle links at Jaccard 0.8."""
    sets = [set(near_dedup.shingles(near_dedup.words_of(t), 5)) for t in texts]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if top[a] != top[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = [low if x == high else x for x in top]
    return set(top)


def kept_ids(spark, texts: list[str]) -> set[int]:
    return {r.doc_id for r in near_dedup.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_spellings_do_not_hide_near_copies(spark):
    texts = []
    for k in range(30):
        words = passage(1000 + k, 150).split()
        for at in (20, 90):
            edited = [f"edit{at}" if j == at else w for j, w in enumerate(words)]
            texts += [" ".join(edited), "  ".join(edited).upper()]
    assert kept_by_brute_force(texts) == set(range(0, 120, 4)) == kept_ids(spark, texts)


@pytest.mark.parametrize("n", [20, 60, 250])
def test_recall_of_near_copies_at_the_threshold(spark, n):
    """Pairs of which one has a block appended, with 0.8 to 0.81 of their shingles in common: 0.98 at least are found, for short texts too."""
    texts = []
    for k in range(200):
        words = passage(2000 + k, n)
        texts += [words, f"{words} {passage(5000 + k, (n - 4) // 4)}"]
    pairs = range(0, 400, 2)
    assert kept_by_brute_force(texts) == set(pairs)
    got = kept_ids(spark, texts)
    assert sum(k + 1 not in got for k in pairs) >= 196


def test_chains_and_large_groups_are_linked_whole(spark, monkeypatch):
    """Chains of edits, of which only neighbours are alike, among copies of one text; the second time key by key in rounds."""
    rng = random.Random(5)
    texts = []
    for k in range(4):
        words = passage(7000 + k, 200).split()
        for _ in range(25):
            words = [f"w{rng.randrange(10**6)}" if rng.random() < 0.012 else w for w in words]
            texts.append(" ".join(words))
        texts += [" ".join(f"v{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in words) for _ in range(25)]
    rng.shuffle(texts)
    want = kept_by_brute_force(texts)
    assert kept_ids(spark, texts) == want
    monkeypatch.setattr(near_dedup, "DIRECT", 0)
    monkeypatch.setattr(near_dedup, "SHARE", 3)
    assert kept_ids(spark, texts) == want


def test_repeats_are_cut(docs, empty):
    words = {k: (t or "").encode().split() for k, t in enumerate(TEXTS)}
    first: dict[tuple, int] = {}
    for k, w in words.items():
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), k)
    rows = substring_dedup.drop_repeats(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        w = words[r.doc_id]
        gone = {x for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < r.doc_id for x in range(j, j + 50)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert r.kept.encode().split() == kept.split() and (gone or r.kept == (TEXTS[r.doc_id] or ""))
    assert substring_dedup.drop_repeats(empty).count() == 0
    clashing = docs.select("doc_id", "text", F.lit(1).alias("id.x"), F.lit(2).alias("parts"), F.lit(3).alias("kept"))
    assert substring_dedup.drop_repeats(clashing).select("`id.x`", "parts").distinct().collect() == [(1, 2)]


def test_factors_are_what_their_sources_hold(spark):
    rng = random.Random(4)
    pool = [passage(8000 + k, 90).split() for k in range(6)]
    texts = []
    for _ in range(40):
        words: list[str] = []
        for _ in range(rng.randint(1, 5)):
            p, x = rng.choice(pool), rng.randrange(30)
            words += [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(4))] + p[x : x + rng.randint(45, 60)]
        texts.append(words)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    first: dict[tuple, int] = {}
    for k, w in enumerate(texts):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), k)
    want = {(k, x) for k, w in enumerate(texts) for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < k for x in range(j, j + 50)}
    rows = substring_dedup.factors(df).collect()
    assert len(rows) > 20 and {(r.id, x) for r in rows for x in range(r.start, r.start + r.length)} == want
    for r in rows:
        assert r.length >= 50 and r.source < r.id and texts[r.id][r.start : r.start + r.length] == texts[r.source][r.source_start : r.source_start + r.length]
    for r in substring_dedup.drop_repeats(df).collect():
        assert r.n_removed == sum(k == r.doc_id for k, _ in want)


def test_run_hashes_tell_runs_apart():
    import numpy as np

    h = np.random.default_rng(2).integers(0, 1 << 62, 200, dtype=np.uint64)
    h[100:160] = h[20:80]
    for n in (1, 2, 12, 50):
        runs = substring_dedup.run_hashes(h, n, substring_dedup.MULTIPLIERS[1])
        assert len(runs) == 200 - n + 1
        assert all((runs[i] == runs[j]) == (h[i : i + n] == h[j : j + n]).all() for i in range(len(runs)) for j in (i, min(i + 80, len(runs) - 1), (7 * i) % len(runs)))
    assert len(substring_dedup.run_hashes(h[:5], 50, 3)) == 0


def test_fingerprints_and_next_documents(docs, empty):
    fp = lambda t: near_dedup.word_fingerprint(near_dedup.words_of(t)).hex()
    found = fingerprints.fingerprint_documents(docs.dropDuplicates(["doc_id"]), parts=5)
    assert found.rdd.getNumPartitions() == 5
    rows = fingerprints.with_near_counts(found).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text, following = TEXTS[r.doc_id] or "", TEXTS[(r.doc_id + 1) % len(TEXTS)] or ""
        edited = fingerprints.edited_text(text, following)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp(text), fp(edited))
        assert r.near_next == 1 - (int(fp(text), 16) ^ int(fp(following), 16)).bit_count() / 64
    assert fingerprints.fingerprint_documents(empty).count() == 0
    assert fingerprints.edited_text("abcde", "x") == "abcx" and fingerprints.edited_text("abcde", "xyz") == "abcxy"


def test_next_documents_of_repeated_and_null_ids(spark):
    """Rows of one id follow each other in the order of their texts; null ids come first."""
    rows = [(None, "first of all"), (3, "b text"), (3, "a text"), (3, "a text"), (9, None), (-4, "minus")]
    order = [(None, "first of all"), (-4, "minus"), (3, "a text"), (3, "a text"), (3, "b text"), (9, "")]
    want = sorted((str(k), len(t), hashlib.sha256(fingerprints.edited_text(t, order[(j + 1) % 6][1]).encode()).hexdigest()) for j, (k, t) in enumerate(order))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 2, 8):
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in fingerprints.fingerprint_documents(df, parts=parts).collect()) == want


def test_search_within_the_radius_is_complete(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):
        x = rng.choice(fps)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    found = spark.createDataFrame([(k, hamming.signed(x)) for k, x in enumerate(fps)], "doc_id long, fp long")
    distance = lambda a, b: (fps[a] ^ fps[b]).bit_count()
    pairs = {(hamming.signed(fps[a]), hamming.signed(fps[b])): distance(a, b) for a in range(0, len(fps), 50) for b in range(len(fps)) if distance(a, b) <= 3}
    assert {(r.query, r.fp): r.distance for r in fingerprints.within_radius(found.where("doc_id % 50 = 0"), found).collect()} == pairs
    for r in fingerprints.with_near_counts(found).collect():
        assert r.n_near == (sum(distance(r.doc_id, b) <= 3 for b in range(len(fps))) - 1 if r.doc_id % 50 == 0 else None)


def test_media_round_trip_and_damage(docs, spark):
    for r in media_mpeg.media_digests(media_mpeg.store_texts(docs)).collect():
        payload = media_mpeg.padded(TEXTS[r.doc_id] or "")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    data = media_mpeg.write_audio(b"abc" * 3000)
    whole = media_mpeg.read_audio(data)
    assert whole.wrong == 0 and whole.table["frames"] == len(whole.offsets) and whole.samples == 1152 * len(whole.offsets)
    cut = data[: whole.offsets[2] + 100] + b"\0garbage\xff\x00" + data[whole.offsets[3] :] + b"TAG" + b"Title".ljust(125, b"\0")
    hurt = media_mpeg.read_audio(cut)
    assert hurt.resyncs == 1 and len(hurt.offsets) == len(whole.offsets) - 1 and hurt.tags["TIT2"] == "Title"
    flipped = bytearray(data)
    flipped[whole.offsets[1] + 10] ^= 1
    assert media_mpeg.read_audio(bytes(flipped)).wrong == 1 and media_mpeg.read_audio(b"").offsets == [] and media_mpeg.read_audio(b"no audio at all").offsets == []
    media = media_mpeg.store_texts(docs).withColumns({"audio": F.lit("own"), "a.b": F.lit(1)})
    read = media_mpeg.read_media(media)
    audio = read.select("audio").first().audio
    assert audio.duration_us == audio.samples * 1_000_000 // audio.rate and audio.table_agrees and read.columns == ["doc_id", "n_bytes", "media", "a.b", "audio"]
    foreign = spark.createDataFrame([(1, 0, None), (2, 3, b"abc"), (3, 0, bytes(data[: whole.offsets[1]]))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media_mpeg.media_digests(foreign).collect()}
    assert (got[1].media_bytes, got[1].feature, got[2].media_bytes, got[2].payload_bytes) == (None, None, 3, None) and got[3].media_sha256 == hashlib.sha256(data[: whole.offsets[1]]).hexdigest()
    assert media_mpeg.media_digests(media_mpeg.store_texts(docs.limit(0))).count() == 0


def test_foreign_frames_by_hand():
    """Frames put together bit by bit: layers I to III, a change of rate, checksums over the allocation, a seek table that lies."""

    def crc(bits: str) -> int:
        value = 0xFFFF
        for b in bits:
            value = (value << 1) & 0x1FFFF
            value = (value & 0xFFFF) ^ (0x8005 if (value >> 16) ^ int(b) else 0)
        return value

    def frame(header: bytes, size: int, covered: str) -> bytes:
        bits = "".join(f"{b:08b}" for b in header[2:4]) + covered
        body = int(covered.ljust(-(-len(covered) // 8) * 8, "0"), 2).to_bytes(-(-len(covered) // 8), "big") if covered else b""
        return (header + struct.pack(">H", crc(bits)) + body).ljust(size, b"\x55")

    rng = random.Random(3)
    # layer I, 44.1 kHz, 128 kbit/s, mono: 32 allocations of 4 bits; 12 * 128000 / 44100 = 34 slots of 4 bytes
    one = [frame(b"\xff\xfe\x40\xc0", 136, "".join(f"{rng.randrange(15):04b}" for _ in range(32))) for _ in range(5)]
    # layer II, 48 kHz, 64 kbit/s, mono: 27 subbands of 4, 3 and 2 bits, two more bits for each that is used; 144 * 64000 / 48000 = 192 bytes
    two = []
    for _ in range(4):
        widths = [4] * 11 + [3] * 12 + [2] * 4
        values = [rng.choice([0, 1, 2]) for _ in widths]
        two.append(frame(b"\xff\xfc\x44\xc0", 192, "".join(f"{v:0{w}b}" for v, w in zip(values, widths, strict=True)) + "10" * sum(map(bool, values))))
    audio = media_mpeg.read_audio(b"".join(one + two))
    assert (len(audio.offsets), audio.checked, audio.wrong, audio.samples) == (9, 9, 0, 5 * 384 + 4 * 1152)
    assert audio.duration_us == int(5 * 384 * 1_000_000 / 44100 + 4 * 1152 * 1_000_000 / 48000) and audio.offsets == [0, 136, 272, 408, 544, 680, 872, 1064, 1256]
    for hurt in (one[2][:8] + bytes([one[2][8] ^ 16]) + one[2][9:], two[1][:7] + bytes([two[1][7] ^ 1]) + two[1][8:]):
        other = [hurt if f in (one[2],) and len(hurt) == 136 else hurt if f == two[1] and len(hurt) == 192 else f for f in one + two]
        assert media_mpeg.read_audio(b"".join(other)).wrong == 1
    data = bytearray(media_mpeg.write_audio(b"x" * 50_000))
    assert media_mpeg.read_audio(bytes(data)).table_agrees
    at = data.index(b"Xing") + 16
    data[at + 50] ^= 64
    assert not media_mpeg.read_audio(bytes(data)).table_agrees


def test_warc_links_and_files(spark):
    html = "<html><head><title>T &amp; U</title><style>x</style></head><body><p>One</p><p>Two <b>three</b></p><a href='/x'>l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a.de/", html, "clash"), (2, None, None, "clash"), (3, "http://b.de/", "", "clash")], "page_id long, url string, html string, block string")
    sources = {r.page_id: r for r in warc.responses(pages).collect()}
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.headers["WARC-Refers-To"] == sources[r.page_id].record_id and r.headers["WARC-Source-Payload-Digest"] == sources[r.page_id].headers["WARC-Payload-Digest"] and r.headers["WARC-Block-Digest"] == warc.digest(bytes(r.block))
    text = {(r.page_id, r.record_type): bytes(r.block).decode() for r in rows}
    assert text[1, "conversion"] == "T & U\nOne\nTwo three\nl" and "outlink: /x a/@href" in text[1, "metadata"] and "http-header-content-type: text/html; charset=utf-8" in text[1, "metadata"]
    import tempfile

    path = tempfile.mkdtemp(dir="/tmp", prefix="spark-") + "/w"
    warc.write_warc(warc.derive(warc.responses(pages)), path)
    back = warc.read_warc(spark, path)
    assert {(r.record_id, bytes(r.block)) for r in back.collect()} == {(r.record_id, bytes(r.block)) for r in rows}


def test_foreign_warc_files(spark, tmp_path):
    """Files put together by hand: both versions, a gzip member for each record, binary blocks, a block that looks like a record, bad lengths, encodings."""
    import gzip

    def record(version: str, block: bytes, size: str | None = None, kind: str = "response") -> bytes:
        return f"WARC/{version}\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:{zlib.crc32(block)}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://a.de/\r\nContent-Length: {len(block) if size is None else size}\r\n\r\n".encode() + block + b"\r\n\r\n"

    page = "<title>Größe</title><p>Ünïcode</p>".encode("latin-1")
    packed = gzip.compress(page)
    chunks = b"".join(f"{len(packed[k : k + 20]):x}\r\n".encode() + packed[k : k + 20] + b"\r\n" for k in range(0, len(packed), 20)) + b"0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks
    blocks = [http, bytes(range(256)), b"text\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n", b"", page]
    (tmp_path / "plain.warc").write_bytes(b"".join(record("1.0", b) for b in blocks))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(record("1.1", b)) for b in blocks))
    (tmp_path / "broken.warc").write_bytes(record("1.1", b"one") + record("1.1", b"two", "many") + record("1.0", b"three"))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.block) for r in rows if r.record_type == "response") == sorted([*blocks, *blocks, b"one", b"three"])
    assert [b"two" in bytes(r.block) for r in rows if r.record_type == "broken"] == [True]
    found = warc.derive(warc.read_warc(spark, str(tmp_path)).withColumn("page_id", F.lit(1))).where("record_type = 'conversion'").collect()
    assert len(found) == 12 and sum(bytes(r.block).decode() == "Größe\nÜnïcode" for r in found) == 2
    assert warc.entity(b"no chunk", [("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")]) == b"no chunk"


def test_licenses(spark, empty):
    mit = licenses.TEMPLATES["MIT"].split()
    texts = [None, "", passage(4, 500) + "\nReleased under the MIT License.\n" + passage(5, 300), " ".join(mit[:45] + ["changed"] + mit[46:]), " ".join(mit[:20]), passage(6, 3000), "Licensed under the Apache License, Version 2.0."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}
    assert got == {0: "", 1: "", 2: "MIT-notice", 3: "MIT", 4: "", 5: "", 6: "Apache-2.0-notice"}
    assert licenses.scan_licenses(empty).count() == 0


HEADERS = [n for n in licenses.TEMPLATES if n.endswith("-header")]


@pytest.mark.parametrize("name", [*HEADERS, "BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "MPL-2.0"])
def test_versions_and_variants_are_told_apart(name):
    index = licenses.TemplateIndex(licenses.TEMPLATES, 0.8, 1e-5, 128)
    for text in (licenses.TEMPLATES[name], f"{passage(60, 70)} {licenses.TEMPLATES[name]} {passage(61, 90)}"):
        found = index.scan([licenses.shingle_hashes(licenses.license_words(text))])[0]
        assert [index.names[t] for t, *_ in licenses.told_apart(found, index.sizes)] == [name]


def test_license_hits_against_every_window():
    """Templates with edits at random places of long texts: what the bands find is what a scan of every window finds."""
    rng = random.Random(13)
    index = licenses.TemplateIndex(licenses.TEMPLATES, 0.8, 1e-5, 128)
    texts = []
    for k in range(150):
        words = passage(9000 + k, rng.randrange(400)).split()
        for _ in range(rng.randint(0, 3)):
            own = licenses.TEMPLATES[rng.choice(index.names)].split()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own
        texts.append(" ".join(words))
    hashes = [licenses.shingle_hashes(licenses.license_words(t)) for t in texts]
    found, missed, total = index.scan(hashes), 0, 0
    for h, got in zip(hashes, found, strict=True):
        shingles = h.tolist()
        for t, own in enumerate(index.sets):
            best = max((len(own.intersection(shingles[k : k + index.sizes[t] + 10])) / len(own) for k in range(len(shingles))), default=0)
            total += best >= 0.8
            missed += best >= 0.8 and t not in {x[0] for x in got}
        assert all(share >= 0.8 and len(index.sets[t].intersection(shingles)) >= 0.8 * len(index.sets[t]) for t, share, _, _ in got)
    assert total > 200 and not missed


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no license texts on this machine")
def test_full_bodies_are_templates_too():
    bodies = licenses.read_templates("/usr/share/common-licenses")
    index = licenses.TemplateIndex(bodies, 0.8, 1e-5, 128)
    for name in ("GPL-2", "GPL-3", "LGPL-2.1", "Apache-2.0", "MPL-2.0"):
        found = index.scan([licenses.shingle_hashes(licenses.license_words(f"{passage(70, 300)} {bodies[name]} {passage(71, 200)}"))])[0]
        assert [index.names[t] for t, *_ in licenses.told_apart(found, index.sizes)] == [name]


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(5)
    bad = ["vile", "rotten", "nasty", "foul", "wretch"]
    rows = []
    for k in range(600):
        words = passage(k, 60).split()
        toxic = k % 4 == 0
        for _ in range(rng.randint(2, 6) if toxic else 0):
            words.insert(rng.randrange(60), rng.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 400], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert model.thresholds == sorted(model.thresholds)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum(found[k].toxic == bool(t) for k, _, t in rows if k >= 400) >= 196
    assert found[400].severity > found[401].severity and found[400].grade >= 1
    nothing = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, nothing).where("toxic").count() == 0 and toxicity.score_toxicity(empty, model).count() == 0


def test_ordinal_fit_is_the_best_of_its_likelihood():
    """The penalised likelihood, written out row by row, has no slope at the fitted values; scores are sums of the features' weights."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (300, 6))
    grades = np.clip((x @ np.array([2, 1, 0, -1, 0, 1]) + rng.normal(0, 1, 300)).round(), 0, 3).astype(int)
    rows, cols = np.nonzero(x)
    weights, thresholds = toxicity.fit_ordinal(rows, cols, grades, 6, steps=3000)

    def loss(w, t):
        total = 0.5 * (w**2).sum()
        for own, g in zip(x, grades, strict=True):
            above = [1.0, *[1 / (1 + np.exp(-(own @ w - k))) for k in t], 0.0]
            total -= np.log(above[g] - above[g + 1])
        return total

    for k in range(6):
        step = np.eye(6)[k] * 1e-4
        assert abs(loss(weights + step, thresholds) - loss(weights - step, thresholds)) / 2e-4 < 0.5
    assert loss(weights, thresholds) < min(loss(weights * 0.9, thresholds), loss(weights * 1.1, thresholds), loss(weights, thresholds + 0.1), loss(weights, thresholds - 0.1))
    model = toxicity.OrdinalModel({b"=vile": 2.0, b"^rotte": 1.0, b"=rotten": 0.5}, [1.0, 2.0])
    assert model.score("Vile, ROTTEN vile!") == 3.5 and model.at_least(1.0)[0] == 0.5


def test_grades_follow_scores_that_have_not_seen_the_row():
    import numpy as np

    rng = np.random.default_rng(6)
    toxic = np.arange(600) % 3 == 0
    x = (rng.random((600, 8)) < np.where(toxic[:, None], 0.55, 0.1)).astype(int)
    rows, cols = np.nonzero(x)
    grades = toxicity.severity_grades(rows, cols, toxic.astype(int), 8)
    assert set(grades[~toxic]) == {0} and set(grades[toxic]) == {1, 2, 3}
    held = x[toxic].sum(axis=1)
    assert held[grades[toxic] == 3].mean() > held[grades[toxic] == 2].mean() > held[grades[toxic] == 1].mean()
    tied = toxicity.severity_grades(np.repeat(np.arange(6), 1), np.zeros(6, int), np.array([1, 1, 1, 1, 0, 0]), 1)
    assert tied.tolist() == [1, 1, 1, 1, 0, 0]


def test_pipeline_keeps_what_it_should(spark):
    import tempfile

    import corpus_pipeline

    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    base, other = passage(21, 120), passage(22, 120)
    texts = [base, base, passage(23, 90) + "\n" + other, passage(24, 90) + " " + other, "short clean text", *["vile rotten " + passage(30 + k, 40) for k in range(8)], *[passage(50 + k, 40) for k in range(8)]]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(5 <= k < 13)) for k in range(3, 21)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
        clashing = stage(spark, docs.withColumns({c: F.lit("own") for c in ("toxic", "kept", "row", "id.x", "rest", "_copy")}), folder)
        assert clashing.select("toxic", "kept", "row", "`id.x`", "rest", "_copy").distinct().collect() == [("own",) * 6]
    left = {r.doc_id: r.text for r in kept.collect()}
    assert set(left) == {0, 2, 3, 4, *range(13, 21)} and left[3] == passage(24, 90) and left[2] == texts[2]
    packed = corpus_pipeline.run(spark, folder)
    lib = Tokenizer.from_file(BYTE)
    total = packed.groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {r.doc_id: r.n for r in total.collect()} == {k: len(lib.encode(t, add_special_tokens=False).ids) + 1 for k, t in left.items()}


def test_only_nodes_of_long_lists_have_their_shingles_sorted(spark, monkeypatch):
    """Short lists are met through even if long ones give too many pairs; no link is lost either way."""
    rng = random.Random(3)
    word = lambda n: f"w{n}"
    head = [word(rng.randrange(10**6)) for _ in range(60)]
    texts = {}
    for k in range(60):  # one long passage in all: long lists, few links
        texts[k] = head + [word(rng.randrange(10**6)) for _ in range(25)]
    for k in range(60, 120, 2):  # pairs of near copies: short lists
        texts[k] = [word(rng.randrange(10**6)) for _ in range(80)]
        texts[k + 1] = [*texts[k][:-2], word(rng.randrange(10**6)), "end"]
    texts[120] = [*texts[7][:-1], "end"]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string").repartition(3)
    asked = []

    def across(nodes, *rest):
        asked.append({r.node for r in nodes.collect()})
        return sorted_shingles(nodes, *rest)

    sorted_shingles = near_dedup.across_groups
    monkeypatch.setattr(near_dedup, "across_groups", across)
    monkeypatch.setattr(near_dedup, "DIRECT", 0.5)
    got = {r.doc_id: r.component_id for r in inverted_join.minhash_classes(docs).collect()}
    sets = {k: {tuple(t[i : i + 3]) for i in range(len(t) - 2)} for k, t in texts.items()}
    root = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low = min(root[a], root[b])
                root |= {k: low for k in root if root[k] in (root[a], root[b])}
    assert got == root and len(set(root.values())) == 90
    assert asked and not asked[-1] & set(range(60, 120))
