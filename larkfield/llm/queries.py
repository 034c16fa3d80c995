"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_trie import encode_decode
from .common import checkpoint, documents, stored, text_or_empty
from .fingerprints import fingerprint_documents, with_near_counts
from .inverted_join import minhash_classes
from .licenses import scan_licenses
from .media_mpeg import media_digests, store_texts
from .near_dedup import simhash_classes
from .packing import pack_documents
from .periodic_runs import periodic_runs
from .spellings import count_words, group_spellings
from .substring_dedup import drop_repeats
from .token_counts import token_counts
from .toxicity import fit_toxicity, score_toxicity
from .warc import derive, responses

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), with_values=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", "severity", "grade", "toxic")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), with_ids=False)


def op4_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpoint(fingerprint_documents(documents(spark, sf_dir)))
    return with_near_counts(found).drop("fp")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op8_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(stored(store_texts(documents(spark, sf_dir))))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    named = {k: F.col("headers")[v] for k, v in {"refers_to": "WARC-Refers-To", "refers_to_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date", "block_digest": "WARC-Block-Digest", "source_digest": "WARC-Source-Payload-Digest"}.items()}
    return records.select("page_id", "record_type", "record_id", "target_uri", "content_type", *[c.alias(k) for k, c in named.items()], F.length("block").cast("long").alias("content_length"), F.sha2("block", 256).alias("block_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("hits")


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(documents(spark, sf_dir))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose id has a CRC-32 divisible by ten repeat words from one place on; the others are as they are."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    words = F.filter(F.split(text_or_empty(), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    planted = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(with_planted_repeats(documents(spark, sf_dir))).drop("text", "runs", "collapsed")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(count_words(documents(spark, sf_dir), drop_of=97))


QUERIES = (
    op1_bpe_encode_decode,
    op2_toxicity,
    op3_packing,
    op4_simhash_fingerprints,
    op5_simhash_near_dedup,
    op6_substring_dedup,
    op7_token_counts,
    op8_mpeg_media,
    op9_warc_derivatives,
    op10_license_scan,
    op11_minhash_near_dedup,
    op12_periodic_runs,
    op13_spelling_variants,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: All pairs of texts with a common shingle, and all that a text reaches over links.
MINHASH_SQL = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
p AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others cannot be written in SQL that ends in time; tests compare them with brute force."""
    return {"op11_minhash_near_dedup": MINHASH_SQL}
