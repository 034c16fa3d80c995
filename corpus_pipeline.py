"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept, and calls one operator of ``larkfield.llm``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.llm.common import columns, stored
from larkfield.llm.near_dedup import drop_near_duplicates
from larkfield.llm.packing import pack_documents
from larkfield.llm.substring_dedup import drop_repeats
from larkfield.llm.toxicity import fit_toxicity, score_toxicity


#: The only field of ``rest`` where a table has no other columns.
ONLY = "no other column"


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all other columns in one, so that their names cannot meet those that an operator adds."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*columns(rest)).alias("rest") if rest else F.struct(F.lit(None).cast("int").alias(ONLY)).alias("rest"))


def unpacked(docs: DataFrame) -> DataFrame:
    names = [c for c in docs.schema["rest"].dataType.names if c != ONLY]
    return docs.select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in names])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model finds toxic go."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(score_toxicity(packed(docs), model).where("not toxic")).select(*columns(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller id has too are cut out; a document of which nothing is left goes."""
    cut = drop_repeats(packed(docs)).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    rest = F.when(changed, F.col("rest").withField("n_chars", F.length("kept").cast("long"))).otherwise(F.col("rest")) if "n_chars" in docs.columns else F.col("rest")
    return unpacked(cut.withColumns({"text": text, "rest": rest})).select(*columns(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents' tokens, each one training sequence."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a Parquet table in the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs), sf_dir)
    return docs
