"""The corpus pipeline: five stages over `documents`, each on all that its predecessor kept.

STAGES lists (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read back as the next
stage's docs. All but the last return the columns of documents; the last adds token_ids and n_tokens. The written tables and those
of the operators stay until `textkit.discard`, for the result reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremorline.llm import langid, mixing, paragraphs, pieces, simhash
from tremorline.llm import textkit as K


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs.select("doc_id", "text", "lang", "source", "n_chars"))


STAGES = [
    ("language_id", langid.filter_stage),
    ("simhash_near_dedup", simhash.dedup_stage),
    ("substring_dedup", paragraphs.dedup_stage),
    ("mixing", mixing.mix_stage),
    ("sentencepiece", encode),
]

#: SQL cannot express the first three stages or the last; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    path = K.fresh(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
