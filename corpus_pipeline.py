"""From raw documents to training token files, in five stages.

A stage takes the documents its predecessor kept. All but the last return documents with their
columns; the last writes the token files and returns what they hold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from topiclens.llm.decontamination import drop_leaks
from topiclens.llm.mixing import mixed
from topiclens.llm.similar_texts import drop_similar
from topiclens.llm.token_files import read_token_files, write_token_files
from topiclens.llm.toxicity import drop_toxic
from topiclens.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score below 0.3)."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar at 0.8 or more, found by SimHash and then by bands."""
    return drop_similar(docs, k=5, threshold=0.8, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice comes twice."""
    return mixed(docs, weights=(3, 1, 2), ratio=1.5, most=2)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_files", token_files),
]
#: The classifier, fingerprints and token ids have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
