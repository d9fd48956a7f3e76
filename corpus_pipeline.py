"""The corpus pipeline: quality rules, language ID, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns
of documents; the last returns where each piece of each document was packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataloom.functions.runtime import share_package
from strataloom.llm import language_id, packing, pii, quality_rules, simhash
from strataloom.llm.common import materialise

#: Mean probability below which a text's language counts as unknown.
LEAST_LANGUAGE_SCORE = 0.3
#: Tokens of a training sequence.
SEQUENCE = 2048


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep; labels come from the labels table."""
    share_package(spark)
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was recognised."""
    share_package(spark)
    return language_id.keep_known(docs, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id, one without doc_id if there is no other."""
    share_package(spark)
    return simhash.keep_one(docs, unnamed=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    share_package(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in training sequences of SEQUENCE tokens."""
    share_package(spark)
    return packing.pack_documents(docs, SEQUENCE, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good_quality),
    ("language ID", known_language),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: The stages learn, so SQL can't express them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = share_package(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
