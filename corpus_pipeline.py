"""A training-data pipeline of five operators. Each stage reads the documents that the stage before has written.

Languages: documents without letters or mostly in no one language go. Near duplicates: one document of each group stays.
Personal data: every span found is masked in the text. Mixing: each text becomes the words that the mix takes of it (twice, where the
mix repeats them); documents of which it takes nothing go. Encoding: token ids of the texts, decoded again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relinker.llm import bpe, langid, minhash, mixing, pii
from relinker.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.distinct_documents(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every mixed document."""
    ids = bpe.encode(docs, bpe.tokenizer_path("word_bpe_49k.json"))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("encoded", encoded),
]

# Fields, sketches, permutations and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
