"""A training-data pipeline over documents: each stage filters or rewrites what the one before kept.

language (drops texts without a language), near (keeps one document of each near-duplicate
group), repeats (cuts passages that an earlier document has), secrets (masks credentials), pack
(tokenises and packs what is left). Stages are written as Parquet to the shared folder in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusfold.llm import langid, minhash, packing, secrets, suffix
from locusfold.llm.common import materialize
from locusfold.llm.queries import PACK_TOKENIZER, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.strip_repeats(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(PACK_TOKENIZER))


STAGES = [("language", language), ("near", near), ("repeats", repeats), ("secrets", mask), ("pack", pack)]

#: SQL cannot express the learnt classifier and the tokenizer; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
