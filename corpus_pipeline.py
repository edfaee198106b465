"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes every row that the one before it kept. A null text counts as empty and goes with language ID, as a text without
letters does; null sources are a source of their own; rows without an id go through, equal ones by their text. Of equal texts the
longest original stays, then the smallest id, then the first row, so repeated rows are one; of near copies one row of each group stays. An empty
table gives an empty result. Extra columns go through to the mix, whatever their names; packing gives pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import exact_dedup, language_id, mixing, packing, simhash
from loomline.llm.common import materialise
from loomline.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs).drop("__shard", "__turn")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer())


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]
#: Fingerprints, hashed draws and tokens are beyond SQL: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
