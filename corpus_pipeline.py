"""The corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

Rows are judged one by one: a repeated doc_id with another text is another document, and a null doc_id stays what it is.
Null and empty texts pass as documents without words, of which the near-duplicate stage keeps one. Empty tables give empty
results; without labels nothing is called toxic. Mixing without repetition can only take rows away: its stage keeps 95 % of the
tokens, so rows of sources that stand out go, clean or not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from fieldloom.llm._shared import shared_root, table

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
