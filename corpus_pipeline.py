"""The corpus pipeline: toxicity, line deduplication, near-duplicates, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it. All but the last return
the columns of ``documents``. Empty inputs pass through all stages; what a stage does with null ids, null or blank texts
and repeated rows is said at its operator.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hourgrid.llm import bpe_tree, decontaminate, line_dedup, simhash_trie, toxicity
from hourgrid.llm.common import new_path
from hourgrid.session import ship_package

RANKS = "byte_bpe_multi_50k.tiktoken"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays; documents with nothing left go."""
    ship_package(spark)
    return line_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    ship_package(spark)
    return simhash_trie.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and digests of ids and of the bytes they decode to."""
    ship_package(spark)
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe_tree.round_trip(docs, path, pattern)


STAGES = [("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("near_duplicates", without_near_copies),
          ("decontamination", without_benchmark), ("tokens", tokens)]
# SQL cannot express a learned classifier, MinHash sketches, an SVD or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
