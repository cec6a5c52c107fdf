"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

quality rules, toxicity, near-duplicates, mixing, encoding. Every stage works on all that the one
before it kept, and all but the last return the columns of ``documents``. Learnt scores have no SQL,
so the tests compare :func:`run` with a plain version in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm import bpe, hosts, minhash, mixing, toxicity
from ratingloom.session import scratch_path

#: Two documents are near-duplicates from this similarity on, in percent (``op8_minhash`` has its own).
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the rules, and those of rejected hosts."""
    return hosts.keep(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents, by labels of the documents that are still there."""
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return minhash.keep(docs, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's share of the mix asks."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of every row of the mix, and of what they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("near-duplicates", distinct),
    ("mixing", mix),
    ("encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, with a Parquet table between each two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
