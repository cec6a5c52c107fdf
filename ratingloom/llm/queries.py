"""The corpus operators as registered queries: whole tables in, full results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ratingloom.llm import (
    bpe, embeddings, hosts, langid, lexicon, minhash, mixing, negatives, periods, sharding, tokens, toxicity, warc,
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line signals, the base rule, and the verdict on the document's source."""
    judged = hosts.judge(read(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_failed", "kept",
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the embeddings."""
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from each document so that the sources meet their target weights."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learnt from the rows that are not held out."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the bytes that they decode to."""
    return bpe.digests(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    return warc.round_trip(read(spark, sf_dir, "pages")).drop("url")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labels that are not held out."""
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the documents."""
    return minhash.groups(read(spark, sf_dir, "documents"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files in ORC, written in document order and read back."""
    return tokens.round_trip(read(spark, sf_dir, "documents"))


def op10_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, and its shard when one more is added."""
    return sharding.place(read(spark, sf_dir, "documents"), shards=40)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in the documents, of which every tenth ends in a planted one."""
    return periods.digests(periods.runs(read(spark, sf_dir, "documents"), periods.repeat_tail))


def op12_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids by a lexicon of the corpus, and of the text that they decode to."""
    return lexicon.digests(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of other labels in a window under each positive of every fiftieth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), every=50, label=label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_host_quality, op2_language, op3_byte_bpe, op4_embedding_dedup, op5_mix_sources, op6_warc,
        op7_toxicity, op8_minhash, op9_token_orc, op10_shard_tree, op11_periodic_runs,
        op12_lexicon_bpe, op13_hard_negatives, pipeline,
    )
}
