"""Ratings and other inputs as views over the test tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.session import scratch_path

# The rating an event type stands for.
EVENT_RATINGS = {"error": 1, "view": 2, "click": 3, "signup": 4}
OTHER_RATING = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical ratings from the event stream table."""
    rating = F.lit(None).cast("int")
    for i, (kind, value) in enumerate(EVENT_RATINGS.items()):
        test = F.col("event_type") == kind
        rating = F.when(test, value) if i == 0 else rating.when(test, value)
    return table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").cast("int").alias("item"),
        F.col("user_id").cast("int").alias("user"),
        rating.otherwise(OTHER_RATING).alias("rating"),
        F.col("event_id").alias("seq"),
    )


def ratings_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings from order lines; ``seq`` is not unique here."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").cast("int").alias("item"),
        F.col("o_custkey").cast("int").alias("user"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("rating"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide dense vectors: ``(id, v)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    )


def write_block_files(ratings: DataFrame, label: str = "blocks") -> str:
    """Write ratings as block text in the order of (item, seq); returns the path.

    The files take ranges of items, so that their names are in item order, however many there are.
    """
    path = scratch_path(ratings.sparkSession, label)
    heads = ratings.select("item").distinct().select(
        "item", F.lit(-1).cast("bigint").alias("seq"),
        F.concat(F.col("item").cast("string"), F.lit(":")).alias("value"),
    )
    lines = ratings.select(
        "item", "seq", F.concat_ws(",", "user", "rating", F.lit("2005-01-01")).alias("value")
    )
    (
        heads.union(lines).repartitionByRange("item").sortWithinPartitions("item", "seq")
        .select("value").write.text(path)
    )
    return path
