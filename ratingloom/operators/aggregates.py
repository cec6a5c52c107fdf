"""Totals of a ratings table. Every sum is a partial sum in the scan task, then a final one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_totals(ratings: DataFrame) -> DataFrame:
    """Sum of the ratings a user gave: ``(user, total)``."""
    return ratings.groupBy("user").agg(F.sum("rating").cast("bigint").alias("total"))


def item_totals(ratings: DataFrame) -> DataFrame:
    """Sum of the ratings an item received: ``(item, total)``."""
    return ratings.groupBy("item").agg(F.sum("rating").cast("bigint").alias("total"))


def global_total(ratings: DataFrame) -> DataFrame:
    """Sum of all ratings, one row."""
    return ratings.agg(F.sum("rating").cast("bigint").alias("total"))


def item_probs(ratings: DataFrame) -> DataFrame:
    """Collection probability of an item, its share of all rating points: ``(item, p)``."""
    items = item_totals(ratings)
    everything = items.agg(F.sum("total").alias("total"))
    return items.select("item", (F.col("total") / everything.scalar()).alias("p"))


def id_cardinalities(ratings: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct users and items, one row; a sketch instead of exact counts on request."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return ratings.agg(count("user").alias("n_users"), count("item").alias("n_items"))
