"""Numbers of distinct ids from sketches that can be stored and merged.

A theta sketch keeps the smallest hashes of the ids it has seen, ``2**LG`` of them at least. Up to that many
ids it counts exactly; beyond, its relative standard error is ``2**(-LG / 2)``. Sketches of
files, days or tasks merge to the sketch of all their rows, so a new file is sketched alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the hashes kept: exact to 65,536 ids, 0.4 % beyond, half a megabyte at most.
LG = 16
COLUMNS = ("user", "item")


def sketch(ratings: DataFrame, part: Column, lg: int = LG) -> DataFrame:
    """One row per part: ``(part, n_rows, users, items)``. Tasks sketch their rows before the shuffle."""
    return ratings.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.theta_sketch_agg(c, lg).alias(f"{c}s") for c in COLUMNS]
    )


def merge(sketches: DataFrame, lg: int = LG) -> DataFrame:
    """One row of all parts: ``(n_rows, users, items)``."""
    return sketches.agg(
        F.sum("n_rows").alias("n_rows"), *[F.theta_union_agg(f"{c}s", lg).alias(f"{c}s") for c in COLUMNS]
    )


def cardinalities(sketches: DataFrame, lg: int = LG) -> DataFrame:
    """Numbers of distinct users and items over all parts, one row: ``(n_users, n_items)``."""
    merged = merge(sketches, lg)
    return merged.select(*[F.theta_sketch_estimate(f"{c}s").cast("bigint").alias(f"n_{c}s") for c in COLUMNS])
