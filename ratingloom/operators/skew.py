"""Joins that stay balanced when one key holds a large share of the rows.

A key is *heavy* when it holds more than ``min_rows`` rows and more than 1/``MAX_HEAVY`` of the table.
Fewer than ``MAX_HEAVY`` keys of a column can be, so the list of a column is complete and stays small
enough to collect and broadcast at any data size. All rows are kept; the rows of heavy keys are only
spread over more partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.session import discard, fits_broadcast, materialize

MAX_HEAVY = 100_000
MIN_ROWS = 1_000_000


@dataclass
class KeyStats:
    """Distinct values of a key column, its heavy values ``(key, n_salts)`` if there are any, and the
    rows of the table."""

    n_ids: int
    heavy: DataFrame | None
    rows: int = 0


def key_stats(df: DataFrame, keys: list[str], min_rows: int = MIN_ROWS) -> dict[str, KeyStats]:
    """Statistics of the key columns, from one pass over these columns only.

    The counts are written, as one reading tells whether there are heavy keys and another lists them.
    """
    spark = df.sparkSession
    slots = [
        F.struct(F.lit(i).alias("slot"), F.col(key).cast("bigint").alias("value"))
        for i, key in enumerate(keys)
    ]
    counts = (
        df.select(F.explode(F.array(*slots)).alias("t"))
        .groupBy("t.slot", "t.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = materialize(counts, "key-counts")
    sizes = counts.groupBy("slot").agg(
        F.count(F.lit(1)).alias("n_ids"), F.max("n").alias("most"), F.sum("n").alias("rows")
    )
    found = {r["slot"]: r for r in sizes.collect()}
    # Every slot counts all rows of the table, so one limit holds for all of them.
    limit = max([min_rows, *(r["rows"] // MAX_HEAVY for r in found.values())])
    heavy = []
    if any(r["most"] > limit for r in found.values()):
        heavy = (
            counts.where(F.col("n") > limit)
            .select("slot", "value", F.ceil(F.col("n") / limit).cast("int").alias("n_salts"))
            .collect()
        )
    out = {}
    for i, key in enumerate(keys):
        mine = [(r["value"], r["n_salts"]) for r in heavy if r["slot"] == i]
        table = None
        if mine:
            table = spark.createDataFrame(mine, f"{key} bigint, n_salts int").withColumn(
                key, F.col(key).cast(df.schema[key].dataType)
            )
        seen = found.get(i)
        out[key] = KeyStats(seen["n_ids"], table, seen["rows"]) if seen else KeyStats(0, table)
    discard(counts)
    return out


def with_slice(df: DataFrame, key: str, heavy: DataFrame, spread: Column) -> DataFrame:
    """Add ``slice``: 0 for ordinary keys, a stable number below ``n_salts`` for heavy ones."""
    return (
        df.join(F.broadcast(heavy), key, "left")
        .withColumn(
            "slice", F.coalesce(F.pmod(F.xxhash64(spread), F.col("n_salts")), F.lit(0)).cast("int")
        )
        .drop("n_salts")
    )


def all_slices(df: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """One copy of a row per slice of its key: heavy keys are repeated, the others are not."""
    return (
        df.join(F.broadcast(heavy), key, "left")
        .withColumn(
            "slice", F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1))
        )
        .drop("n_salts")
    )


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    spread: Column,
    table_rows: int | None = None,
    row_bytes: int = 64,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Join facts with a table that has one row per key.

    A table with a known row count that fits is broadcast. Otherwise both sides are shuffled, and
    heavy keys of the facts are split over slices. ``spread`` picks a row's slice: it must be a
    function of the row, so that a retried task puts the row in the same slice.
    """
    if table_rows is not None and fits_broadcast(table_rows, row_bytes):
        return facts.join(F.broadcast(table), key)
    if heavy is None:
        return facts.join(table, key)
    left = with_slice(facts, key, heavy, spread)
    return left.join(all_slices(table, key, heavy), [key, "slice"]).drop("slice")
