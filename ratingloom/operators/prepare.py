"""Sampling, dense re-indexing and the train/test split."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.operators.selection import split_at
from ratingloom.operators.skew import MAX_HEAVY, MIN_ROWS, lookup_join
from ratingloom.session import materialize, shuffle_partitions

# The rule of the repeatable split and the share of training rows.
SPLIT_FACTOR = 7919
SPLIT_SHIFT = 13
TRAIN_PERCENT = 67


#: Share of the test rows of an exact split.
TEST_SHARE = 0.25

#: The order of arrival; rows that arrive together are ordered by their values.
ARRIVAL = ["seq", "item", "user", "rating"]


def first_n(ratings: DataFrame, n: int) -> DataFrame:
    """The first n ratings in arrival order: a sample, so its size has no default.

    The place of the last one is found by histograms, so any n is a filter and never a sort. ``ratings``
    are read for each histogram: give a table that has been written.
    """
    return split_at(ratings, [c for c in ARRIVAL if c in ratings.columns], n)[0]


@dataclass
class Index:
    """A map from ids to 0..n-1 by first appearance: ``(id column, idx, n_rows)``."""

    table: DataFrame
    size: int
    rows: int


def first_arrivals(ratings: DataFrame, column: str) -> DataFrame:
    """One row per id of a column: ``(column, first_seq, n_rows)``."""
    return ratings.groupBy(column).agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_rows")
    )


def build_index(ratings: DataFrame, column: str) -> Index:
    """Number the distinct ids of a column by first arrival, without a single-task sort."""
    return number(first_arrivals(ratings, column), column)


def number(first: DataFrame, column: str, begin: int = 0) -> Index:
    """Number :func:`first_arrivals` from ``begin`` on.

    The ids are range-partitioned by first arrival and written; a row's number is then the number
    of ids in earlier partitions plus its place inside its own. Only one count per partition
    reaches the driver.
    """
    spark = first.sparkSession
    n = shuffle_partitions(spark)
    ranged = (
        first.repartitionByRange(n, "first_seq", column)
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions("first_seq", column)
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    ranged = materialize(ranged, f"index-{column}")
    counts = sorted(
        ranged.groupBy("part").agg(F.count(F.lit(1)), F.sum("n_rows")).collect()
    )
    offsets, size, rows = [], 0, 0
    for part, n_ids, n_rows in counts:
        offsets.append((part, begin + size))
        size, rows = size + n_ids, rows + n_rows
    offset = spark.createDataFrame(offsets, "part int, offset bigint")
    table = ranged.join(F.broadcast(offset), "part").select(
        column, (F.col("offset") + F.col("place")).cast("int").alias("idx"), "n_rows"
    )
    return Index(table, size, rows)


def apply_index(
    ratings: DataFrame, column: str, index: Index, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Replace a column's ids by their numbers."""
    limit = max(min_rows, index.rows // MAX_HEAVY)  # at most MAX_HEAVY ids can exceed it
    heavy = index.table.where(F.col("n_rows") > limit).select(
        column, F.ceil(F.col("n_rows") / limit).cast("int").alias("n_salts")
    )
    joined = lookup_join(
        ratings, index.table.select(column, "idx"), column, F.col("seq"),
        table_rows=index.size, row_bytes=32, heavy=heavy,
    )
    return joined.select(*[F.col("idx").alias(c) if c == column else c for c in ratings.columns])


def reindex(
    ratings: DataFrame, columns: tuple[str, ...] = ("user",), min_rows: int = MIN_ROWS
) -> DataFrame:
    """Dense 0-based ids by first appearance, shared by all input files."""
    out = ratings
    for column in columns:
        out = apply_index(out, column, build_index(ratings, column), min_rows)
    return out


def exact_split(
    ratings: DataFrame, test: int | float = TEST_SHARE, key: str = "seq", seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows in an exact proportion: ``(train, test)``.

    ``test`` is a number of rows, or a share of all rows that is rounded up. The rows with the smallest hashes
    of their key are test rows; equal hashes are ordered by the key and then by the other values.
    The hash of the last one is found by histograms, so both parts are filters. ``ratings`` are read
    for each histogram: give a table that has been written.
    """
    if isinstance(test, float) and not 0 <= test <= 1 or test < 0:
        raise ValueError(f"no size of a test set: {test!r}")
    n = math.ceil(test * ratings.count()) if isinstance(test, float) else test
    text = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)))
    hashed = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")
    numbers = [c for c, kind in ratings.dtypes if kind in ("tinyint", "smallint", "int", "bigint") and c != key]
    found = split_at(ratings, [hashed, key, *numbers], n)
    return found[1], found[0]


def split_slot(key: Column) -> Column:
    """A number 0..99 from an integer key; reduced first so that no key overflows."""
    return F.pmod(F.pmod(key, F.lit(100)) * SPLIT_FACTOR + SPLIT_SHIFT, F.lit(100))


def split(
    ratings: DataFrame,
    train_percent: int = TRAIN_PERCENT,
    key: Column | str = "seq",
    method: str = "hash",
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows. Each row decides from its own key, so both sides are plain filters.

    ``hash`` mixes the key with a seed. ``arith`` is a rule on the key's remainder that any SQL engine
    can check, biased where the key has a period; ``random`` is Spark's ``randomSplit``.
    """
    if method == "random":
        weights = [train_percent / 100, 1 - train_percent / 100]
        train, test = ratings.randomSplit(weights, seed)
        return train, test
    col = F.col(key) if isinstance(key, str) else key
    if method == "arith":
        slot = split_slot(col.cast("bigint"))
    elif method == "hash":
        slot = F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(100))
    else:
        raise ValueError(f"unknown method {method!r}")
    return ratings.where(slot < train_percent), ratings.where(slot >= train_percent)
