"""The ratings in the layout that the factorisation and the relevance model read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions import vectors as V
from ratingloom.operators import linalg
from ratingloom.operators.skew import MIN_ROWS, all_slices, key_stats, lookup_join, with_slice
from ratingloom.session import discard, materialize, scratch_path, shuffle_partitions


#: Rows in a bucket, about; no more buckets than Spark allows by default.
BUCKET_ROWS = 5_000_000
MAX_BUCKETS = 100_000

#: The matrix tables are in a database of their own.
DATABASE = "ratingloom_scratch"


class RatingMatrix:
    """One row per (user, item), written once and never shuffled again.

    ``total`` sums the copies of a pair, ``rating`` is the last copy and ``first_seq`` the first
    arrival. Of copies that arrive together the highest rating is the last; ratings without ``seq``
    all arrive together, and their ``first_seq`` is null. The table is bucketed by user, or by (user, slice) when some users are heavy, so
    per-user sums and joins with per-user tables read it in place: only rows as long as one user or
    one item move between executors. Use it as a context manager, which drops the table at the end.
    """

    def __init__(self, ratings: DataFrame, min_rows: int = MIN_ROWS):
        self.spark = spark = ratings.sparkSession
        columns = [c for c in ("user", "item", "rating", "seq") if c in ratings.columns]
        # The source is evaluated once: counting and building read this table.
        given = materialize(ratings.select(*columns), "matrix-input")
        stats = key_stats(given, ["user", "item"], min_rows)
        self.n_users, self.n_items = stats["user"].n_ids, stats["item"].n_ids
        self.heavy_users, self.heavy_items = stats["user"].heavy, stats["item"].heavy
        columns = [F.sum("rating").alias("total")]
        if "seq" in ratings.columns:
            last = F.max(F.struct("seq", "rating"))["rating"]
            columns += [last.alias("rating"), F.min("seq").alias("first_seq")]
        else:
            none = F.lit(None).cast("bigint")
            columns += [F.max("rating").alias("rating"), F.first(none).alias("first_seq")]
        rows, self.keys = given, ["user"]
        if self.heavy_users is not None:
            rows = with_slice(rows, "user", self.heavy_users, F.col("item"))
            self.keys = ["user", "slice"]
        n = max(shuffle_partitions(spark), min(MAX_BUCKETS, stats["user"].rows // BUCKET_ROWS))
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
        self.name = f"{DATABASE}.matrix_{uuid.uuid4().hex}"
        # The rows go to their buckets first, so that grouping needs no exchange of its own.
        (
            rows.repartition(n, *self.keys)
            .groupBy(*self.keys, "item").agg(*columns)
            .write.bucketBy(n, *self.keys)
            .option("path", scratch_path(spark, "matrix"))
            .format("parquet")
            .saveAsTable(self.name)
        )
        discard(given)
        self.table = spark.table(self.name)

    def __enter__(self) -> RatingMatrix:
        return self

    def __exit__(self, *_) -> None:
        """Drop the table with its files: what is read from it has to be written before."""
        discard(self.table)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def users(self) -> DataFrame:
        return self.table.select("user").distinct()

    def items(self) -> DataFrame:
        return self.table.select("item").distinct()

    def user_totals(self) -> DataFrame:
        return self.table.groupBy("user").agg(F.sum("total").alias("total"))

    def item_probs(self) -> DataFrame:
        """Collection probability ``(item, p_item)``."""
        items = self.table.groupBy("item").agg(F.sum("total").alias("total"))
        everything = items.agg(F.sum("total"))
        return items.select("item", (F.col("total") / everything.scalar()).alias("p_item"))

    def join_users(self, users: DataFrame) -> DataFrame:
        """Join a table with one row per user: its rows travel to the bucket of their user.

        Each task then hashes its own small share of that table, so the ratings are not sorted.
        """
        if self.heavy_users is not None:
            users = all_slices(users, "user", self.heavy_users)
        return self.table.join(users.hint("shuffle_hash"), self.keys)

    def join_items(self, rows: DataFrame, items: DataFrame, row_bytes: int) -> DataFrame:
        """Join rows of this matrix with a table that has one row per item."""
        return lookup_join(
            rows, items, "item", F.col("user"), table_rows=self.n_items, row_bytes=row_bytes,
            heavy=self.heavy_items,
        )

    def by_user(self, w: DataFrame, k: int) -> DataFrame:
        """``A^T W``: the sum of total * w[item] per user."""
        rows = self.join_items(self.table, w, 8 * k + 64)
        scaled = rows.select("user", F.expr(V.scale("total", "v", k)).alias("v"))
        return linalg.sum_vectors(scaled, "user", k)

    def by_item(self, h: DataFrame, k: int) -> DataFrame:
        """``A H``: the sum of total * h[user] per item."""
        rows = self.join_users(h)
        scaled = rows.select("item", F.expr(V.scale("total", "v", k)).alias("v"))
        return linalg.sum_vectors(scaled, "item", k)
