"""Top-k lists and precision@k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clusters_of(scores: DataFrame, users: DataFrame) -> DataFrame:
    """All rows of the clusters that hold one of the given users.

    Works on any table with ``cluster`` and ``user``: given p(i|u) it picks the clusters before they
    are scored. The clusters are at most as many as the factors are wide, so they are broadcast and
    the rows stay where they are.
    """
    members = scores.select("cluster", "user").join(users.select("user"), "user", "left_semi")
    return scores.join(F.broadcast(members.select("cluster").distinct()), "cluster", "left_semi")


def topk_per_user(scores: DataFrame, k: int = 10) -> DataFrame:
    """A user's best items: ``(user, item, log_score, rank)``; ties go to the lower item id."""
    order = Window.partitionBy("user").orderBy(F.desc("log_score"), "item")
    ranked = scores.select("user", "item", "log_score", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def topk_per_cluster(scores: DataFrame, k: int = 10, salts: int = 256) -> DataFrame:
    """The best distinct (item, score) pairs over all users of a cluster.

    In two steps, for any k: the best k of each of ``salts`` shares of a cluster, then the best of
    these, so no task gathers a cluster and the last one gets ``salts * k`` rows of it at most.
    """
    best = [F.desc("log_score"), F.asc("item")]
    pairs = scores.select("cluster", "item", "log_score").distinct().withColumn(
        "salt", F.pmod(F.xxhash64("item", "log_score"), F.lit(salts))
    )
    share = Window.partitionBy("cluster", "salt").orderBy(*best)
    few = pairs.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= k)
    ranked = few.drop("salt").withColumn(
        "rank", F.row_number().over(Window.partitionBy("cluster").orderBy(*best))
    )
    return ranked.where(F.col("rank") <= k)


def topk_item_list(topk: DataFrame) -> DataFrame:
    """Item ids of each list in rank order: ``(user, items)``; k entries at most."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "item")))
    return topk.groupBy("user").agg(F.transform(ordered, lambda x: x["item"]).alias("items"))


def relevant_items(
    test: DataFrame, users: DataFrame | None = None, train: DataFrame | None = None
) -> DataFrame:
    """Distinct test items per user, for all users or the given ones: ``(user, item)``.

    With ``train``, items that the user has a training rating for are not relevant.
    """
    if users is not None:
        test = test.join(users.select("user"), "user", "left_semi")
    pairs = test.select("user", "item").distinct()
    if train is None:
        return pairs
    return pairs.join(train.select("user", "item").distinct(), ["user", "item"], "left_anti")


def precision_per_user(
    topk: DataFrame, relevant: DataFrame, k: int, users: DataFrame | None = None
) -> DataFrame:
    """Share of k list places that hold a relevant item: ``(user, hits, precision)``.

    ``users`` are the evaluated users; by default those that have a list.
    """
    users = topk if users is None else users
    users = users.select("user").distinct()
    hits = (
        topk.select("user", "item").distinct().join(relevant, ["user", "item"])
        .groupBy("user").agg(F.count(F.lit(1)).alias("hits"))
    )
    n = F.coalesce("hits", F.lit(0))
    return users.join(hits, "user", "left").select(
        "user", n.cast("bigint").alias("hits"), (n / F.lit(float(k))).alias("precision")
    )


def precision_at_k(per_user: DataFrame) -> DataFrame:
    """Mean of the users' precision, one row."""
    return per_user.agg(F.avg("precision").alias("precision_at_k"))
