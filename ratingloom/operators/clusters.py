"""Cluster assignment from the user factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions import vectors as V


def assign_clusters(h: DataFrame, digits: int | None = None) -> DataFrame:
    """Each user's component with the largest weight, the lowest on a tie: ``(user, cluster)``.

    ``digits`` rounds the weights first, so that differences in summation order cannot decide.
    """
    v = "v" if digits is None else f"transform(v, p -> round(p, {digits}))"
    return h.select("user", F.expr(V.argmax(v)).alias("cluster"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Users per cluster: ``(cluster, n_users)``."""
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_users"))
