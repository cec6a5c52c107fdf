"""Writers and what reads their files. All of them write from the executors; nothing passes through the
driver but manifests of a few lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.operators.ppc import Factors
from ratingloom.sources import manifest

#: Rows of a file of scores, at most.
SCORE_ROWS = 20_000_000


def write_triples(ratings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headerless CSV lines ``item,user,rating``."""
    ratings.select("item", "user", "rating").write.mode(mode).csv(path, header=False)


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists", rows: int = SCORE_ROWS) -> None:
    """Parquet, one folder per cluster, so one cluster can be read alone.

    The rows are rebalanced by cluster: small clusters share a task, a large one is dealt to as many as
    its bytes ask for (the session's advisory partition size), so files are few and bounded.
    """
    dealt = scores.hint("rebalance", "cluster")
    dealt.write.mode(mode).option("maxRecordsPerFile", rows).partitionBy("cluster").parquet(path)


def read_scores(spark: SparkSession, path: str, clusters: list[int] | None = None) -> DataFrame:
    """Stored scores, ``(cluster, user, item, log_score)``; of some clusters only their folders are read."""
    found = spark.read.parquet(path)
    if clusters is not None:
        found = found.where(F.col("cluster").isin([int(c) for c in clusters]))
    return found.select("cluster", *[c for c in found.columns if c != "cluster"])


def save_factors(factors: Factors, path: str, mode: str = "errorifexists") -> None:
    """Save H and W with the passes and settings that made them, to score from or to go on from.

    They count once the manifest is there, so a job that ends early leaves the state before. ``overwrite``
    publishes a newer version; the files of earlier ones stay until they are deleted.
    """
    spark = factors.h.sparkSession
    version, _ = manifest.latest(spark, path)
    if version and mode != "overwrite":
        raise FileExistsError(f"{path} has factors")
    folder = manifest.fresh_folder("factors")
    factors.h.select("user", "v").write.parquet(f"{path}/{folder}/h")
    factors.w.select("item", "v").write.parquet(f"{path}/{folder}/w")
    content = {
        "folder": folder, "k": factors.k, "iterations": factors.iterations, "deltas": factors.deltas,
        "settings": factors.settings,
    }
    manifest.publish(spark, path, content, version)


def load_factors(spark: SparkSession, path: str) -> Factors:
    """The newest saved factors, ready for :func:`ppc.resume`."""
    _, found = manifest.latest(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path} has no factors")
    h, w = (spark.read.parquet(f"{path}/{found['folder']}/{name}") for name in ("h", "w"))
    return Factors(h, w, found["k"], found["iterations"], found["deltas"], found["settings"])
