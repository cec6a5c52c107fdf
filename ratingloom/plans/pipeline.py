"""The composed jobs: prepare a dataset, and recommend from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from ratingloom.operators import clusters as C
from ratingloom.operators import evaluate, ppc, prepare, rm2
from ratingloom.operators.matrix import RatingMatrix
from ratingloom.session import materialize
from ratingloom.sources.blocks import parse_blocks


def prepare_full(
    spark: SparkSession, path: str | list[str], columns: tuple[str, ...] = ("user", "item"),
    train_percent: int = prepare.TRAIN_PERCENT, key: Column | str = "seq", method: str = "hash",
) -> tuple[DataFrame, DataFrame]:
    """Parse block files, re-index densely, split: ``(train, test)``.

    The parsed ratings are written once, because indexing and joining each read them.
    """
    ratings = materialize(parse_blocks(spark, path), "ratings")
    slot = ratings.withColumn("_key", key) if isinstance(key, Column) else ratings
    dense = prepare.reindex(slot, columns)
    by = "_key" if isinstance(key, Column) else key
    train, test = prepare.split(dense, train_percent, by, method)
    return train.drop("_key"), test.drop("_key")


def prepare_small(
    ratings: DataFrame, n: int, train_percent: int = prepare.TRAIN_PERCENT,
    method: str = "hash",
) -> tuple[DataFrame, DataFrame]:
    """First n ratings, both ids re-indexed, split: ``(train, test)``."""
    sample = materialize(prepare.first_n(ratings, n), "sample")
    dense = prepare.reindex(sample, ("item", "user"))
    return prepare.split(dense, train_percent, method=method)


@dataclass
class Model:
    factors: ppc.Factors
    clusters: DataFrame


def fit_clusters(
    ratings: DataFrame | RatingMatrix, digits: int | None = None, **options
) -> Model:
    """Factorise and assign every user to a cluster."""
    factors = ppc.fit(ratings, **options)
    return Model(factors, C.assign_clusters(factors.h, digits))


def fit_probs(
    ratings: DataFrame, lam: float = 0.5, digits: int | None = None, **options
) -> DataFrame:
    """Factorise, cluster, and smooth: the table of p(i|u) that scoring starts from.

    Clusters are the exact argmax of H, unless ``digits`` rounds H first.

    Both halves read one rating matrix, so the ratings are shuffled once in the whole job.
    """
    with RatingMatrix(ratings) as matrix:
        return rm2.prepare_probs(matrix, fit_clusters(matrix, digits, **options).clusters, lam)


def recommend(
    ratings: DataFrame, top: int = 10, lam: float = 0.5, digits: int | None = None,
    score_digits: int | None = None, exclude_seen: bool = False, **options
) -> DataFrame:
    """Factorise, cluster, score and rank: ``(user, item, log_score, rank)``.

    Works on ratings with or without ``seq``. ``digits`` rounds H before the argmax and
    ``score_digits`` the scores before ranking; both are exact by default. ``exclude_seen`` leaves out
    items that the user has rated.
    """
    probs = fit_probs(ratings, lam, digits, **options)
    scores = rm2.rm2_scores(probs, top=top, digits=score_digits, exclude_seen=exclude_seen)
    return evaluate.topk_per_user(scores, top)
