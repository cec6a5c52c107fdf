"""Factorisation and relevance model against dense numpy and plain loops, on small tables."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom import session
from ratingloom.operators import aggregates as A
from ratingloom.operators import clusters as C
from ratingloom.operators import ppc, rm2
from ratingloom.operators.matrix import RatingMatrix
from ratingloom.operators.skew import key_stats, lookup_join

#: 6 users x 5 items by hand: (item, user, rating, seq), with a repeated pair.
TINY = [
    (0, 0, 5, 0), (1, 0, 3, 1), (0, 1, 4, 2), (2, 1, 1, 3), (1, 2, 2, 4), (2, 2, 5, 5),
    (3, 3, 4, 6), (4, 3, 4, 7), (3, 4, 2, 8), (4, 4, 5, 9), (0, 5, 1, 10), (4, 5, 3, 11),
    (0, 0, 2, 12),
]
RATING = "item int, user int, rating int, seq bigint"


def skewed(n_users=25, n_items=12, seed=0):
    """One user and one item hold about a third of all rows each."""
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(n_items)), int(rng.integers(n_users)), int(rng.integers(1, 6)))
            for _ in range(150)]
    rows += [(int(rng.integers(n_items)), 3, int(rng.integers(1, 6))) for _ in range(150)]
    rows += [(7, int(rng.integers(n_users)), int(rng.integers(1, 6))) for _ in range(150)]
    return [(*r, i) for i, r in enumerate(rows)]


@pytest.fixture(params=["tiny", "skewed"])
def rows(request):
    return TINY if request.param == "tiny" else skewed()


def start(n, k, seed):
    x, j = np.arange(n)[:, None], np.arange(k)[None, :]
    return ((x * x * 31 + x * 7919 * (j + 1) + j * 104729 + seed * 31) % 1000003 + 1) / 1000004.0


def dense_fit(rows, k, iters, variant="scalar", renormalize=False):
    m, n = max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1
    a = np.zeros((m, n))
    for item, user, rating, _ in rows:
        a[item, user] += rating
    h, w = start(n, k, 1), start(m, k, 2)
    h = h / h.sum(1, keepdims=True)
    for _ in range(iters):
        x, y = a.T @ w, h @ (w.T @ w)
        if variant == "scalar":
            d, e = (h * y).sum(1, keepdims=True), (h * x).sum(1, keepdims=True)
        else:
            d, e = h * y, h * x
        h = h * (x + d) / (y + e)
        if renormalize:
            h = h / h.sum(1, keepdims=True)
        w = w * (a @ h) / (w @ (h.T @ h))
    return a, h, w


def as_matrix(df, id_col):
    return np.array([r["v"] for r in df.orderBy(id_col).collect()])


@pytest.mark.parametrize("options", [
    {}, {"variant": "elementwise"}, {"renormalize": True}, {"min_heavy_rows": 20}, {"k": 8},
    {"k": 8, "variant": "elementwise", "renormalize": True},
])
def test_fit_matches_dense(spark, rows, options):
    ratings = spark.createDataFrame(rows, RATING)
    options = {"k": 3, **options}
    got = ppc.fit(ratings, max_iter=2, **options)
    options.pop("min_heavy_rows", None)
    _, h, w = dense_fit(rows, options.pop("k"), 2, **options)
    assert np.allclose(as_matrix(got.h, "user"), h, rtol=1e-9)
    assert np.allclose(as_matrix(got.w, "item"), w, rtol=1e-9)


def test_fit_without_broadcast_and_wide(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rows = skewed()
    got = ppc.fit(spark.createDataFrame(rows, RATING), k=14, max_iter=1, min_heavy_rows=20)
    _, h, w = dense_fit(rows, 14, 1)
    assert np.allclose(as_matrix(got.h, "user"), h, rtol=1e-9)
    assert np.allclose(as_matrix(got.w, "item"), w, rtol=1e-9)


def test_fit_stops_on_tolerance_and_stays_non_negative(spark):
    ratings = spark.createDataFrame(skewed(), RATING)
    got = ppc.fit(ratings, k=3, max_iter=6, tol=1e9)
    assert got.iterations == 1 and got.delta < 1e9
    free = ppc.fit(ratings, k=3, max_iter=2, method="rand")
    assert (as_matrix(free.h, "user") >= 0).all() and (as_matrix(free.w, "item") >= 0).all()


def test_loss_falls_with_renormalisation(spark):
    rows = skewed()
    ratings = spark.createDataFrame(rows, RATING)
    losses = []
    for n in (1, 2, 4):
        got = ppc.fit(ratings, k=3, max_iter=n, renormalize=True)
        a, _, _ = dense_fit(rows, 3, 0)
        fit = as_matrix(got.w, "item") @ as_matrix(got.h, "user").T
        losses.append(float(((a - fit) ** 2).sum()))
    assert losses == sorted(losses, reverse=True)


def brute_rm2(rows, cluster, lam):
    """Plain loops: p(i|u), and for every pair the list of inner sums over the user's items."""
    total, everything, item_sum, last = defaultdict(int), 0, defaultdict(int), {}
    for item, user, rating, _ in rows:
        total[user] += rating
        item_sum[item] += rating
        everything += rating
        last.setdefault(user, {})[item] = rating
    p = {u: {i: (1 - lam) * r / total[u] + lam * item_sum[i] / everything
             for i, r in row.items()} for u, row in last.items()}
    scores, last_only = {}, {}
    for u, row in p.items():
        peers = [v for v in p if cluster[v] == cluster[u]]
        for i in item_sum:
            sums = [sum(p[v].get(i, 0) * p[v].get(j, 0) for v in peers) for j in row]
            if all(sums):
                scores[u, i] = sum(math.log(s) for s in sums)
            if sums[-1]:
                last_only[u, i] = math.log(sums[-1])
    return p, scores, last_only


@pytest.mark.parametrize("cut", [
    None, {"chunk_max": 5, "block_cells": 10, "task_work": 20, "tile_cells": 20, "tile_pairs": 50},
])
@pytest.mark.parametrize("n_clusters", [1, 3])
def test_rm2_matches_brute_force(spark, rows, cut, n_clusters):
    ratings = spark.createDataFrame(rows, RATING)
    assigned = ratings.select("user").distinct().withColumn(
        "cluster", (F.col("user") % n_clusters).cast("int")
    )
    cluster = {u: u % n_clusters for _, u, _, _ in rows}
    p, want, want_last = brute_rm2(rows, cluster, 0.5)
    probs = rm2.prepare_probs(ratings, assigned, 0.5, min_heavy_rows=20)
    got_p = {(r["user"], r["item"]): r["p"] for r in probs.collect()}
    assert set(got_p) == {(u, i) for u, row in p.items() for i in row}
    assert all(abs(got_p[u, i] - p[u][i]) < 1e-12 for u, i in got_p)
    plan = rm2.cluster_plan(probs, **cut) if cut else None

    got = {(r["user"], r["item"]): r["log_score"] for r in rm2.rm2_scores(probs, plan).collect()}
    assert set(got) == set(want)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-10) for k in want)

    last = {(r["user"], r["item"]): r["log_score"]
            for r in rm2.rm2_last_item(probs, plan).collect()}
    assert set(last) == set(want_last)
    assert all(math.isclose(last[k], want_last[k], rel_tol=1e-10) for k in last)

    full = rm2.dense_scores(rm2.rm2_scores(probs, plan), assigned, ratings.select("item").distinct())
    dense = {(r["user"], r["item"]): r["score"] for r in full.collect()}
    assert len(dense) == len(cluster) * len({r[0] for r in rows})
    for key, value in dense.items():
        assert math.isclose(value, math.exp(want[key]) if key in want else 0.0, rel_tol=1e-9)


def test_candidate_tiles_cover_every_pair_once(spark):
    users = spark.range(23).select(F.col("id").cast("int").alias("user"), F.lit(0).alias("cluster"))
    items = spark.range(11).select(F.col("id").cast("int").alias("item"))
    pairs = rm2.candidate_pairs(users, items, user_part=4, item_part=3)
    assert pairs.count() == 253 == pairs.select("user", "item").distinct().count()


def test_heavy_keys_and_sliced_join(spark):
    ratings = spark.createDataFrame(skewed(), RATING)
    stats = key_stats(ratings, ["user", "item"], min_rows=60)
    assert (stats["user"].n_ids, stats["item"].n_ids) == (25, 12)
    assert [r["user"] for r in stats["user"].heavy.collect()] == [3]
    assert [r["item"] for r in stats["item"].heavy.collect()] == [7]
    assert key_stats(ratings, ["user"], min_rows=1000)["user"].heavy is None
    names = ratings.select("user").distinct().withColumn("name", F.col("user") * 10)
    joined = lookup_join(ratings, names, "user", F.col("seq"), heavy=stats["user"].heavy)
    assert joined.count() == ratings.count()
    assert joined.where("name <> user * 10").count() == 0


def test_matrix_is_read_in_place(spark):
    """With or without heavy users, no plan shuffles the ratings again."""
    ratings = spark.createDataFrame(skewed(), RATING)
    for min_rows in (60, 10**6):
        with RatingMatrix(ratings, min_rows) as matrix:
            h = ppc.initial_h(matrix.users(), 3)
            plan = matrix.join_users(session.materialize(h, "h"))
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert text.count("Exchange hashpartitioning") == 1  # the rows of h
            assert "Bucketed: true" in text and "ShuffledHashJoin" in text
            assert plan.count() == ratings.select("user", "item").distinct().count()


def test_properties(spark):
    ratings = spark.createDataFrame(skewed(), RATING)
    assert abs(A.item_probs(ratings).agg(F.sum("p")).first()[0] - 1) < 1e-12
    factors = ppc.fit(ratings, k=3, max_iter=1)
    assigned = C.assign_clusters(factors.h)
    sizes = C.cluster_sizes(assigned).agg(F.sum("n_users")).first()[0]
    assert sizes == ratings.select("user").distinct().count()
    approx = A.id_cardinalities(ratings, approximate=True).first()
    exact = A.id_cardinalities(ratings).first()
    assert abs(approx["n_users"] - exact["n_users"]) <= 3
