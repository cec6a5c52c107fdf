"""Every registered query: a function from (session, table folder) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingloom.functions import vectors as V
from ratingloom.operators import aggregates as A
from ratingloom.operators import clusters as C
from ratingloom.operators import evaluate as E
from ratingloom.operators import linalg as L
from ratingloom.operators import dictionary, ppc, prepare, rm2, sketches
from ratingloom.operators.matrix import RatingMatrix
from ratingloom.operators.skew import key_stats
from ratingloom.plans import pipeline, views
from ratingloom.session import materialize, scratch_path
from ratingloom.sources import drops as new_files
from ratingloom.sources import sinks
from ratingloom.sources.blocks import parse_blocks
from ratingloom.sources.ratings import read_triples

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the registered queries, shared with their SQL.
K = 4
WIDE = 64
LAM = 0.5
TOP = 10
SAMPLE = 50_000
ITERATIONS = 2
MOST_ITERATIONS = 4
TOLERANCE = 0.21  # of the norm of the change of H
DIGITS = 9  # of H before the argmax, so that SQL finds the same clusters

events = views.ratings_events
orders = views.ratings_orders


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# --- sources and preparation


def ratings_scan(spark, sf, id_offset=0):
    path = scratch_path(spark, "triples")
    sinks.write_triples(events(spark, sf), path)
    return read_triples(spark, path, id_offset=id_offset)


def parsed_blocks(spark, sf):
    path = views.write_block_files(events(spark, sf))
    return parse_blocks(spark, path).select("item", "user", "rating")


def parsed_order(spark, sf):
    """The arrival order of the parsed rows, user by user."""
    path = views.write_block_files(events(spark, sf))
    rows = parse_blocks(spark, path)
    order = Window.partitionBy("user").orderBy("seq")
    return rows.select("user", "item", F.row_number().over(order).alias("place"))


def prepared_full(spark, sf):
    path = views.write_block_files(events(spark, sf))
    key = F.col("user").cast("bigint") * 31 + F.col("item")
    train, _ = pipeline.prepare_full(spark, path, key=key, method="arith")
    return train.select("item", "user", "rating")


def written(spark, sf, view):
    """A view as a table, for operators that read their input several times."""
    return materialize(view(spark, sf), "view")


def prepared_small(spark, sf):
    train, _ = pipeline.prepare_small(written(spark, sf, orders), SAMPLE, method="arith")
    return train


def exact_split(spark, sf):
    """All ratings, with a mark on exactly a quarter of them."""
    train, test = prepare.exact_split(written(spark, sf, events))
    return train.withColumn("is_test", F.lit(0)).unionByName(test.withColumn("is_test", F.lit(1)))


def drops(spark, sf):
    """The ratings in two halves by arrival, as they would come in two drops."""
    ratings = written(spark, sf, events)
    middle = ratings.agg(F.max("seq")).first()[0] // 2
    return ratings.where(F.col("seq") <= middle), ratings.where(F.col("seq") > middle)


def reindexed_drops(spark, sf):
    """Two drops, numbered one after the other by one stored dictionary."""
    path = scratch_path(spark, "dictionary")
    first, second = (dictionary.reindex_drop(d, path, ("item", "user")) for d in drops(spark, sf))
    return first.unionByName(second)


def scanned_drops(spark, sf):
    """Triples of two drops: the second reading takes the new files only and goes on with ``seq``."""
    path, found = scratch_path(spark, "drops"), []
    for n, rows in enumerate(drops(spark, sf)):
        ordered = rows.repartitionByRange("seq").sortWithinPartitions("seq")
        sinks.write_triples(ordered, f"{path}/triples/drop-{n}")
        drop = new_files.take(spark, f"{path}/triples/drop-*", f"{path}/files")
        drop.commit()
        found.append(drop.ratings)
    return found[0].unionByName(found[1])


def sketched(spark, sf):
    """Distinct users and items from sketches of parts of the ratings, stored and merged."""
    parts = sketches.sketch(events(spark, sf), F.col("seq") % 4)
    return sketches.cardinalities(materialize(parts, "sketches"))


def halves(spark, sf):
    """Training and test ratings, by the rule that SQL can repeat."""
    return prepare.split(events(spark, sf), method="arith")


def split_part(part):
    return lambda spark, sf: halves(spark, sf)[part]


# --- factorisation


def start(spark, sf, view=events):
    """Ratings and both start matrices."""
    ratings = view(spark, sf)
    h = ppc.initial_h(ratings.select("user").distinct(), K)
    w = ppc.initial_w(ratings.select("item").distinct(), K)
    return ratings, h, w


def uniform_h(spark, sf):
    users = events(spark, sf).select("user").distinct()
    return L.init_factors(users, "user", K, ppc.H_SEED)


def normalized(spark, sf):
    h = uniform_h(spark, sf)
    rows = h.withColumn("u", F.expr(V.row_normalize("v", K)))
    return L.long_form(rows, "user", "u", 9)


def init_w(spark, sf):
    return L.long_form(start(spark, sf)[2], "item", digits=9)


def init_h(spark, sf):
    return L.long_form(start(spark, sf)[1], "user", digits=9)


def multiplied(ratings, factors, side):
    """The ratings matrix times start factors, by the path that the factorisation takes."""
    with RatingMatrix(ratings) as matrix:
        product = matrix.by_user if side == "user" else matrix.by_item
        return materialize(product(factors, K), "product")


def ppc_x(view):
    def query(spark, sf):
        ratings, _, w = start(spark, sf, view)
        return L.long_form(multiplied(ratings, w, "user"), "user")

    return query


def ppc_s(view):
    def query(spark, sf):
        ratings, h, _ = start(spark, sf, view)
        return L.long_form(multiplied(ratings, h, "item"), "item")

    return query


def gram_of(which):
    def query(spark, sf):
        g = L.gram(start(spark, sf)[which], K)
        return g.select(F.posexplode("g").alias("pos", "v")).withColumn("v", F.round("v", 6))

    return query


def times_gram(which, other, id_col):
    def query(spark, sf):
        parts = start(spark, sf)
        y = L.times_gram(parts[which], L.gram(parts[other], K), K)
        return L.long_form(y, id_col, "y")

    return query


def updated_h(variant):
    def query(spark, sf):
        ratings, h, w = start(spark, sf)
        x = multiplied(ratings, w, "user")
        return L.long_form(ppc.update_h(h, x, L.gram(w, K), K, variant=variant), "user", digits=9)

    return query


def updated_w(spark, sf):
    """The W update alone, from the start matrices."""
    ratings, h, w = start(spark, sf)
    s = multiplied(ratings, h, "item")
    return L.long_form(ppc.update_w(w, s, L.gram(h, K), K), "item", digits=9)


def fitted(spark, sf, ratings=None, **options):
    return ppc.fit(events(spark, sf) if ratings is None else ratings, k=K, **options)


def iter_h(n):
    return lambda spark, sf: L.long_form(fitted(spark, sf, max_iter=n).h, "user", digits=8)


def iter_w(n):
    return lambda spark, sf: L.long_form(fitted(spark, sf, max_iter=n).w, "item", digits=8)


def resumed_h(spark, sf):
    """One pass, saved and loaded, and another one."""
    path = scratch_path(spark, "factors")
    with RatingMatrix(events(spark, sf)) as matrix:
        sinks.save_factors(fitted(spark, sf, matrix, max_iter=1), path)
        return L.long_form(ppc.resume(matrix, sinks.load_factors(spark, path), 1).h, "user", digits=8)


def tolerated_h(spark, sf):
    """Passes until H changes by less than a tolerance, with how many it took."""
    found = fitted(spark, sf, max_iter=MOST_ITERATIONS, tol=TOLERANCE)
    return L.long_form(found.h, "user", digits=8).withColumn("passes", F.lit(found.iterations))


def ppc_delta(spark, sf):
    ratings, h, _ = start(spark, sf)
    return rounded(ppc.delta(h, fitted(spark, sf, ratings, max_iter=1).h, K), 6, "delta")


# --- clusters


def clusters(spark, sf, ratings=None):
    factors = fitted(spark, sf, ratings, max_iter=ITERATIONS)
    return C.assign_clusters(factors.h, DIGITS)


def flat_ratings(spark, sf):
    ratings = events(spark, sf)
    heavy = key_stats(ratings, ["user"])["user"].heavy
    return rm2.ratings_by_cluster(ratings, clusters(spark, sf), heavy)


def flat_totals(spark, sf):
    return rm2.totals_by_cluster(events(spark, sf), clusters(spark, sf))


# --- relevance model


def probs(spark, sf, ratings=None):
    ratings = events(spark, sf) if ratings is None else ratings
    return pipeline.fit_probs(ratings, LAM, DIGITS, k=K, max_iter=ITERATIONS)


def user_item_prob(spark, sf):
    return rounded(probs(spark, sf).drop("first_seq"), 9, "p")


def cooccurrence(spark, sf):
    return rounded(rm2.cluster_cooccurrence(probs(spark, sf)), 9, "g")


def scores(spark, sf):
    return rounded(rm2.rm2_scores(probs(spark, sf)), 6, "log_score")


def scores_from_store(spark, sf):
    """Scores that join a stored g in place."""
    found = probs(spark, sf)
    with rm2.CooccurrenceStore(found) as store:
        return rounded(materialize(store.scores(found), "scores"), 6, "log_score")


def scores_of_cluster(spark, sf):
    """The stored scores of the cluster that holds the user with the lowest id, read alone."""
    path, found = scratch_path(spark, "score-store"), probs(spark, sf)
    sinks.write_scores(rm2.rm2_scores(found), path)
    mine = found.agg(F.min_by("cluster", "user")).first()[0]
    return rounded(sinks.read_scores(spark, path, [mine]), 6, "log_score")


def last_item(spark, sf):
    return rounded(rm2.rm2_last_item(probs(spark, sf)), 6, "log_score")


def candidates(spark, sf):
    return rm2.candidate_pairs(clusters(spark, sf), events(spark, sf).select("item").distinct())


def dense(spark, sf):
    ratings = events(spark, sf)
    assigned = materialize(clusters(spark, sf, ratings), "clusters")
    found = rm2.rm2_scores(rm2.prepare_probs(ratings, assigned, LAM))
    full = rm2.dense_scores(found, assigned, ratings.select("item").distinct())
    return rounded(full.select("cluster", "user", "item", "log_score"), 6, "log_score")


# --- ranking and evaluation, on the training share


def train_probs(spark, sf):
    return probs(spark, sf, halves(spark, sf)[0])


def topk(spark, sf):
    return E.topk_per_user(rm2.rm2_scores(train_probs(spark, sf), top=TOP, digits=6), TOP)


def topk_cluster(spark, sf):
    return E.topk_per_cluster(rm2.rm2_scores(train_probs(spark, sf), top=TOP, digits=6), TOP)


def topk_user_cluster(spark, sf):
    """The list of the cluster that holds the user with the lowest id."""
    found = train_probs(spark, sf)
    user = found.agg(F.min("user").alias("user"))
    mine = materialize(E.clusters_of(found, user), "cluster-probs")
    return E.topk_per_cluster(rm2.rm2_scores(mine, top=TOP, digits=6), TOP)


def topk_items(spark, sf):
    lists = E.topk_item_list(topk(spark, sf))
    return lists.select("user", F.posexplode("items").alias("place", "item"))


def relevant(spark, sf):
    return E.relevant_items(halves(spark, sf)[1])


def topk_unseen(spark, sf):
    """Lists without the items that the user has a training rating for."""
    found = rm2.rm2_scores(train_probs(spark, sf), top=TOP, digits=6, exclude_seen=True)
    return E.topk_per_user(found, TOP)


def relevant_unseen(spark, sf):
    train, test = halves(spark, sf)
    return E.relevant_items(test, train=train)


def mean_precision_unseen(spark, sf):
    per_user = E.precision_per_user(topk_unseen(spark, sf), relevant_unseen(spark, sf), TOP)
    return rounded(E.precision_at_k(per_user), 9, "precision_at_k")


def recommend_triples(spark, sf):
    """The whole job from triples without an arrival order: write, read, factorise, rank."""
    path = scratch_path(spark, "triples")
    sinks.write_triples(events(spark, sf), path)
    return pipeline.recommend(
        read_triples(spark, path), TOP, LAM, DIGITS, score_digits=6, k=K, max_iter=ITERATIONS
    )


def user_precision(spark, sf):
    return rounded(
        E.precision_per_user(topk(spark, sf), relevant(spark, sf), TOP), 6, "precision"
    )


def mean_precision(spark, sf):
    per_user = E.precision_per_user(topk(spark, sf), relevant(spark, sf), TOP)
    return rounded(E.precision_at_k(per_user), 9, "precision_at_k")


# --- wide vectors


def vector_gram(spark, sf):
    g = L.gram(views.vectors(spark, sf), WIDE)
    return g.select(F.posexplode("g").alias("pos", "v")).withColumn(
        "v", F.round("v", 6) + F.lit(0.0)
    )


def vector_argmax(spark, sf):
    return views.vectors(spark, sf).select("id", F.expr(V.argmax("v")).alias("best"))


def vector_norm(spark, sf):
    norm = F.expr(V.dot("v", "v", WIDE))
    return views.vectors(spark, sf).select("id", F.round(norm, 6).alias("norm2"))


QUERIES: dict[str, Query] = {
    "ratings_scan": ratings_scan,
    "ratings_scan_shifted": lambda spark, sf: ratings_scan(spark, sf, id_offset=-1),
    "parse_blocks": parsed_blocks,
    "ratings_scan_new_files": scanned_drops,
    "first_n_sample": lambda spark, sf: prepare.first_n(written(spark, sf, orders), SAMPLE),
    "reindex_users": lambda spark, sf: prepare.reindex(events(spark, sf)),
    "reindex_both": lambda spark, sf: prepare.reindex(events(spark, sf), ("item", "user")),
    "reindex_increment": reindexed_drops,
    "id_cardinalities_sketch": sketched,
    "id_cardinalities": lambda spark, sf: A.id_cardinalities(events(spark, sf)),
    "train_split": split_part(0),
    "test_split": split_part(1),
    "exact_split": exact_split,
    "prepare_full": prepared_full,
    "prepare_small": prepared_small,
    "init_w": init_w,
    "row_normalize": normalized,
    "init_h": init_h,
    "ppc_x": ppc_x(events),
    "ppc_x_orders": ppc_x(orders),
    "gram_w": gram_of(2),
    "ppc_y": times_gram(1, 2, "user"),
    "ppc_update_h": updated_h("scalar"),
    "ppc_update_h_elementwise": updated_h("elementwise"),
    "ppc_s": ppc_s(events),
    "ppc_s_orders": ppc_s(orders),
    "gram_h": gram_of(1),
    "ppc_t": times_gram(2, 1, "item"),
    "ppc_update_w": updated_w,
    "ppc_iter1_h": iter_h(1),
    "ppc_iter1_w": iter_w(1),
    "ppc_iter2_h": iter_h(2),
    "ppc_resume_h": resumed_h,
    "ppc_tol_h": tolerated_h,
    "ppc_delta": ppc_delta,
    "assign_clusters": clusters,
    "cluster_sizes": lambda spark, sf: C.cluster_sizes(clusters(spark, sf)),
    "user_totals": lambda spark, sf: A.user_totals(events(spark, sf)),
    "user_totals_orders": lambda spark, sf: A.user_totals(orders(spark, sf)),
    "global_total": lambda spark, sf: A.global_total(events(spark, sf)),
    "item_totals": lambda spark, sf: A.item_totals(events(spark, sf)),
    "item_probs": lambda spark, sf: rounded(A.item_probs(events(spark, sf)), 9, "p"),
    "item_probs_orders": lambda spark, sf: rounded(A.item_probs(orders(spark, sf)), 9, "p"),
    "ratings_by_cluster": flat_ratings,
    "totals_by_cluster": flat_totals,
    "candidate_pairs": candidates,
    "user_item_prob": user_item_prob,
    "cluster_cooccurrence": cooccurrence,
    "rm2_scores": scores,
    "rm2_from_store": scores_from_store,
    "scores_of_cluster": scores_of_cluster,
    "rm2_scores_dense": dense,
    "rm2_last_item": last_item,
    "topk_per_user": topk,
    "topk_per_cluster": topk_cluster,
    "topk_user_cluster": topk_user_cluster,
    "topk_item_list": topk_items,
    "relevant_items": relevant,
    "precision_per_user": user_precision,
    "precision_at_k": mean_precision,
    "topk_unseen": topk_unseen,
    "relevant_items_unseen": relevant_unseen,
    "precision_at_k_unseen": mean_precision_unseen,
    "recommend_triples": recommend_triples,
    "parse_blocks_order": parsed_order,
    "vector_gram": vector_gram,
    "vector_argmax": vector_argmax,
    "vector_norm": vector_norm,
}
