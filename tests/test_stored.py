"""Results that are stored and taken up again: dictionaries, drops, factors, scores, g."""

import glob
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom import session
from ratingloom.operators import dictionary, ppc, prepare, rm2, sketches
from ratingloom.operators.matrix import RatingMatrix
from ratingloom.sources import drops, manifest, sinks
from tests.test_model import RATING, as_matrix, dense_fit, skewed
from tests.test_scale import conf, plan_of, wide_probs  # noqa: F401


def dealt(spark, rows, parts):
    cuts = np.array_split(np.arange(len(rows)), parts)
    return [spark.createDataFrame([rows[i] for i in cut], RATING) for cut in cuts]


# --- dictionary


def collected(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("min_rows, broadcast", [(20, False), (10**6, True)])
def test_drops_are_numbered_as_one_table(spark, tmp_path, monkeypatch, min_rows, broadcast):
    if not broadcast:
        monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rows = skewed(60, 40)
    whole = prepare.reindex(spark.createDataFrame(rows, RATING), ("item", "user"), min_rows)
    got = []
    for drop in dealt(spark, rows, 3):
        got += collected(dictionary.reindex_drop(drop, f"{tmp_path}/d", ("item", "user"), min_rows))
    assert sorted(got) == collected(whole)
    table, size = dictionary.load(spark, f"{tmp_path}/d/user", "user")
    assert size == table.count() == len({r[1] for r in rows})
    assert sorted(r["idx"] for r in table.collect()) == list(range(size))


def test_a_drop_given_twice_changes_nothing(spark, tmp_path):
    one, two = dealt(spark, skewed(), 2)
    first = collected(dictionary.reindex_drop(one, f"{tmp_path}/d"))
    version = manifest.latest(spark, f"{tmp_path}/d/user")[0]
    assert collected(dictionary.reindex_drop(one, f"{tmp_path}/d")) == first
    assert manifest.latest(spark, f"{tmp_path}/d/user")[0] == version
    dictionary.reindex_drop(two, f"{tmp_path}/d")
    assert collected(dictionary.reindex_drop(one, f"{tmp_path}/d")) == first
    assert dictionary.reindex_drop(one.limit(0), f"{tmp_path}/d").count() == 0
    with pytest.raises(ValueError, match="numbers the ids of 'user'"):
        dictionary.grow(one, "item", f"{tmp_path}/d/user")


def test_a_write_that_was_not_published_does_not_count(spark, tmp_path, monkeypatch):
    one, two = dealt(spark, skewed(60, 40), 2)
    dictionary.grow(one, "user", f"{tmp_path}/d")
    before = collected(dictionary.load(spark, f"{tmp_path}/d", "user")[0])

    def fail(*_):
        raise OSError("ended early")

    with monkeypatch.context() as broken:
        broken.setattr(manifest, "publish", fail)
        with pytest.raises(OSError):
            dictionary.grow(two, "user", f"{tmp_path}/d")
    assert len(glob.glob(f"{tmp_path}/d/ids-*")) == 2
    assert collected(dictionary.load(spark, f"{tmp_path}/d", "user")[0]) == before
    assert dictionary.grow(two, "user", f"{tmp_path}/d").size > len(before)


def test_two_writers_do_not_both_publish(spark, tmp_path):
    assert manifest.latest(spark, f"{tmp_path}/m") == (0, None)
    assert manifest.publish(spark, f"{tmp_path}/m", {"a": 1}, 0) == 1
    with pytest.raises(FileExistsError):
        manifest.publish(spark, f"{tmp_path}/m", {"a": 2}, 0)
    assert manifest.latest(spark, f"{tmp_path}/m") == (1, {"a": 1})


# --- files in drops


def lines(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.writelines(f"{i},{u},{r}\n" for i, u, r in rows)


def test_only_new_files_are_read_and_the_order_goes_on(spark, tmp_path):
    rows = [(i, i * 7 % 50, i % 5 + 1) for i in range(90)]
    lines(f"{tmp_path}/in/a 1.csv", rows[:30])
    lines(f"{tmp_path}/in/a 2.csv", rows[30:40])
    lines(f"{tmp_path}/in/a 3.csv", [])
    take = lambda: drops.take(spark, f"{tmp_path}/in/*.csv", f"{tmp_path}/files")
    first = take()
    again = take()  # nothing has been recorded yet
    assert collected(first.ratings) == collected(again.ratings) == [(*r, n) for n, r in enumerate(rows[:40])]
    first.commit()
    assert take() is None
    lines(f"{tmp_path}/in/b.csv", rows[40:])
    second = take()
    assert collected(second.ratings) == [(*r, n + 40) for n, r in enumerate(rows[40:])]
    second.commit()
    known = [(r["file"].rpartition("/")[2], r["n_rows"], r["first_seq"]) for r in drops.files(spark, f"{tmp_path}/files").collect()]
    assert sorted(known) == [("a 1.csv", 30, 0), ("a 2.csv", 10, 30), ("a 3.csv", 0, 40), ("b.csv", 50, 40)]
    with pytest.raises(FileExistsError):
        again.commit()
    lines(f"{tmp_path}/in/b.csv", rows[41:])
    with pytest.raises(ValueError, match="have changed"):
        take()


def test_folders_and_options(spark, tmp_path):
    lines(f"{tmp_path}/in/x/part-0.csv", [(1, 1, 1), (2, 2, 2)])
    lines(f"{tmp_path}/in/x/_SUCCESS", [])
    drop = drops.take(spark, f"{tmp_path}/in/x", f"{tmp_path}/files", id_offset=-1)
    assert collected(drop.ratings) == [(0, 0, 1, 0), (1, 1, 2, 1)]
    assert drops.take(spark, f"{tmp_path}/none/*", f"{tmp_path}/other") is None
    assert drops.files(spark, f"{tmp_path}/other").count() == 0


# --- sketches


def test_sketches_merge_to_the_sketch_of_all_rows(spark):
    ratings = spark.range(50_000).selectExpr("cast(id % 9000 AS int) AS user", "cast(id % 700 AS int) AS item", "id AS seq")
    whole = sketches.sketch(ratings, F.lit(0))
    parts = sketches.sketch(ratings, F.col("seq") % 5)
    assert parts.count() == 5
    assert sketches.cardinalities(parts).first() == sketches.cardinalities(whole).first() == (9000, 700)
    rough = sketches.cardinalities(sketches.sketch(ratings, F.col("seq") % 5, lg=8), lg=8).first()
    assert abs(rough["n_users"] / 9000 - 1) < 4 * 2**-4
    assert sketches.merge(parts).first()["n_rows"] == 50_000


# --- factors


@pytest.mark.parametrize("options", [{}, {"variant": "elementwise"}, {"renormalize": True, "k": 9}])
def test_resumed_passes_equal_passes_at_once(spark, tmp_path, options):
    rows = skewed()
    options = {"k": 3} | options
    with RatingMatrix(spark.createDataFrame(rows, RATING)) as matrix:
        sinks.save_factors(ppc.fit(matrix, max_iter=1, tol=0.0, **options), f"{tmp_path}/f")
        back = sinks.load_factors(spark, f"{tmp_path}/f")
        assert (back.k, back.iterations, len(back.deltas)) == (options["k"], 1, 1)
        more = ppc.resume(matrix, back, 2, tol=0.0)
    assert more.iterations == 3 and len(more.deltas) == 3
    _, h, w = dense_fit(rows, iters=3, **options)
    assert np.allclose(as_matrix(more.h, "user"), h, rtol=1e-9)
    assert np.allclose(as_matrix(more.w, "item"), w, rtol=1e-9)
    assert back.h.count() == h.shape[0]  # what was saved is still there


def test_saved_factors_have_versions(spark, tmp_path):
    factors = ppc.fit(spark.createDataFrame(skewed(), RATING), k=2, max_iter=1)
    sinks.save_factors(factors, f"{tmp_path}/f")
    with pytest.raises(FileExistsError):
        sinks.save_factors(factors, f"{tmp_path}/f")
    factors.iterations = 5
    sinks.save_factors(factors, f"{tmp_path}/f", mode="overwrite")
    assert sinks.load_factors(spark, f"{tmp_path}/f").iterations == 5
    with pytest.raises(FileNotFoundError):
        sinks.load_factors(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError, match="width 2"):
        ppc.fit(spark.createDataFrame(skewed(), RATING), k=3, start=factors)


def test_new_users_and_items_begin_as_in_a_new_fit(spark):
    rows = skewed()
    old = ppc.fit(spark.createDataFrame([r for r in rows if r[1] < 20 and r[0] < 9], RATING), k=3, max_iter=1)
    ratings = spark.createDataFrame(rows, RATING)
    more = ppc.resume(ratings, old, 0)
    assert {r["user"] for r in more.h.collect()} == {r[1] for r in rows}
    fresh = {r["user"]: list(r["v"]) for r in ppc.fit(ratings, k=3, max_iter=0).h.collect()}
    known = {r["user"]: list(r["v"]) for r in old.h.collect()}
    assert {r["user"]: list(r["v"]) for r in more.h.collect()} == fresh | known
    assert ppc.resume(ratings, old, 1).h.count() == len(fresh)


@pytest.mark.parametrize("k", [3, 9])
def test_the_change_is_that_of_a_join(spark, k):
    renormalize = k == 9
    with RatingMatrix(spark.createDataFrame(skewed(), RATING)) as matrix:
        steps = [ppc.fit(matrix, k=k, max_iter=n, renormalize=renormalize).h for n in range(3)]
        watched = ppc.fit(matrix, k=k, max_iter=2, renormalize=renormalize, tol=0.0)
        want = [ppc.delta(a, b, k).first()["delta"] for a, b in zip(steps, steps[1:])]
        assert watched.deltas == pytest.approx(want) and watched.delta == watched.deltas[-1]
        stopped = ppc.fit(matrix, k=k, max_iter=2, renormalize=renormalize, tol=want[0] * 1.01)
        assert stopped.iterations == 1 and watched.h.columns == ["user", "v"]


# --- scores of clusters


def test_scores_of_a_cluster_are_read_alone(spark, tmp_path):
    scores = spark.range(9000).selectExpr(
        "cast(CASE WHEN id < 7000 THEN 0 ELSE id % 5 END AS int) AS cluster", "cast(id % 90 AS int) AS user",
        "cast(id AS int) AS item", "id / 7 AS log_score",
    ).repartition(40)
    sinks.write_scores(scores, f"{tmp_path}/s", rows=2500)
    files = glob.glob(f"{tmp_path}/s/cluster=*/*.parquet")
    assert len(files) <= 5 + 40 // 8 + 4  # few, and none over the bound
    assert all(spark.read.parquet(f).count() <= 2500 for f in files)
    found = sinks.read_scores(spark, f"{tmp_path}/s", [3])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan and "(cluster" in plan.split("PartitionFilters")[1]
    read = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("/cluster=3/" in r["f"] for r in read)
    assert collected(found) == collected(scores.where("cluster = 3"))
    assert collected(sinks.read_scores(spark, f"{tmp_path}/s")) == collected(scores)
    assert sinks.read_scores(spark, f"{tmp_path}/s", []).count() == 0


# --- routing and the stored g

CUT = {"chunk_max": 60, "block_cells": 10, "task_work": 400, "tile_cells": 40}


def probs_of(spark, rows=None, n_clusters=3):
    ratings = spark.createDataFrame(rows or skewed(60, 40), RATING)
    assigned = ratings.select("user").distinct().withColumn("cluster", (F.col("user") % n_clusters).cast("int"))
    return rm2.prepare_probs(ratings, assigned)


def test_lists_go_where_the_rarest_item_has_cells(spark):
    probs = probs_of(spark)
    plan = rm2.cluster_plan(probs, **CUT)
    assert any(c[0] > 1 for c in plan.cuts.values()) and all(c[1] > 3 for c in plan.cuts.values())
    g = session.materialize(rm2._cooccurrence_rows(probs, plan), "g")
    blocks, cells = {}, {}
    for r in g.collect():
        blocks.setdefault((r.cluster, r.i), set()).add(r.block)
        cells[r.cluster, r.i] = cells.get((r.cluster, r.i), 0) + len(r.j)
    items = {}
    for r in probs.collect():
        items.setdefault((r.cluster, r.user), set()).add(r["item"])
    want = {
        (c, u, b) for (c, u), own in items.items()
        for b in blocks[c, min(own, key=lambda i: (cells[c, i], i))]
    }
    where = session.materialize(rm2.directory(g), "where")
    lists = rm2.routed_lists(probs, plan, where).collect()
    assert {(r.cluster, r.id, r.block) for r in lists} == want
    assert len(want) < sum(plan.blocks(c) for c, _ in items)  # some blocks are spared
    for r in lists:
        assert set(r["items"]) <= items[r.cluster, r.id]


def test_copies_do_not_follow_the_partitions(spark, conf):  # noqa: F811
    probs = session.materialize(wide_probs(spark, 60, 300, 10), "probs")
    sent = []
    for n in ("2", "64"):
        conf(spark_sql_shuffle_partitions=n)
        plan = rm2.cluster_plan(probs, **CUT)
        g = session.materialize(rm2._cooccurrence_rows(probs, plan), "g")
        where = session.materialize(rm2.directory(g), "where")
        lists = rm2.routed_lists(probs, plan, where).agg(F.sum(F.size("items"))).first()[0]
        cells = rm2.chunk_copies(g, plan).agg(F.sum(F.size("items"))).first()[0]
        sent.append((plan.cuts, lists, cells))
    assert sent[0] == sent[1] and sent[0][1] > 3000


def test_the_cheapest_cut_copies_the_fewest_bytes():
    for rows, cells, tasks in ((1e8, 3.2e8, 1800), (1e3, 1e6, 1), (5e6, 1e4, 40), (1e5, 1e9, 7)):
        least = math.ceil(cells / rm2.BLOCK_CELLS)
        chunks, blocks = rm2.cheapest_cut(rows, cells, tasks, 1, least, 10**6)
        cost = lambda c, b: rows * b * rm2.ENTRY_BYTES + cells * c * rm2.CELL_BYTES
        assert chunks * blocks >= tasks and blocks >= least
        every = [cost(c, max(least, math.ceil(tasks / c))) for c in range(1, 2000)]
        assert cost(chunks, blocks) <= 1.5 * min(every)
    assert rm2.cheapest_cut(10, 10, 0.01, 1, 1, 1) == (1, 1) and rm2.cheapest_cut(100, 4, 50, 3, 2, 2)[1] == 2


@pytest.mark.parametrize("options", [{}, {"top": 3, "digits": 6, "exclude_seen": True}])
def test_the_store_gives_the_scores_without_moving_g(spark, options):
    probs = probs_of(spark)
    want = {(r.user, r["item"]): r.log_score for r in rm2.rm2_scores(probs, **options).collect()}
    for cut in ({}, CUT):
        with rm2.CooccurrenceStore(probs, rm2.cluster_plan(probs, **cut)) as store:
            scores = store.scores(probs, **options)
            plan = plan_of(scores)
            # The lists are dealt by the keys of the store, and g is not: it is read bucket by bucket.
            keys = r"Exchange hashpartitioning\(cluster#\d+, chunk#\d+, block#\d+,"
            assert len(re.findall(keys, plan)) == 1 and plan.count("Bucketed: true") == 1
            assert "Exchange" not in plan[plan.rindex("Sort [cluster#") :]
            got = {(r.user, r["item"]): r.log_score for r in scores.collect()}
            if "top" not in options or cut == {}:
                assert set(got) == set(want)
            assert all(math.isclose(got[k], want[k], rel_tol=1e-10) for k in set(got) & set(want))
            rounds = store.scores(probs, chunk_max=50, **options).collect()
            assert {(r.user, r["item"]) for r in rounds} == set(got)
    assert not [t for t in spark.catalog.listTables("ratingloom_scratch") if "cooccurrence" in t.name]


def test_new_users_are_scored_from_the_store(spark):
    probs = probs_of(spark)
    one = [r["item"] for r in probs.where("user = 3").collect()]
    new = [(0, 900, i, 0.1, 0) for i in one] + [(0, 901, one[0], 0.1, 0), (0, 901, 5000, 0.1, 1), (0, 902, 5000, 0.1, 0)]
    with rm2.CooccurrenceStore(probs) as store:
        want = {r["item"]: r.log_score for r in store.scores(probs.where("user = 3")).collect()}
        asked = spark.createDataFrame(new, probs.schema)
        got = [tuple(r) for r in store.scores(asked).collect()]
        assert {r[1] for r in got} == {900} and {r[2]: r[3] for r in got} == pytest.approx(want)
        assert store.scores(probs.limit(0)).count() == 0


def test_empty_probs(spark):
    probs = session.materialize(probs_of(spark).limit(0), "probs")
    assert rm2.rm2_scores(probs).count() == 0
    with rm2.CooccurrenceStore(probs) as store:
        assert store.scores(probs).count() == 0
