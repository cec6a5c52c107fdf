"""Results that must not depend on sizes: file counts, catalogue widths, hot keys, partitions."""

import math
import os

import pytest
from pyspark.sql import functions as F

from ratingloom import session
from ratingloom.operators import aggregates as A
from ratingloom.operators import evaluate as E
from ratingloom.operators import linalg, ppc, rm2, skew
from ratingloom.operators.matrix import RatingMatrix
from ratingloom.plans import pipeline
from ratingloom.sources import blocks, sinks
from ratingloom.sources.ratings import read_triples
from tests.test_model import RATING, skewed


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    old = {}

    def put(**options):
        for key, value in options.items():
            key = key.replace("_", ".")
            old.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_keep_their_order_without_broadcasts_and_with_spills(spark, tmp_path, monkeypatch, conf):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    conf(spark_sql_files_maxPartitionBytes="700", spark_sql_files_openCostInBytes="1")
    conf(spark_sql_autoBroadcastJoinThreshold="-1")
    conf(spark_sql_windowExec_buffer_spill_threshold="50", spark_sql_sortMergeJoinExec_buffer_spill_threshold="50")
    want = []
    for number in range(12):
        lines = []
        for item in range(number * 100, number * 100 + 9):
            lines.append(f"{item}:")
            for n in range(item % 4 * 40):
                lines.append(f"{n},{n % 5 + 1},2005-01-01")
                want.append((item, n, n % 5 + 1))
        (tmp_path / f"f{number:02}.txt").write_text("\n".join(lines) + "\n")
    rows = blocks.parse_blocks(spark, str(tmp_path)).collect()
    assert [tuple(r)[:3] for r in sorted(rows, key=lambda r: r.seq)] == want
    assert sorted(r.seq for r in rows) == list(range(len(want)))
    lines = blocks._parse(blocks.with_split(spark.read.text(str(tmp_path))), F.lit(False))
    assert "Exchange" not in plan_of(blocks.fill_forward(lines)) and "Sort" not in plan_of(blocks.fill_forward(lines))


@pytest.mark.parametrize("size", ["20", "1000000"])
def test_lines_below_a_bad_header_have_no_item(spark, tmp_path, conf, size):
    conf(spark_sql_files_maxPartitionBytes=size, spark_sql_files_openCostInBytes="1")
    (tmp_path / "b.txt").write_text("1:\n5,3,d\nabc:\n6,4,d\n7,2,d\n2:\n8,1,d\n")
    rows = blocks.parse_blocks(spark, str(tmp_path), mode="PERMISSIVE").orderBy("seq").collect()
    got = [(r.item, r.user, r["_corrupt_record"]) for r in rows]
    assert got == [(1, 5, None), (None, None, "abc:"), (None, 6, "6,4,d"), (None, 7, "7,2,d"), (2, 8, None)]
    with pytest.raises(Exception, match="malformed line: abc:"):
        blocks.parse_blocks(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("text", ["1,2,3\n4,x,5\n", "1,2,3\n4,,5\n", "1,2,3\n4,5\n", "1,2,3\n4,5,6,7\n"])
@pytest.mark.parametrize("use", [
    lambda df: df.count(), lambda df: df.select("item").collect(), lambda df: df.select("rating").collect(),
    lambda df: A.item_totals(df).collect(),
])
def test_bad_triples_fail_whatever_is_asked_for(spark, tmp_path, text, use):
    (tmp_path / "t.csv").write_text(text)
    with pytest.raises(Exception, match="malformed line"):
        use(read_triples(spark, str(tmp_path)))


def test_bad_blocks_fail_whatever_is_asked_for(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1:\n5,3,d\nnonsense\n")
    with pytest.raises(Exception, match="malformed line: nonsense"):
        blocks.parse_blocks(spark, str(tmp_path)).select("item").count()


def test_each_column_has_its_own_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HEAVY", 30)
    rows = [(i, 1000 + n, 1, n) for i in range(5) for n in range(40)] + [(50 + n, 7, 1, n) for n in range(15)]
    stats = skew.key_stats(spark.createDataFrame(rows, RATING), ["user", "item"], min_rows=10)
    assert {r["item"] for r in stats["item"].heavy.collect()} == {0, 1, 2, 3, 4}
    assert {r["user"] for r in stats["user"].heavy.collect()} == {7}


def test_plain_triples_can_be_recommended_from(spark, tmp_path):
    sinks.write_triples(spark.createDataFrame(skewed(), RATING), f"{tmp_path}/t")
    top = pipeline.recommend(read_triples(spark, f"{tmp_path}/t"), top=3, k=2, max_iter=1)
    assert top.groupBy("user").count().agg(F.max("count")).first()[0] <= 3 and top.count() > 0


def test_equal_arrivals_have_a_rule(spark):
    rows = [(1, 1, 2, 5), (1, 1, 4, 5), (1, 1, 3, 5), (1, 1, 5, 4)]
    for _ in range(2):
        rows = rows[::-1]
        with RatingMatrix(spark.createDataFrame(rows, RATING).repartition(3)) as matrix:
            assert [tuple(r) for r in matrix.table.select("total", "rating", "first_seq").collect()] == [(14, 4, 4)]
        with RatingMatrix(spark.createDataFrame(rows, RATING).drop("seq")) as matrix:
            assert [tuple(r) for r in matrix.table.select("total", "rating", "first_seq").collect()] == [(14, 5, None)]


def test_small_values_decide_the_cluster(spark, monkeypatch):
    from ratingloom.operators import clusters as C

    h = spark.createDataFrame([(1, [1e-10, 3e-10])], "user int, v array<double>")
    assert C.assign_clusters(h).first()["cluster"] == 1
    seen = []
    monkeypatch.setattr(pipeline.C, "assign_clusters", lambda h, digits=None: seen.append(digits) or C.cluster_sizes)
    pipeline.fit_clusters(spark.createDataFrame(skewed(), RATING), k=2, max_iter=0)
    assert seen == [None]


@pytest.mark.parametrize("k", [3, 1500])
def test_top_pairs_of_a_cluster_for_any_k(spark, k):
    scores = spark.range(4000).selectExpr(
        "cast(0 AS int) AS cluster", "cast(id % 100 AS int) AS user", "cast(id % 700 AS int) AS item",
        "cast(id % 900 AS double) AS log_score",
    )
    pairs = {(r.item, r.log_score) for r in scores.collect()}
    want = sorted(pairs, key=lambda p: (-p[1], p[0]))[:k]
    got = E.topk_per_cluster(scores, k, salts=7).orderBy("rank").collect()
    assert [(r.item, r.log_score) for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


def wide_probs(spark, items=20_000, users=800, each=25):
    return spark.range(users * each).selectExpr(
        "cast(0 AS int) AS cluster", f"cast(id div {each} AS int) AS user",
        f"cast(abs(xxhash64(id)) % {items} AS int) AS item", "0.01D AS p", "id AS first_seq",
    ).dropDuplicates(["user", "item"])


def test_a_wide_catalogue_with_short_lists_stays_in_few_blocks(spark):
    probs = wide_probs(spark)
    plan = rm2.cluster_plan(probs)
    ((_, n_blocks, n_lists, n_groups, n_parts),) = plan.cuts.values()
    assert n_blocks * n_lists <= 5 and n_groups == n_parts == 1
    assert rm2.cluster_plan(probs, block_cells=1, tile_cells=1).cuts[0][1] <= 20_000


def test_cells_of_g_do_not_grow_with_the_partitions(spark, conf):
    probs = session.materialize(wide_probs(spark, 60, 300, 10), "probs")
    sizes = []
    for n in ("2", "64"):
        conf(spark_sql_shuffle_partitions=n)
        plan = rm2.cluster_plan(probs, task_work=1000, tile_cells=400)
        assert plan.cuts[0][3] == 3 and plan.parts() == 1
        rows = rm2._cooccurrence_rows(probs, plan)
        sizes.append(rows.agg(F.sum(F.size("j"))).first()[0])
        assert rows.groupBy("cluster", "block", "i").count().where("count > 1").count() == 0
    assert sizes[0] == sizes[1] == rm2._cooccurrence_rows(
        probs, rm2.cluster_plan(probs)
    ).agg(F.sum(F.size("j"))).first()[0]


@pytest.mark.parametrize("top", [None, 4])
def test_seen_items_leave_before_the_cut(spark, top):
    ratings = spark.createDataFrame(skewed(), RATING)
    assigned = ratings.select("user").distinct().withColumn("cluster", F.lit(0))
    probs = rm2.prepare_probs(ratings, assigned)
    seen = {(r.user, r.item) for r in ratings.collect()}
    full = {(r.user, r.item): r.log_score for r in rm2.rm2_scores(probs).collect() if (r.user, r.item) not in seen}
    got = {(r.user, r.item): r.log_score for r in rm2.rm2_scores(probs, top=top, exclude_seen=True).collect()}
    assert set(got) <= set(full) and all(math.isclose(full[k], v) for k, v in got.items())
    best = {}
    for (user, item), value in full.items():
        best.setdefault(user, []).append(value)
    for (user, item), value in full.items():
        if top is None or value >= sorted(best[user], reverse=True)[: top][-1]:
            assert (user, item) in got


def test_relevant_items_leave_out_training_pairs(spark):
    test = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1)], "user int, item int")
    train = spark.createDataFrame([(1, 2), (1, 2), (3, 1)], "user int, item int")
    assert sorted(map(tuple, E.relevant_items(test, train=train).collect())) == [(1, 1), (2, 1)]


def test_scores_do_not_move_to_pick_clusters(spark, conf):
    conf(spark_sql_autoBroadcastJoinThreshold="-1")
    scores = spark.range(100).selectExpr("cast(id % 3 AS int) AS cluster", "cast(id AS int) AS user", "1.0D AS log_score")
    picked = E.clusters_of(scores, spark.createDataFrame([(4,)], "user int"))
    assert "hashpartitioning(cluster" not in plan_of(picked).split("BroadcastExchange")[0]
    assert {r.cluster for r in picked.collect()} == {1}


def test_fit_leaves_only_its_result_in_the_scratch_folder(spark):
    root = os.path.join(session.scratch_root(spark).removeprefix("file://"), "ratingloom")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    ppc.fit(spark.createDataFrame(skewed(), RATING), k=3, max_iter=3)
    left = {n.split("-")[0] for n in set(os.listdir(root)) - before if any(os.scandir(f"{root}/{n}"))}
    assert left == {"h", "w"}
    assert not [t for t in spark.catalog.listTables("ratingloom_scratch")]


def test_grouping_behind_the_buckets_needs_no_exchange_of_its_own(spark):
    ratings = session.materialize(spark.createDataFrame(skewed(), RATING), "ratings")
    grouped = ratings.repartition(8, "user").groupBy("user", "item").agg(F.sum("rating"))
    assert plan_of(grouped).count("Exchange hashpartitioning") == 1


def test_long_form_computes_vectors_above_the_grouping_only(spark):
    rows = [(f'{{"k": {i % 3}}}',) for i in range(9)]
    table = session.materialize(spark.createDataFrame(rows, "props string"), "props")
    items = table.select(F.get_json_object("props", "$.k").cast("int").alias("item")).distinct()
    w = ppc.initial_w(items, 4)
    found = linalg.long_form(linalg.times_gram(w, linalg.gram(w, 4), 4), "item", "y")
    assert plan_of(found).count("get_json_object") == 1
    assert sorted((r.item, r.j) for r in found.collect()) == [(i, j) for i in range(3) for j in range(4)]


def test_long_form_of_null_and_empty_vectors(spark):
    rows = [(1, [0.25, None]), (2, None), (3, []), (None, [-0.0000001])]
    found = linalg.long_form(spark.createDataFrame(rows, "id int, v array<double>"), "id").collect()
    assert {tuple(r) for r in found} == {(1, 0, 0.25), (1, 1, None), (None, 0, 0.0)} and len(found) == 3
