"""Reading, re-indexing, splitting and writing, on files with awkward edges."""

import pytest
from pyspark.sql import functions as F

from ratingloom.operators import evaluate as E
from ratingloom.operators import ppc, prepare
from ratingloom.plans import pipeline
from ratingloom.sources import sinks
from ratingloom.sources.blocks import parse_blocks
from ratingloom.sources.ratings import read_triples
from tests.test_model import RATING, skewed


def block_file(path, first_item, n_items, orphan=0, blank=False):
    """Write one block file; returns the expected (item, user, rating) rows in file order."""
    lines, rows = [], []
    for n in range(orphan):
        lines.append(f"{900 + n},1,2005-01-01")
        rows.append((0, 900 + n, 1))
    for item in range(first_item, first_item + n_items):
        lines.append(f"{item}:")
        for n in range(item % 7 * (40 if item % 5 == 0 else 1)):
            lines.append(f"{item * 31 + n},{n % 5 + 1},2005-01-01")
            rows.append((item, item * 31 + n, n % 5 + 1))
        if blank:
            lines.append("")
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return rows


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                          "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("splits", ["one", "many"])
def test_parse_blocks(spark, tmp_path, splits, request):
    if splits == "many":
        request.getfixturevalue("small_splits")
    folder = tmp_path / "in put"
    folder.mkdir()
    want = []
    want += block_file(folder / "a_1.txt", 1, 60)
    want += block_file(folder / "a_2.txt", 100, 40, orphan=5)
    want += block_file(folder / "a_3.txt", 200, 30, blank=True)
    df = parse_blocks(spark, f"{folder}/a_*.txt")
    got = [tuple(r) for r in df.orderBy("seq").select("item", "user", "rating").collect()]
    assert got == want
    assert df.select("seq").distinct().count() == len(want)
    if splits == "many":
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8


def test_parse_blocks_bad_line(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("1:\n5,3,2005-01-01\nnonsense\n7,2,2005-01-01\n")
    with pytest.raises(Exception, match="malformed line: nonsense"):
        parse_blocks(spark, str(tmp_path)).collect()
    rows = parse_blocks(spark, str(tmp_path), mode="PERMISSIVE").orderBy("seq").collect()
    assert [r["_corrupt_record"] for r in rows] == [None, "nonsense", None]
    assert [r["user"] for r in rows] == [5, None, 7]


def test_triples_round_trip(spark, tmp_path, small_splits):
    rows = skewed()
    ratings = spark.createDataFrame(rows, RATING)
    sinks.write_triples(ratings.orderBy("seq").coalesce(1), f"{tmp_path}/out")
    back = read_triples(spark, f"{tmp_path}/*", with_seq=True)
    got = [tuple(r) for r in back.orderBy("seq").select("item", "user", "rating").collect()]
    assert got == [r[:3] for r in rows]
    shifted = read_triples(spark, f"{tmp_path}/out", id_offset=-1)
    assert shifted.agg(F.sum("user")).first()[0] == sum(r[1] - 1 for r in rows)


def test_bad_triple(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2,3\n4,x,5\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        read_triples(spark, str(tmp_path)).collect()
    rows = read_triples(spark, str(tmp_path), mode="PERMISSIVE").collect()
    assert sorted(str(r["_corrupt_record"]) for r in rows) == ["4,x,5", "None"]


@pytest.mark.parametrize("min_rows", [20, 10**6])
def test_reindex(spark, min_rows, monkeypatch):
    from ratingloom import session

    if min_rows == 20:
        monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rows = [(i * 1000, u * 77 + 5, r, s) for i, u, r, s in skewed()]
    ratings = spark.createDataFrame(rows, RATING).repartition(5)
    out = prepare.reindex(ratings, ("item", "user"), min_rows=min_rows)
    items, users, want = {}, {}, []
    for i, u, r, s in rows:
        want.append((items.setdefault(i, len(items)), users.setdefault(u, len(users)), r, s))
    assert [tuple(x) for x in out.orderBy("seq").collect()] == want


@pytest.mark.parametrize("method", ["arith", "hash", "random"])
def test_split_is_a_partition(spark, method):
    ratings = spark.createDataFrame(skewed(), RATING)
    train, test = prepare.split(ratings, 67, method=method, seed=3)
    assert train.count() + test.count() == ratings.count()
    assert train.join(test, "seq", "left_semi").count() == 0
    assert 0.5 < train.count() / ratings.count() < 0.8


def test_split_of_large_keys(spark):
    big = spark.createDataFrame([(1, 1, 1, 2**62)], RATING)
    train, test = prepare.split(big, method="arith")
    assert train.count() + test.count() == 1


def test_first_n(spark):
    ratings = spark.createDataFrame(skewed(), RATING).repartition(4)
    got = prepare.first_n(ratings, 37)
    assert sorted(r["seq"] for r in got.collect()) == list(range(37))


def test_factors_and_scores_round_trip(spark, tmp_path):
    train, test = prepare.split(spark.createDataFrame(skewed(), RATING))
    model = pipeline.fit_clusters(train, k=3)
    sinks.save_factors(model.factors, f"{tmp_path}/f")
    back = sinks.load_factors(spark, f"{tmp_path}/f")
    assert back.k == 3
    assert back.h.exceptAll(model.factors.h).count() == 0
    assert back.w.exceptAll(model.factors.w).count() == 0
    top = pipeline.recommend(train, top=4, k=3)
    from ratingloom.operators import clusters as C
    from ratingloom.operators import rm2

    scores = rm2.score(train, C.assign_clusters(back.h, 9))
    sinks.write_scores(scores, f"{tmp_path}/s")
    saved = spark.read.parquet(f"{tmp_path}/s")
    assert saved.count() == scores.count()
    again = E.topk_per_user(saved, 4)
    assert again.select("user", "item", "rank").exceptAll(
        top.select("user", "item", "rank")).count() == 0


def test_precision_against_spark_evaluator(spark):
    from pyspark.ml.evaluation import RankingEvaluator

    train, test = prepare.split(spark.createDataFrame(skewed(), RATING))
    top = pipeline.recommend(train, top=4, k=3)
    relevant = E.relevant_items(test)
    got = E.precision_at_k(E.precision_per_user(top, relevant, 4)).first()[0]
    lists = E.topk_item_list(top)
    truth = relevant.groupBy("user").agg(F.collect_list("item").alias("truth"))
    both = lists.join(truth, "user", "left").select(
        F.col("items").cast("array<double>").alias("prediction"),
        F.coalesce("truth", F.array(F.lit(-1))).cast("array<double>").alias("label"),
    )
    want = RankingEvaluator(metricName="precisionAtK", k=4).evaluate(both)
    assert abs(got - want) < 1e-12
    some = E.relevant_items(test, spark.createDataFrame([(3,)], "user int"))
    assert {r["user"] for r in some.collect()} == {3}


def test_wide_factors_stay_small_expressions(spark):
    ratings = spark.createDataFrame(skewed(), RATING)
    got = ppc.fit(ratings, k=40, max_iter=1)
    assert len(got.h.first()["v"]) == 40


def test_scratch_root_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from ratingloom.session import scratch_root

    def fake(master, folder=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder),
            sparkContext=SimpleNamespace(
                master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None
            ),
        )

    assert scratch_root(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(fake("yarn"))
    assert scratch_root(fake("local[2]"))
