"""Time the headline queries, after a short warm-up, and print one JSON line.

Files that a query reads but that are not its work are written before. Every query runs ``RUNS`` times
and its median counts; ``stages`` are the parts of one recommendation on the larger ratings view.
BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_QUERIES (comma separated) a subset,
BENCH_RUNS the number of runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ratingloom.operators import clusters, evaluate, linalg, ppc, rm2  # noqa: E402
from ratingloom.operators.matrix import RatingMatrix  # noqa: E402
from ratingloom.plans import catalog, pipeline, views  # noqa: E402
from ratingloom.session import materialize  # noqa: E402
from ratingloom.sources.blocks import parse_blocks  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))

HEADLINE = [
    "reindex_both", "item_probs_orders", "ppc_x_orders",
    "ppc_s_orders", "ppc_iter1_h", "ppc_iter2_h", "assign_clusters", "user_item_prob",
    "cluster_cooccurrence", "rm2_scores", "rm2_last_item", "topk_per_user", "topk_per_cluster",
    "precision_at_k", "vector_gram",
]


def fit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two iterations with ten components on the larger ratings view."""
    return linalg.long_form(ppc.fit(views.ratings_orders(spark, sf_dir), k=10).h, "user")


def recommend_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on the larger view: factorise, cluster, score, top 10."""
    return pipeline.recommend(views.ratings_orders(spark, sf_dir), top=10, k=10)


def save(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def clock(run) -> float:
    begin = time.perf_counter()
    run()
    return round(time.perf_counter() - begin, 3)


def stages(spark: SparkSession) -> dict[str, float]:
    """Seconds of each part of one recommendation, from one fit."""
    times, made = {}, {}
    ratings = materialize(views.ratings_orders(spark, SF_DIR), "bench-ratings")

    def part(name, run):
        times[name] = clock(lambda: made.update({name: run()}))
        return made[name]

    matrix = part("matrix", lambda: RatingMatrix(ratings))
    with matrix:
        part("one_pass", lambda: ppc.fit(matrix, k=10, max_iter=1))
        factors = part("two_passes", lambda: ppc.fit(matrix, k=10, max_iter=2))
        assigned = part("cluster", lambda: materialize(clusters.assign_clusters(factors.h), "clusters"))
        probs = part("probs", lambda: rm2.prepare_probs(matrix, assigned))
    part("rm2_and_top_10", lambda: save(evaluate.topk_per_user(rm2.rm2_scores(probs, top=10), 10)))
    return times


def warm_up(spark: SparkSession) -> None:
    """Load classes and start Python workers on the smallest tables, so that times are steady."""
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    for name in ("prepare_full", "precision_at_k", "vector_gram"):
        catalog.QUERIES[name](spark, small if os.path.isdir(small) else SF_DIR).count()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("ratingloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = views.write_block_files(views.ratings_events(spark, SF_DIR))
    runs = {
        "parse_blocks": lambda spark, _: parse_blocks(spark, path),
        "prepare_full": lambda spark, _: pipeline.prepare_full(spark, path)[0],
    }
    runs |= {name: catalog.QUERIES[name] for name in HEADLINE}
    runs |= {"fit_orders": fit_orders, "recommend_orders": recommend_orders}
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(runs)
    warm_up(spark)
    times = {
        name: round(median(clock(lambda: save(runs[name](spark, SF_DIR))) for _ in range(RUNS)), 3)
        for name in names
    }
    parts = {} if chosen else stages(spark)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "stages": parts, "sf": os.path.basename(SF_DIR.rstrip("/"))[2:],
    }))


if __name__ == "__main__":
    main()
