import random

from ratingloom.llm import common


def brute(edges):
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {a: root(a) for a in parent}


def test_components_of_hubs_chains_and_loops(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(120)]
    edges += [(5000, i) for i in range(5001, 5200)] + [(i + 1, i) for i in range(900, 925)]
    edges += [(7, 7), (8, 9), (8, 9), (9, 8)]
    found = common.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r.node: r.component for r in found.collect()}
    assert all(got.get(a, a) == c for a, c in brute(edges).items())


def test_no_edges_no_components(spark):
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_slices_keep_every_row_and_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c" * 10]})
    parts = list(common.slices([batch, batch.slice(0, 0)], limit=20))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1
