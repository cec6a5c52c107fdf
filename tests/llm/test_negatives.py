"""Hard negatives against a search of all rows, for many shapes of labels, ties and slots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, place int, score string"


def plain(rows, every, positives=5, negs=3, low=50, high=95):
    """Every anchor with every row, sorted."""
    vectors = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not np.isfinite(x) for x in v):
            continue
        one = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        vectors[i] = min(vectors.get(i, one), one)
    out = []
    for a, (label, v) in vectors.items():
        if a % every:
            continue
        others = sorted(
            (-sum(x * y for x, y in zip(v, w)), i, other)
            for i, (other, w) in vectors.items() if i != a and len(w) == len(v)
        )
        for p, i, _ in [o for o in others if o[2] == label][:positives]:
            found = [o for o in others if o[2] != label and low * -p <= 100 * -o[0] <= high * -p][:negs]
            out += [(a, i, n, o[1], -p, -o[0]) for n, o in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def shapes(rng):
    for n, dim, labels, spread in ((300, 8, 3, 1.0), (200, 3, 2, 0.02), (250, 16, 10, 1.0), (60, 2, 1, 1.0)):
        centre = rng.normal(0.4, 0.3, dim)
        yield [
            (int(i), [float(x) for x in np.round(centre + rng.normal(0, spread, dim), 2)], int(rng.integers(labels)))
            for i in rng.permutation(n)
        ]


@pytest.mark.parametrize("cell", [(16_384, 4_096, 1 << 21), (40, 3, 64)])
def test_negatives_are_those_of_a_full_search(spark, monkeypatch, cell):
    monkeypatch.setattr(negatives, "ROWS", cell[0])
    monkeypatch.setattr(negatives, "ANCHORS", cell[1])
    monkeypatch.setattr(negatives, "SCORES", cell[2])
    for rows in shapes(np.random.default_rng(3)):
        got = sorted(tuple(r) for r in negatives.mine(table(spark, rows), every=10).collect())
        assert got == plain(rows, 10)
        if len({r[2] for r in rows}) > 1:
            assert len(got) > 50


def test_overlapping_windows_share_slots(spark):
    """Positives of 100, 90 and 80, and a negative for every score."""
    rows = [(0, [1.0, 0.0], 0)] + [(k, [p / 256, 0.0], 0) for k, p in ((1, 100), (2, 90), (3, 80), (4, 80))]
    rows += [(100 + s, [s / 256, 0.0], 1) for s in range(101)] + [(300 + s, [s / 256, 0.0], 2) for s in (40, 85, 86)]
    got = sorted(tuple(r) for r in negatives.mine(table(spark, rows), every=1000).collect())
    assert got == plain(rows, 1000) and len(got) == 12
    few = negatives.mine(table(spark, rows), every=1000, positives=2, negatives=5, low=80, high=90)
    assert sorted(tuple(r) for r in few.collect()) == plain(rows, 1000, 2, 5, 80, 90)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.4, 0.4], 2), (3, [0.3, 0.4], 2), (4, None, 1), (5, [0.5, None], 2),
        (6, [nan, 0.5], 2), (7, [inf, 0.5], 2), (8, [0.45, 0.4], None), (None, [0.4, 0.4], 2), (9, [0.4], 2),
        (10, [], 1), (20, [], 1), (30, [], 2), (2, [0.4, 0.4], 2), (3, [0.3, 0.3], 2), (40, [-0.5, -0.5], 1),
        (11, [0.0, 0.0], 1), (12, [0.0, 0.0], 2), (50, [0.0, 0.0], 1),
    ]
    got = sorted(tuple(r) for r in negatives.mine(table(spark, rows), every=10).collect())
    assert got == plain(rows, 10) and {r[0] for r in got} >= {0, 10, 50}
    assert negatives.mine(table(spark, []), every=10).count() == 0
    assert negatives.mine(table(spark, rows).where("label = 2"), every=7).count() == 0


def test_large_components(spark):
    big = float(1 << 22)
    rows = [(0, [big, big], 0), (1, [big, big], 0), (2, [big, big * 0.6], 1), (3, [big, 0.5], 1), (4, [0.1, 0.1], 1)]
    got = sorted(tuple(r) for r in negatives.mine(table(spark, rows), every=50).collect())
    assert got == plain(rows, 50) and len(got) == 2
    with pytest.raises(Exception, match="does not fit a long"):
        negatives.mine(table(spark, [(0, [1e30], 0), (1, [1e30], 0), (2, [1e30], 1)])).collect()


def test_labels_may_be_replaced(spark):
    rows = next(shapes(np.random.default_rng(5)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    moved = [(i, v, (c + 1) % 3 if i % 7 == 0 else c) for i, v, c in rows]
    got = sorted(tuple(r) for r in negatives.mine(table(spark, rows), every=10, label=label).collect())
    assert got == plain(moved, 10)
