"""Vector algebra against numpy, for short (unrolled) and long vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.functions import vectors as V
from ratingloom.operators import linalg as L


@pytest.fixture(params=[1, 3, 20])
def data(request, spark):
    k = request.param
    rng = np.random.default_rng(k)
    a, b = rng.random((30, k)) + 0.1, rng.random((30, k)) + 0.1
    rows = [(i, a[i].tolist(), b[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    return k, a, b, df


def values(df, expr):
    return np.array([r[0] for r in df.orderBy("id").select(F.expr(expr)).collect()])


def test_algebra(data):
    k, a, b, df = data
    assert np.allclose(values(df, V.dot("a", "b", k)), (a * b).sum(1))
    assert np.allclose(values(df, V.scale("2.5D", "a", k)), a * 2.5)
    assert np.allclose(values(df, V.combine("a", "b", k, V.multiply)), a * b)
    assert np.allclose(values(df, V.combine("a", "b", k, lambda p, q: f"({p} + {q})")), a + b)
    assert np.allclose(values(df, V.combine("a", "b", k, V.safe_divide)), a / b)
    assert np.allclose(values(df, V.row_sum("a", k)), a.sum(1))
    assert (values(df, V.argmax("a")) == a.argmax(1)).all()


def test_row_normalize(data):
    k, a, _, df = data
    got = values(df, V.row_normalize("a", k))
    assert np.allclose(got, a / a.sum(1, keepdims=True))
    assert np.allclose(got.sum(1), 1)


def test_matrix_products(data):
    k, a, _, df = data
    gram = a.T @ a
    g = L.gram(df, k, "a")
    assert np.allclose(np.array(g.first()["g"]).reshape(k, k), gram)
    y = L.times_gram(df, g, k, "a").orderBy("id").select("y").collect()
    assert np.allclose(np.array([r[0] for r in y]), a @ gram)
    sums = df.withColumn("by", F.col("id") % 4)
    got = dict(L.sum_vectors(sums, "by", k, "a").collect())
    for by in range(4):
        assert np.allclose(got[by], a[by::4].sum(0))


def test_safe_divide_by_zero(spark):
    row = (1, [1.0, 0.0], [0.0, 2.0])
    df = spark.createDataFrame([row], "id int, a array<double>, b array<double>")
    got = df.select(F.expr(V.combine("a", "b", 2, V.safe_divide))).first()[0]
    assert got == [0.0, 0.0]


def test_argmax_tie_goes_to_the_lowest(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    assert df.select(F.expr(V.argmax("v"))).first()[0] == 1


@pytest.mark.parametrize("k", [4, 20, 70])
def test_start_vectors(spark, k):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 5, 1_000_008, 999_999_999, 2_147_483_647)], "id int")
    rows = L.init_factors(ids, "id", k, 7).collect()
    for r in rows:
        q, x = divmod(r["id"], 1000003)
        terms = [x * x * 31 + x * 7919 * (j + 1) + j * 104729 + 7 * 31 + q * 611953 for j in range(k)]
        want = [(t % 1000003 + 1) / 1000004.0 for t in terms]
        assert np.allclose(r["v"], want)
        assert all(0 < v < 1 for v in r["v"])
    for method in ("arith", "rand"):
        for r in L.init_factors(ids, "id", k, 7, normalize=True, method=method).collect():
            assert abs(sum(r["v"]) - 1) < 1e-12
