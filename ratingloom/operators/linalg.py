"""Row-indexed matrices ``(id, v array<double>)`` and the products the factorisation needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom.functions import kernels
from ratingloom.functions import vectors as V


def init_factors(
    ids: DataFrame, id_col: str, k: int, seed: int, normalize: bool = False, method: str = "arith"
) -> DataFrame:
    """Random start matrix with one row per id.

    ``arith`` derives the numbers from the id, so a rerun or a retried task repeats them;
    ``rand`` uses Spark's seeded generator (write the result before using it twice).
    """
    if method == "arith":
        v = F.expr(V.uniform_vector(id_col, k, seed))
    elif method == "rand":
        v = F.array(*[F.rand(seed * 1000 + j) for j in range(k)])
    else:
        raise ValueError(f"unknown method {method!r}")
    out = ids.select(id_col, v.alias("v"))
    return out.withColumn("v", F.expr(V.row_normalize("v", k))) if normalize else out


def sum_vectors(df: DataFrame, by: str, k: int, value: str = "v") -> DataFrame:
    """Entry-wise vector sum per key: k plain sums, so it combines before the shuffle."""
    sums = V.array([f"sum({value}[{j}])" for j in range(k)])
    return df.groupBy(by).agg(F.expr(sums).alias(value))


def gram(df: DataFrame, k: int, value: str = "v") -> DataFrame:
    """Sum of the outer products of all rows: one row ``g``, the k x k matrix row by row.

    Narrow matrices use k(k+1)/2 plain sums. Wide ones would need thousands of sums, so each task
    adds up one k x k matrix with numpy and only those matrices are shuffled.
    """
    if k <= V.UNROLL:
        pairs = [(min(i, j), max(i, j)) for i in range(k) for j in range(k)]
        sums = V.array([f"sum({value}[{i}] * {value}[{j}])" for i, j in pairs])
        return df.agg(F.expr(sums).alias("g"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (kernels.rows_of(b.column(0), k) for b in batches if b.num_rows)
        flat = kernels.gram_sum(rows, k).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k * k, dtype=np.int32)), pa.array(flat)], ["pos", "s"]
        )

    cells = df.select(value).mapInArrow(partial, "pos int, s double")
    sums = cells.groupBy("pos").agg(F.sum("s").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "s")))  # k * k entries
    return sums.agg(F.transform(ordered, lambda c: c["s"]).alias("g"))


def entries(prefix: str, value: str, k: int) -> list[str]:
    """The entries of a vector as k plain double columns that are never null.

    Arithmetic on such columns compiles to a few machine instructions; the same arithmetic on array
    elements carries a null and a bounds check per use, and soon outgrows what the JVM compiles.
    """
    return [f"coalesce({value}[{i}], 0.0D) AS {prefix}{i}" for i in range(k)]


def gram_cells(g: DataFrame, k: int) -> np.ndarray:
    """The k x k numbers of a one-row Gram matrix."""
    cells = [0.0 if x is None else x for x in g.first()["g"] or [0.0] * (k * k)]
    return np.array(cells).reshape(k, k)


def times_columns(cells: np.ndarray, prefix: str, out: str) -> list[str]:
    """Row vector times a matrix of known numbers: k columns ``out`` from k columns ``prefix``."""
    k = len(cells)
    return [
        V.total([f"{prefix}{i} * {float(cells[i, j])!r}D" for i in range(k)]) + f" AS {out}{j}"
        for j in range(k)
    ]


def times_gram(df: DataFrame, g: DataFrame, k: int, value: str = "v", out: str = "y") -> DataFrame:
    """Add ``out = value . g`` for the one-row matrix ``g``, whose k x k numbers are read first."""
    cells = gram_cells(g, k)
    if k <= V.UNROLL:
        rows = df.selectExpr("*", *entries("_a", value, k))
        rows = rows.selectExpr(*df.columns, *times_columns(cells, "_a", "_b"))
        return rows.selectExpr(*df.columns, V.array([f"_b{j}" for j in range(k)]) + f" AS {out}")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            product = kernels.rows_of(b.column(value), k) @ cells
            yield pa.RecordBatch.from_arrays(
                [*b.columns, kernels.vectors_of(product)], [*b.schema.names, out]
            )

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(multiply, schema)


def long_form(df: DataFrame, id_col: str, value: str = "v", digits: int = 6) -> DataFrame:
    """One row per matrix entry: ``(id_col, j, v)``, rounded. Null and empty vectors have no entries.

    The rows without entries are left out by their ``j``. Were they left out by the vector, as a plain
    posexplode does, that filter would move below the joins and the grouping to the scan, and would
    compute the whole vector, and the id in each of its uses, once per row of the source.
    """
    entries = df.select(id_col, F.posexplode_outer(value).alias("j", "v")).where("j IS NOT NULL")
    return entries.withColumn("v", F.expr(f"round(v, {digits}) + 0.0D"))
