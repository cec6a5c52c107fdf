"""Posterior probability clustering: the non-negative factorisation ``A ~ W . H^T``.

``H`` has one row per user and ``W`` one per item. One iteration updates H from the current W, then
W from the new H:

    X = A^T W, B = W^T W, Y = H B,   H <- H * (X + h.y) / (Y + h.x)
    S = A H,   C = H^T H, T = W C,   W <- W * S / T

Y and T are projections of H and W, so one join per update is enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions import kernels
from ratingloom.functions import vectors as V
from ratingloom.operators import linalg
from ratingloom.operators.matrix import RatingMatrix
from ratingloom.operators.skew import MIN_ROWS
from ratingloom.session import discard, materialize

H_SEED = 1
W_SEED = 2

#: Up to this width the H update is column arithmetic. Beyond it the generated code outgrows what the
#: JVM compiles (2,000,000 rows of 10 entries: 8.5 s, against 3.5 s in Arrow batches with numpy).
UPDATE_UNROLL = 6


def initial_h(users: DataFrame, k: int, seed: int = H_SEED, method: str = "arith") -> DataFrame:
    """Start matrix of the users; every row sums to 1."""
    return linalg.init_factors(users, "user", k, seed, normalize=True, method=method)


def initial_w(items: DataFrame, k: int, seed: int = W_SEED, method: str = "arith") -> DataFrame:
    """Start matrix of the items, entries in (0, 1)."""
    return linalg.init_factors(items, "item", k, seed, method=method)


def update_h(
    h: DataFrame, x: DataFrame, b: DataFrame, k: int, variant: str = "scalar",
    renormalize: bool = False, with_change: bool = False,
) -> DataFrame:
    """New H from H, ``x = A^T W`` and the one-row Gram matrix ``b`` of W.

    ``with_change`` adds ``change``, the squared distance of a row from the old one, so that the norm of
    the whole change is a sum over the written H.

    The numbers of ``b`` are read when this is called. ``scalar`` adds the dot products h.y and h.x;
    ``elementwise`` adds h*y and h*x entry by entry.
    A user without ratings has no row in ``x`` and leaves H.
    """
    if variant not in ("scalar", "elementwise"):
        raise ValueError(f"unknown variant {variant!r}")
    scalar, cells = variant == "scalar", linalg.gram_cells(b, k)
    rows = h.join(x.withColumnRenamed("v", "x"), "user").select("user", "v", "x")
    if k > UPDATE_UNROLL:

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hv, xv = (kernels.rows_of(batch.column(c), k) for c in ("v", "x"))
                new = kernels.new_h(hv, xv, cells, scalar, renormalize)
                columns = [batch.column("user"), kernels.vectors_of(new)]
                columns += [pa.array(((new - hv) ** 2).sum(axis=1))] if with_change else []
                yield pa.RecordBatch.from_arrays(columns, ["user", "v", "change"][: len(columns)])

        schema = h.select("user", "v").schema
        return rows.mapInArrow(update, schema.add("change", "double") if with_change else schema)

    each = range(k)
    rows = rows.selectExpr("user", *linalg.entries("h", "v", k), *linalg.entries("x", "x", k))
    rows = rows.selectExpr("*", *linalg.times_columns(cells, "h", "y"))
    if scalar:
        d, e = (V.total([f"h{i} * {c}{i}" for i in each]) for c in "yx")
        rows = rows.selectExpr("*", f"{d} AS d", f"{e} AS e")
        pairs = [(f"x{i} + d", f"y{i} + e") for i in each]
    else:
        pairs = [(f"x{i} + h{i} * y{i}", f"y{i} + h{i} * x{i}") for i in each]
    new = [f"h{i} * {V.safe_divide(top, low)} AS n{i}" for i, (top, low) in enumerate(pairs)]
    rows = rows.selectExpr("user", *(f"h{i}" for i in each if with_change), *new)
    if renormalize:
        rows = rows.selectExpr("*", V.total([f"n{i}" for i in each]) + " AS s")
    out = [V.safe_divide(f"n{i}", "s") if renormalize else f"n{i}" for i in each]
    change = V.total([f"({n} - h{i}) * ({n} - h{i})" for i, n in enumerate(out)]) + " AS change"
    return rows.selectExpr("user", V.array(out) + " AS v", *([change] if with_change else []))


def update_w(w: DataFrame, s: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """New W from W, ``s = A H`` and the one-row Gram matrix ``c`` of H.

    An item without ratings has no row in ``s`` and its factor row becomes 0.
    """
    rows = linalg.times_gram(w, c, k, out="t").join(s.withColumnRenamed("v", "s"), "item", "left")
    rows = rows.withColumn("ratio", F.expr(V.combine("s", "t", k, V.safe_divide)))
    new = V.combine("v", "ratio", k, lambda a, q: f"{a} * coalesce({q}, 0.0D)")
    return rows.select("item", F.expr(new).alias("v"))


def delta(old: DataFrame, new: DataFrame, k: int, id_col: str = "user") -> DataFrame:
    """Frobenius norm of the change between two factor matrices, one row."""
    pairs = old.join(new.withColumnRenamed("v", "n"), id_col)
    pairs = pairs.withColumn("c", F.expr(V.combine("v", "n", k, lambda a, b: f"({a} - {b})")))
    return pairs.agg(F.expr(f"sqrt(sum({V.dot('c', 'c', k)}))").alias("delta"))


@dataclass
class Factors:
    """H and W after ``iterations`` passes, with what is needed to go on.

    ``settings`` are the options of :func:`fit` that the factors depend on; ``deltas`` are the norms of the
    change of H, of the passes that were watched.
    """

    h: DataFrame
    w: DataFrame
    k: int
    iterations: int
    deltas: list[float] = field(default_factory=list)
    settings: dict = field(default_factory=dict)

    @property
    def delta(self) -> float | None:
        """Norm of the change of H in the last pass, if it was watched."""
        return self.deltas[-1] if self.deltas else None


def with_new_rows(factors: DataFrame, start: DataFrame, id_col: str) -> DataFrame:
    """Factor rows, and the start rows of ids that have none yet."""
    return factors.select(id_col, "v").unionByName(start.join(factors, id_col, "left_anti"))


def fit(
    ratings: DataFrame | RatingMatrix,
    k: int = 10,
    max_iter: int = 2,
    h_seed: int = H_SEED,
    w_seed: int = W_SEED,
    method: str = "arith",
    variant: str = "scalar",
    renormalize: bool = False,
    tol: float | None = None,
    min_heavy_rows: int = MIN_ROWS,
    start: Factors | None = None,
) -> Factors:
    """Factorise the ratings. H and W are written once per pass, so lineage never grows, and those of
    the pass before are deleted.

    The k x k Gram matrix of each half pass is read to the driver and becomes constants of the update.

    ``tol`` stops early once the norm of the change of H is below it; the job that writes H also writes the
    change of each row. ``renormalize`` makes every H row sum to 1 again after each pass; it is advised
    beyond about four iterations. ``start`` goes on from earlier factors, which are left as they are; users
    and items that they lack begin as in a new fit. ``max_iter`` counts the passes of this call.
    """
    shared = isinstance(ratings, RatingMatrix)
    with nullcontext(ratings) if shared else RatingMatrix(ratings, min_heavy_rows) as matrix:
        h = initial_h(matrix.users(), k, h_seed, method)
        w = initial_w(matrix.items(), k, w_seed, method)
        if start is not None:
            if start.k != k:
                raise ValueError(f"the earlier factors have width {start.k}, not {k}")
            h, w = with_new_rows(start.h, h, "user"), with_new_rows(start.w, w, "item")
        written = method == "rand" or start is not None or max_iter == 0
        if written:
            h = materialize(h, "h")
        w = materialize(w, "w")
        deltas, done = list(start.deltas) if start else [], 0
        for _ in range(max_iter):
            x, b = matrix.by_user(w, k), linalg.gram(w, k)
            new_h = update_h(h, x, b, k, variant, renormalize, with_change=tol is not None)
            new_h = materialize(new_h, "h")
            if tol is not None:
                deltas.append(math.sqrt(new_h.agg(F.sum("change")).first()[0] or 0.0))
                new_h = new_h.select("user", "v")
            new_w = materialize(update_w(w, matrix.by_item(new_h, k), linalg.gram(new_h, k), k), "w")
            done += 1
            discard(w, *([h] if written else []))
            h, w, written = new_h, new_w, True
            if tol is not None and deltas[-1] < tol:
                break
    settings = {
        "h_seed": h_seed, "w_seed": w_seed, "method": method, "variant": variant, "renormalize": renormalize,
    }
    return Factors(h, w, k, done + (start.iterations if start else 0), deltas, settings)


def resume(
    ratings: DataFrame | RatingMatrix, factors: Factors, max_iter: int, tol: float | None = None,
    min_heavy_rows: int = MIN_ROWS,
) -> Factors:
    """``max_iter`` more passes on earlier factors, with the settings that made them."""
    return fit(
        ratings, factors.k, max_iter, tol=tol, min_heavy_rows=min_heavy_rows, start=factors, **factors.settings
    )
