"""Hard-negative mining: slots between the positives' upper limits, top k of each, merged upwards.

An anchor's positives are its best rows of its own label; a negative of a positive with score P is a row
of another label whose score lies in the window from ``LOW`` to ``HIGH`` percent of P. The windows of an
anchor's positives overlap. Their upper limits, in descending order, cut all scores into disjoint
*slots*: slot s holds the scores from limit s down to just above limit s + 1. A window begins at the
upper edge of its slot and goes on downwards, so its best rows are among the best k of that slot and of
all lower ones: k rows of each slot are enough for all windows, however many a row lies in. Every task
keeps k rows an anchor and slot, the shuffle keeps k of these, and merging the slots from the lowest
upwards gives each window's list, which its lower limit then cuts.

Anchors are compared with all rows in cells: a block of anchors and a block of rows meet in one task. The
number of blocks follows from counts, so a cell is bounded, and a row is copied once per block of anchors.
Scores are integers. They are computed as doubles where these are exact (all partial sums under 2**53),
else as longs; one that does not fit a long fails the job.

Defined cases: rows without an id, label or vector, and vectors with null or non-finite components, take no
part; vectors of different lengths are not compared; of rows that repeat an id the one with the smallest
(label, vector) takes part; an empty vector has score 0 with others; ties go to the smaller id; an anchor
without a positive or a positive without a negative gives no row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.common import ship, table_of
from ratingloom.session import materialize

ship(__name__)

#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: The window of negatives, in percent of the positive's score.
LOW, HIGH = 50, 95
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Rows and anchors of a cell, about, and scores that are held at once.
ROWS, ANCHORS, SCORES = 16_384, 4_096, 1 << 21

FOUND = "anchor_id bigint, slot int, other_id bigint, score bigint"


def prepared(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """``(vec_id, label, dim, v)`` of the rows that take part; ``v`` are the rounded components."""
    each = F.col("embedding").cast("array<double>")
    whole = F.forall(each, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all
    kept = rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        (F.col("label") if label is None else label).cast("bigint").alias("label"),
        F.when(whole, F.transform(each, lambda x: F.floor(x * SCALE).cast("double"))).alias("v"),
    )
    kept = kept.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    one = kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", F.size("r.v").alias("dim"), "r.v")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        return a @ b.T
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("a score does not fit a long")


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k largest allowed scores of each row, as pairs (row, column); ties go to the left."""
    if not scores.shape[1]:
        return
    floor = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    left = np.where(allowed, scores, floor)
    every = np.arange(len(left))
    for _ in range(min(k, left.shape[1])):
        column = left.argmax(axis=1)
        hit = np.flatnonzero(left[every, column] > floor)
        if not len(hit):
            return
        yield hit, column[hit]
        left[every, column] = floor


def limits(scores: list[int], low: int = LOW, high: int = HIGH) -> tuple[list[int], list[int]]:
    """Distinct upper limits of the windows of these positives, descending, and the lower limits.

    ``low * P <= 100 * S <= high * P`` in whole numbers; a positive below zero has no window.
    """
    windows = [(high * p // 100, -(-low * p // 100)) for p in scores]
    windows = [(upper, lower) for upper, lower in windows if lower <= upper]
    return sorted({u for u, _ in windows}, reverse=True), [lower for _, lower in windows]


def cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Rows and anchors dealt to cells: ``(dim, rows, anchors, vec_id, label, v, positives)``.

    ``positives`` are the scores of an anchor's positives, and null in rows.
    """
    of_rows, of_anchors = (max(1, math.ceil(n / size)) for n, size in ((n_rows, ROWS), (n_anchors, ANCHORS)))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(
        "dim", place(of_rows).alias("rows"), every(of_anchors).alias("anchors"), "vec_id", "label", "v",
        F.lit(None).cast("array<bigint>").alias("positives"),
    )
    right = anchors.select(
        "dim", every(of_rows).alias("rows"), place(of_anchors).alias("anchors"), "vec_id", "label", "v", "positives",
    )
    return left.unionByName(right)


def compare(
    dealt: DataFrame, same_label: bool, k: int, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """The k best rows of each anchor and slot in each cell: ``(anchor_id, slot, other_id, score)``.

    With ``same_label`` all rows of the anchor's label but itself are one slot; else slots are cut by the
    anchor's positives, and rows of other labels are dealt to them.
    """

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).sort_by("vec_id").combine_chunks()
        dim, n = key[0].as_py(), group.num_rows
        ids, label = (group.column(c).to_numpy() for c in ("vec_id", "label"))
        vectors = group.column("v").chunk(0).flatten().to_numpy().reshape(n, dim) if n else np.zeros((0, dim))
        is_anchor = group.column("positives").is_valid().to_numpy()
        others, mine = np.flatnonzero(~is_anchor), np.flatnonzero(is_anchor)
        if not len(others):
            return
        positives = group.column("positives").take(pa.array(mine)).to_pylist()
        step = max(1, SCORES // len(others))
        for at in range(0, len(mine), step):
            chosen = mine[at : at + step]
            scores = products(vectors[chosen], vectors[others])
            same = label[chosen][:, None] == label[others][None, :]
            if same_label:
                slots = [same & (ids[chosen][:, None] != ids[others][None, :])]
            else:
                slots = list(cut(scores, same, positives[at : at + step], low, high))
            for slot, allowed in enumerate(slots):
                for row, column in best(scores, allowed, k):
                    yield table_of(
                        FOUND, anchor_id=ids[chosen[row]], slot=np.full(len(row), slot, np.int32),
                        other_id=ids[others[column]], score=scores[row, column].astype(np.int64),
                    )

    return dealt.groupBy("dim", "rows", "anchors").applyInArrow(work, FOUND)


def cut(
    scores: np.ndarray, same: np.ndarray, positives: list[list[int]], low: int, high: int
) -> Iterator[np.ndarray]:
    """Slot by slot, which scores of other labels lie in it."""
    found = [limits(p, low, high) for p in positives]
    ends = np.iinfo(np.int64)
    # No window reaches below the least lower limit.
    least = np.array([min(lows, default=ends.max) for _, lows in found])
    for s in range(max((len(u) for u, _ in found), default=0)):
        upper, below = (
            np.array([u[k] if k < len(u) else ends.min for u, _ in found]) for k in (s, s + 1)
        )
        inside = (scores <= upper[:, None]) & (scores > below[:, None])
        yield ~same & inside & (scores >= least[:, None])


def merged(slots: DataFrame, positives: DataFrame, k: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The negatives of every positive, from the k best rows of every slot.

    ``positives`` has ``(anchor_id, positives array<struct<score, id>>)``, best first. The slots of an anchor
    are merged from the lowest upwards; a window takes the merge that ends in its slot.
    """
    schema = (
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint,"
        " negative_score bigint"
    )
    lists = slots.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "score", "other_id")).alias("found"))
    rows = positives.join(lists, "anchor_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                anchor, mine = row["anchor_id"], [(p["score"], p["id"]) for p in row["positives"]]
                uppers, _ = limits([s for s, _ in mine], low, high)
                held: list[list[tuple[int, int]]] = [[] for _ in uppers]
                for f in row["found"]:
                    held[f["slot"]].append((-f["score"], f["other_id"]))
                upwards, suffix = [], []
                for slot in reversed(held):
                    suffix = sorted([*slot, *suffix])[:k]
                    upwards.append(suffix)
                suffixes = upwards[::-1]
                for score, positive in mine:
                    upper, lower = limits([score], low, high)
                    if upper:
                        kept = [x for x in suffixes[uppers.index(upper[0])] if -x[0] >= lower[0]]
                        out += [(anchor, positive, n, i, score, -s) for n, (s, i) in enumerate(kept, 1)]
            names = [c.split()[0] for c in schema.split(", ")]
            columns = dict(zip(names, zip(*out))) if out else dict.fromkeys(names, ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[c], pa.int32() if c == "rank" else pa.int64()) for c in names], names
            )

    return rows.mapInArrow(run, schema)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor and slot of all cells; each task keeps k before the shuffle."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "other_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(
    rows: DataFrame, every: int = 50, label: Column | None = None, positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``; ``label`` may replace the column of that name.
    """
    all_rows = materialize(prepared(rows, label), "vectors")
    anchors = all_rows.where(F.col("vec_id") % every == 0)
    n_rows, n_anchors = all_rows.count(), anchors.count()
    blank = anchors.withColumn("positives", F.array().cast("array<bigint>"))
    near = compare(cells(all_rows, blank, n_rows, n_anchors), True, positives)
    chosen = top(near, positives).groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "score", F.col("other_id").alias("id")))).alias("p")
    )
    chosen = materialize(
        chosen.select("anchor_id", F.transform("p", lambda p: F.struct(p["score"].alias("score"), p["id"].alias("id"))).alias("positives")),
        "positives",
    )
    asking = anchors.join(
        chosen.select(F.col("anchor_id").alias("vec_id"), F.col("positives.score").alias("positives")), "vec_id"
    )
    slots = top(compare(cells(all_rows, asking, n_rows, n_anchors), False, negatives, low, high), negatives)
    return merged(slots, chosen, negatives, low, high)
