"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

A unit vector is rotated at random; its code holds the signs, and its correction factor is the inner
product with its own code. For two vectors, the code of the one with the rotated other, divided by
the factor, is an unbiased estimate of their cosine. Its spread is known, so an estimate far enough
below the threshold rules a pair out, and only the others are recomputed in double precision.

Before that, the codes alone are compared: the signs in which two vectors differ are as many as their
angle makes likely, and pairs that differ in more than vectors at the threshold do are ruled out.

Which pairs are looked at: signs of further random directions, ``bits`` a table, put vectors of one
label into buckets; ``tables`` is chosen so that a pair at the threshold meets in none with
probability ``MISS``, and ``bits`` so that a bucket of unrelated vectors stays near ``BUCKET``. A pair
is looked at in the first table where it meets and in no other. Large buckets are cut into tiles.
Buckets hold a code and the keys of earlier tables; rotated and whole vectors travel only to the
tiles where the codes let a pair pass. A task returns, per vector, its number of links and one link to its component: never pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components, and those with a
null label or a null id, link with nothing; vectors of different lengths do not link; equal vectors
are one class and count as links of each other; rows that repeat an id are separate rows that share
their component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.common import components, ship, small, table_of
from ratingloom.llm.minhash import runs, smallest_labels
from ratingloom.session import materialize

ship(__name__)

COSINE = 0.98
#: Chance that a pair exactly at the threshold meets in no table.
MISS = 1e-6
#: Chance that the codes alone rule out a pair exactly at the threshold.
CODE_MISS = 1e-7
#: Vectors in a bucket of unrelated vectors, about.
BUCKET = 256
#: Rows of a block; a tile has two blocks.
BLOCK = 1024
#: Standard deviations by which an estimate may fall short.
SPREAD = 6.0
SEED = 20240


def tables_for(largest: int, cosine: float = COSINE) -> tuple[int, int]:
    """``(bits, tables)`` for labels of at most ``largest`` vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(24, max(1, math.ceil(math.log2(max(largest, 1) / BUCKET)) if largest > BUCKET else 1))
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


def rotation(dim: int, number: int) -> np.ndarray:
    """Random rotation ``number`` of ``dim`` dimensions, the same everywhere."""
    noise = np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim))
    return np.linalg.qr(noise)[0]


VECTORS = "vec_id bigint, label string, dim int, print binary, vector binary"


def prepare(table: DataFrame) -> DataFrame:
    """One row per input row: ``print`` names the class of equal vectors, null if it links with none."""
    rows = table.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, labels = batch.column("vec_id"), batch.column("label")
            lists = batch.column("embedding")
            values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
            offsets = lists.offsets.to_numpy()
            dims, prints, vectors = [], [], []
            named = zip(ids.is_valid().to_pylist(), labels.to_pylist(), lists.is_valid().to_pylist())
            for i, (has_id, label, there) in enumerate(named):
                vector = values[offsets[i] : offsets[i + 1]]
                good = has_id and label is not None and there and np.isfinite(vector).all()
                good = good and np.abs(vector).max(initial=0) > 0
                dims.append(len(vector) if good else None)
                data = vector.astype("<f8").tobytes() if good else None
                vectors.append(data)
                prints.append(xxh3_128_digest(label.encode() + b"\0" + data) if good else None)
            yield table_of(
                VECTORS, vec_id=ids, label=labels, dim=pa.array(dims, pa.int32()),
                print=pa.array(prints, pa.binary()), vector=pa.array(vectors, pa.binary()),
            )

    return rows.mapInArrow(work, VECTORS)


CODES = (
    "print binary, label string, dim int, rep bigint, n bigint, code binary, factor double,"
    " steps binary, step double, keys binary"
)


def codes(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Codes of the classes: signs, correction factor, rotated vector in 8-bit steps, table keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spins: dict[tuple[int, int], np.ndarray] = {}

        def spin(dim, number):
            if (dim, number) not in spins:
                spins[dim, number] = rotation(dim, number)
            return spins[dim, number]

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                data = b"".join(part.column("vector").to_pylist())
                x = np.frombuffer(data, "<f8").reshape(-1, dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # the norm of huge numbers overflows
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                turned = x @ spin(dim, 0).T
                step = np.abs(turned).max(axis=1) / 127
                signs = np.concatenate(
                    [x @ spin(dim, 1 + r).T for r in range(-(-bits * tables // dim))], axis=1
                )[:, : bits * tables] > 0
                powers = np.uint32(1) << np.arange(bits, dtype=np.uint32)
                keys = (signs.reshape(-1, tables, bits) * powers).sum(axis=2).astype("<u4")
                kept = [part.column(c) for c in ("print", "label", "dim", "rep", "n")]
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept, pa.array([r.tobytes() for r in np.packbits(turned > 0, axis=1)], pa.binary()),
                        pa.array(np.abs(turned).sum(axis=1) / math.sqrt(dim)),
                        pa.array(
                            [r.tobytes() for r in np.rint(turned / step[:, None]).astype(np.int8)],
                            pa.binary(),
                        ),
                        pa.array(step), pa.array([r.tobytes() for r in keys], pa.binary()),
                    ],
                    [c.split()[0] for c in CODES.split(", ")],
                )

    return classes.mapInArrow(work, CODES)


def buckets(coded: DataFrame, tables: int) -> DataFrame:
    """``(print, code, at, bucket, keys)``: one row per class and table, with the keys of earlier tables."""
    key = F.expr("substring(keys, 4 * at + 1, 4)")
    each = coded.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    return each.select(
        "print", "code", "at", F.xxhash64("label", "dim", "at", key).alias("bucket"),
        F.expr("substring(keys, 1, 4 * at)").alias("keys"),
    )


@cache
def most_unlike(signs: int, cosine: float) -> int:
    """The number of signs in which a pair at the threshold differs beyond with chance ``CODE_MISS``.

    The directions of a rotation stand at right angles, which spreads the number less than
    independent directions do, for which this is the binomial tail.
    """
    p, tail = math.acos(cosine) / math.pi, 0.0
    for k in range(signs, 0, -1):
        chosen = math.lgamma(signs + 1) - math.lgamma(k + 1) - math.lgamma(signs - k + 1)
        tail += math.exp(chosen + k * math.log(p) + (signs - k) * math.log1p(-p))
        if tail > CODE_MISS:
            return k
    return 0


def parted(tile: pa.Table, kinds: np.ndarray, find: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Pairs found in each kind of row apart, where a clash of hashes brought several into one bucket."""
    parts = [np.flatnonzero(kinds == k) for k in np.unique(kinds)]
    found = [(p, find(tile.take(pa.array(p)))) for p in parts]
    return tuple(np.concatenate([p[pair[k]] for p, pair in found]) for k in (0, 1))


def alike(tile: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as two arrays of rows) that this tile looks at and that their codes do not rule out."""
    n, at = tile.num_rows, tile.column("at").to_numpy()
    code = tile.column("code").to_pylist()
    kinds = np.array([len(c) for c in code]) * 256 + at
    if (kinds != kinds[0]).any():
        return parted(tile, kinds, lambda part: alike(part, cosine))
    block = tile.column("block").to_numpy()
    signs = np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(n, -1), axis=1).astype(np.float32) * 2 - 1
    width = signs.shape[1]
    able = signs @ signs.T >= width - 2 * most_unlike(width, cosine)
    if block.min() != block.max():
        able &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(able, 1))
    if at[0]:
        keys = np.frombuffer(b"".join(tile.column("keys").to_pylist()), "<u4").reshape(n, -1)
        first = ~(keys[i] == keys[j]).any(axis=1)
        i, j = i[first], j[first]
    return i, j


def passing(tile: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as two arrays of rows) that this tile looks at and that the estimates do not rule out."""
    n, at = tile.num_rows, tile.column("at")[0].as_py()
    dim = tile.column("dim")[0].as_py()
    kinds = tile.column("dim").to_numpy().astype(np.int64) * 256 + tile.column("at").to_numpy()
    if (kinds != kinds[0]).any():
        return parted(tile, kinds, lambda part: passing(part, cosine))
    same = np.unique(tile.column("label").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
    block = tile.column("block").to_numpy()
    keys = np.frombuffer(b"".join(tile.column("keys").to_pylist()), "<u4").reshape(n, -1)
    bits = np.frombuffer(b"".join(tile.column("code").to_pylist()), np.uint8).reshape(n, -1)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    step = tile.column("step").to_numpy()
    turned = np.frombuffer(b"".join(tile.column("steps").to_pylist()), np.int8).reshape(n, dim)
    turned = turned * step[:, None].astype(np.float32)
    factor = tile.column("factor").to_numpy()
    estimate = (signs @ turned.T) / (math.sqrt(dim) * factor[:, None])
    # Were the cosine at the threshold, the estimate would stray by this; rounding adds the rest.
    stray = np.sqrt(np.maximum(1 - factor**2, 0)) / (factor * math.sqrt(max(dim - 1, 1)))
    rounding = 0.5 * step.max() * math.sqrt(dim) / factor + 1e-5
    bound = cosine - SPREAD * math.sqrt(1 - cosine**2) * stray - rounding
    able = estimate >= bound[:, None]
    able &= able.T & (same[:, None] == same[None, :])
    if block.min() != block.max():
        able &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(able, 1))
    first = ~(keys[i, :at] == keys[j, :at]).any(axis=1)
    return i[first], j[first]


TILE = ["bucket", "low", "high"]


def tiles(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows of heavy buckets go to the tiles of their block; all others to the one tile there is."""
    spread = rows.join(small(heavy), "bucket", "left")
    spread = spread.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumns({
        "low": F.least("block", "other"), "high": F.greatest("block", "other"),
    }).drop("other", "blocks")


def linked(coded: DataFrame, vectors: DataFrame, tables: int, cosine: float) -> DataFrame:
    """``(print, links, a, b)``: per tile and class with links, their number and one of them."""
    rows = buckets(coded, tables)
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counts = materialize(counts, "bucket-sizes")
    heavy = materialize(
        counts.where(F.col("c") > BLOCK).select(
            "bucket", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")
        ),
        "heavy-buckets",
    )
    alone = rows.join(small(counts.select("bucket")), "bucket", "left_semi")
    wanted = "print binary, bucket bigint, low int, high int, at int, block int"

    def look(batches):
        for tile in runs(batches, TILE):
            if tile.num_rows > 1:
                pairs = np.unique(np.concatenate(alike(tile, cosine)))
                if len(pairs):
                    chosen = tile.take(pa.array(pairs)).combine_chunks()
                    yield from chosen.select([c.split()[0] for c in wanted.split(", ")]).to_batches()

    seen = tiles(alone, heavy).repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(look, wanted)
    seen = materialize(seen, "passing")
    out = "print binary, links bigint, a bigint, b bigint"

    def decide(batches):
        for tile in runs(batches, TILE):
            if tile.num_rows < 2:
                continue
            tile = tile.take(pa.array(np.argsort(tile.column("rep").to_numpy(), kind="stable")))
            i, j = passing(tile, cosine)
            dim = tile.column("dim").to_numpy()
            data = tile.column("vector").to_pylist()
            good = np.zeros(len(i), bool)
            for d in np.unique(dim):
                of = np.flatnonzero(dim[i] == d)
                if len(of):
                    at = np.flatnonzero(dim == d)
                    place = np.zeros(len(dim), np.int64)
                    place[at] = np.arange(len(at))
                    x = np.frombuffer(b"".join([data[k] for k in at]), "<f8").reshape(-1, d)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    norm = np.linalg.norm(x, axis=1)
                    for s in range(0, len(of), 1 << 16):
                        p, q = place[i[of[s : s + (1 << 16)]]], place[j[of[s : s + (1 << 16)]]]
                        dot = np.einsum("ij,ij->i", x[p], x[q])
                        good[of[s : s + (1 << 16)]] = dot / (norm[p] * norm[q]) >= cosine
            i, j = i[good], j[good]
            if not len(i):
                continue
            n = tile.column("n").to_numpy()
            links = np.zeros(len(n), np.int64)
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            matrix = np.zeros((len(n), len(n)), bool)
            matrix[i, j] = matrix[j, i] = True
            label, rep = smallest_labels(matrix), tile.column("rep").to_numpy()
            use = np.flatnonzero(links)
            yield table_of(
                out, print=tile.column("print").combine_chunks().take(pa.array(use)),
                links=links[use], a=rep[use], b=rep[label[use]],
            )

    full = seen.join(coded, "print").join(vectors.select("print", "vector"), "print")
    return full.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(decide, out)


def near_duplicates(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row."""
    rows = materialize(prepare(table), "vectors")
    classes = materialize(
        rows.where("print IS NOT NULL").groupBy("print").agg(
            F.first("label").alias("label"), F.first("dim").alias("dim"), F.min("vec_id").alias("rep"),
            F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"),
        ),
        "vector-classes",
    )
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, cosine)
    coded = materialize(codes(classes, bits, tables), "codes")
    links = materialize(linked(coded, classes, tables, cosine), "vector-links")
    sums = links.groupBy("print").agg(F.sum("links").alias("links"))
    joined = components(links.select("a", "b"), "vector-components").withColumnRenamed("node", "rep")
    found = (
        classes.select("print", "rep", "n").join(sums, "print", "left").join(joined, "rep", "left")
        .where("n > 1 OR links IS NOT NULL OR component IS NOT NULL")
        .select(
            "print", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    found = materialize(found, "vector-groups")
    return (
        rows.select("vec_id", "print").join(small(found), "print", "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"),
        )
    )
