"""Helpers that the corpus operators share: Arrow batches of texts, scratch tables, components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.session import discard, materialize

#: A table is broadcast only when it has been counted and has at most this many narrow rows.
BROADCAST_ROWS = 1_000_000

#: Words are runs of anything but these bytes; ``bytes.split()`` cuts at exactly the same set.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are worked on in slices of about this many bytes, so memory does not follow the batch size.
SLICE_BYTES = 4 << 20


def ship(name: str) -> None:
    """Send a module's functions along with the task, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


#: Bytes of texts that pass between Spark and Python at once, unless the session sets its own.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = 64 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Have the session send texts to Python in batches of ``BATCH_BYTES``; returns ``df``.

    The setting holds for the session, as Spark reads it when a job starts. By default a batch has 64
    MB, which every task keeps on both sides, and more than once.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) in (f"{_BATCH_DEFAULT}b", "64m", "64MB", str(_BATCH_DEFAULT)):
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold about ``limit`` bytes; a row is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes.astype(np.int64)) // limit
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Give memory that is no longer used back to the system: workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def table_of(schema: str, **columns) -> pa.RecordBatch:
    """A record batch with the columns in the order of a DDL string."""
    names = [part.split()[0] for part in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in (columns[n] for n in names)], names
    )


def map_texts(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
    column: str = "text",
) -> DataFrame:
    """Apply ``work`` to slices of the Arrow batches of ``df``."""

    def run(batches):
        for part in slices(batches, column):
            yield work(part)

    return small_batches(df).mapInArrow(run, schema)


def filter_rows(
    df: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], limit: int = SLICE_BYTES
) -> DataFrame:
    """Keep the rows for which ``work`` says so; all columns stay, whatever their names."""

    def run(batches):
        for part in slices(batches, limit=limit):
            yield part.filter(pa.array(work(part)))

    return small_batches(df).mapInArrow(run, df.schema)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast if it is counted and small; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= rows else df


def _renamed(column: str) -> Column:
    """A grouped key as a new column ``key``. Spark then deals both sides of a join by it afresh,
    and can split a large partition, where it would else keep the partitions of the grouping."""
    return F.col(column).bitwiseXOR(F.lit(0)).alias("key")


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``, the smallest node of each.

    Alternating large-star and small-star passes until nothing changes. Minima are combined before
    the shuffle, and the skew join splits a node with very many edges, so no node is a group. Minima of
    a counted table that is small are broadcast, which spares the shuffles of both joins.
    Nodes without an edge are absent; an empty table gives an empty table. Each pass is a written
    table, so a lost executor repeats one pass at most.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = materialize(pairs.distinct(), label)
    before = None
    while True:
        seen = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("s")
        ).first()
        if seen.n == 0 or seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = seen
        hint = F.broadcast if 2 * seen.n <= BROADCAST_ROWS else lambda df: df  # a row per node
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(_renamed("a"), F.least("a", "m").alias("m"))
        up = now.select(F.col("b").alias("key"), F.col("a").alias("node"))
        large = up.join(hint(least), "key").where("node > m").select("node", F.col("m").alias("b")).distinct()
        low = large.groupBy("node").agg(F.min("b").alias("m"))
        linked = large.withColumnRenamed("node", "key").join(
            hint(low.select(_renamed("node"), "m")), "key"
        )
        star = linked.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        fresh = materialize(star.union(low.select("node", F.col("m").alias("b"))).distinct(), label)
        discard(now)
        now = fresh


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def hash48(key: Column) -> Column:
    """48 bits of the MD5 of a key's text, as a long: a hash that any SQL engine can repeat.

    A null key hashes like the empty text.
    """
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")
