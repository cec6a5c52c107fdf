"""Block text: an ``item:`` header line, then ``user,rating,date`` lines until the next header.

A line's item is the nearest header above it in the same file, possibly in an earlier input split.
Each task fills items forward inside its own splits while it streams through them, and ends each
split with a row of its own: the file, the place in it, the number of rows and the last header. Both
kinds of rows are written once, so the text is read once. The rows of the splits, one per split, then
supply the item of the lines before a split's first header and the number of rows before a split.
Between the scan and the filling there is neither shuffle nor sort, whatever the number of files.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingloom.session import fits_broadcast, materialize

# Ship the helpers below with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ``file`` is set in the row that ends a split, and null in the rows of ratings.
FILLED = (
    "part int, split int, place bigint, known boolean, item int, user int, rating int, bad string,"
    " line string, file string, start bigint"
)


def with_split(df: DataFrame) -> DataFrame:
    """Add ``file`` and ``start`` of the input split that a row comes from."""
    return df.withColumns(
        {"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start")}
    )


def rows_before(splits: DataFrame) -> DataFrame:
    """Add ``before`` to ``(file, start, rows)``: the rows of all splits that come earlier, by file
    name and place in the file. The table has one row per split."""
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def lookup(splits: DataFrame) -> DataFrame:
    """A table with a row per split, marked for broadcast if it is counted and fits."""
    return F.broadcast(splits) if fits_broadcast(splits.count(), 128) else splits


def arrival_order(df: DataFrame) -> DataFrame:
    """Add ``seq``, the number of rows before this one by file name, split and place, to a scan."""
    rows = with_split(df).withColumn("id", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "start").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("rows")
    )
    splits = materialize(rows_before(splits).drop("rows"), "splits")
    seq = F.col("before") + F.col("id") - F.col("first_id")
    return rows.join(lookup(splits), ["file", "start"]).select(*df.columns, seq.alias("seq"))


def _parse(lines: DataFrame, keep_text: Column) -> DataFrame:
    """Split every line into its header or its fields. ``bad`` says that it is neither; the text goes
    along where ``keep_text`` holds."""
    text = F.trim("value")
    is_header = text.endswith(":")
    header = F.substring(text, F.lit(1), F.length(text) - 1).try_cast("int")
    parts = F.split(text, ",")
    user = F.when(~is_header, F.get(parts, F.lit(0)).try_cast("int"))
    rating = F.when(~is_header, F.get(parts, F.lit(1)).try_cast("int"))
    bad = F.when(is_header, header.isNull()).otherwise(user.isNull() | rating.isNull())
    return lines.where(text != "").select(
        "file", "start", is_header.alias("is_header"), F.when(is_header, header).alias("header"),
        user.alias("user"), rating.alias("rating"), bad.alias("bad"),
        F.when(bad | keep_text, F.col("value")).alias("text"),
    )


class Filler:
    """Carries the last header forward through the splits of one task.

    A header that is not a number leaves its lines without an item: they are kept as bad lines.
    """

    def __init__(self, part: int, permissive: bool):
        self.part, self.permissive = part, permissive
        self.split, self.at = -1, None  # number of the split in the task; its file and start
        self.known, self.item, self.place = False, None, 0

    def end_row(self) -> pa.RecordBatch:
        file, start = self.at
        values = [self.part, self.split, self.place, self.known, self.item, None, None, None, None, file, start]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, self.types())], [c.split()[0] for c in FILLED.split(", ")]
        )

    @staticmethod
    def types() -> list[pa.DataType]:
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        return [kinds[c.split()[1]] for c in FILLED.split(", ")]

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Filled rows of a batch, and the end rows of the splits that end in it."""
        if not self.permissive:
            wrong = batch.filter(batch.column("bad"))
            if wrong.num_rows:
                raise ValueError(f"malformed line: {wrong.column('text')[0].as_py()}")
        file, start = batch.column("file"), batch.column("start")
        change = np.ones(batch.num_rows, bool)
        change[1:] = pc.or_(
            pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1])
        ).to_numpy(zero_copy_only=False)
        bounds = [*np.flatnonzero(change), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            here = (file[a].as_py(), start[a].as_py())
            if here != self.at:
                if self.at is not None:
                    yield self.end_row()
                self.split, self.at = self.split + 1, here
                self.known, self.item, self.place = False, None, 0
            yield self.fill(batch.slice(a, b - a))

    def fill(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """The ratings of a stretch of one split."""
        n = rows.num_rows
        is_header = rows.column("is_header").to_numpy(zero_copy_only=False)
        header = rows.column("header")
        source = np.maximum.accumulate(np.where(is_header, np.arange(n), -1))
        above = source >= 0
        value = header.fill_null(0).to_numpy(zero_copy_only=False)[source]
        valid = header.is_valid().to_numpy(zero_copy_only=False)[source]
        items = np.where(above, value, self.item or 0).astype(np.int32)
        named = np.where(above, valid, self.item is not None)
        known = above | self.known
        text, bad = rows.column("text"), rows.column("bad").to_numpy(zero_copy_only=False)
        bad = bad | (known & ~named)
        keep = ~is_header | bad if self.permissive else ~is_header
        count, none = int(keep.sum()), pa.scalar(None, pa.string())
        columns = [
            pa.array(np.full(n, self.part, np.int32)), pa.array(np.full(n, self.split, np.int32)),
            pa.array(self.place + np.cumsum(keep) - keep), pa.array(known),
            pa.array(items, mask=~(known & named)), rows.column("user"), rows.column("rating"),
            pc.if_else(pa.array(bad), text, none),
            pc.if_else(pa.array(~known), text, none) if self.permissive else pa.nulls(n, pa.string()),
            pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
        ]
        self.place += count
        if n:
            self.known = bool(known[-1])
            self.item = int(items[-1]) if known[-1] and named[-1] else None
        names = [c.split()[0] for c in FILLED.split(", ")]
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))


def fill_forward(lines: DataFrame, permissive: bool = False) -> DataFrame:
    """Rows of ratings with the item of the nearest header above in their split, and end rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filler = Filler(TaskContext.get().partitionId(), permissive)
        for batch in batches:
            if batch.num_rows:
                yield from filler.feed(batch)
        if filler.at is not None:
            yield filler.end_row()

    return lines.mapInArrow(run, FILLED)


def parse_blocks(
    spark: SparkSession, path: str | list[str], mode: str = "FAILFAST",
    corrupt_column: str = "_corrupt_record",
) -> DataFrame:
    """Ratings of block files: ``(item, user, rating, seq)``; the date is dropped.

    The files are read and their rows written when this is called. ``seq`` numbers the rows from 0, by
    file name and place. Lines above a file's first header get item 0, blank lines are skipped. A line
    that is neither header nor rating fails the job, unless ``mode`` is ``PERMISSIVE``: it keeps the
    text of such lines, and of lines below a header that is no number, in ``corrupt_column``.
    """
    permissive = mode.upper() == "PERMISSIVE"
    lines = _parse(with_split(spark.read.text(path)), F.lit(permissive))
    filled = materialize(fill_forward(lines, permissive), "filled")
    ends = filled.where("file IS NOT NULL").select(
        "part", "split", "file", "start", F.col("place").alias("rows"),
        F.when(F.col("known"), F.struct("item")).alias("last"),
    )
    above = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows_before(ends).select(
        "part", "split", "before", F.last("last", ignorenulls=True).over(above).alias("carry")
    )
    ends = materialize(ends, "splits")
    rows = filled.where("file IS NULL").drop("file", "start").join(lookup(ends), ["part", "split"])
    carried = F.col("carry").isNotNull()
    item = F.when(F.col("known"), F.col("item")).when(carried, F.col("carry.item")).otherwise(F.lit(0))
    seq = (F.col("before") + F.col("place")).alias("seq")
    if not permissive:
        return rows.select(item.alias("item"), "user", "rating", seq)
    # Whether the header in an earlier split was a number is known only here.
    lost = F.when(~F.col("known") & carried & F.col("carry.item").isNull(), F.col("line"))
    return rows.select(
        item.alias("item"), "user", "rating", seq, F.coalesce("bad", lost).alias(corrupt_column)
    )
