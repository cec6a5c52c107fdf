"""Dense ids over several drops of files: a stored dictionary that only grows.

Ids keep the numbers that they have; ids that a drop brings for the first time are numbered behind
them, by first arrival. So numbering drops one after the other equals numbering all of them at once, if
they are given in the order of arrival. A drop that is given twice changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.operators.prepare import Index, apply_index, first_arrivals, number
from ratingloom.operators.skew import MIN_ROWS
from ratingloom.session import discard, fits_broadcast, materialize
from ratingloom.sources import manifest


def load(spark: SparkSession, path: str, column: str) -> tuple[DataFrame, int]:
    """The stored dictionary of a column, ``(column, idx)``, and how many ids it has."""
    _, found = manifest.latest(spark, path)
    folders = found["folders"] if found else []
    if found and found["column"] != column:
        raise ValueError(f"{path} numbers the ids of {found['column']!r}")
    schema = f"{column} int, idx int"
    parts = [spark.read.parquet(f"{path}/{f}") for f in folders]
    if not parts:
        return spark.createDataFrame([], schema), 0
    return reduce(DataFrame.unionByName, parts), found["size"]


def grow(ratings: DataFrame, column: str, path: str) -> Index:
    """Add the new ids of a drop to the dictionary under ``path``; the numbers of the drop's ids.

    Only the drop's distinct ids are compared with the dictionary, and only new ones are written.
    """
    spark = ratings.sparkSession
    version, found = manifest.latest(spark, path)
    known, size = load(spark, path, column)
    first = materialize(first_arrivals(ratings, column), "drop-ids")
    rows = first.agg(F.sum("n_rows")).first()[0] or 0
    hint = F.broadcast if fits_broadcast(size, 32) else lambda df: df
    fresh = number(first.join(hint(known), column, "left_anti"), column, begin=size)
    if fresh.size:
        folder = manifest.fresh_folder("ids")
        fresh.table.select(column, "idx").write.parquet(f"{path}/{folder}")
        content = {
            "column": column, "size": size + fresh.size,
            "folders": [*(found["folders"] if found else []), folder],
        }
        manifest.publish(spark, path, content, version)
        known, size = load(spark, path, column)
    numbered = materialize(first.join(known, column).select(column, "idx", "n_rows"), "drop-index")
    discard(first)
    return Index(numbered, size, rows)


def reindex_drop(
    ratings: DataFrame, path: str, columns: tuple[str, ...] = ("user",), min_rows: int = MIN_ROWS
) -> DataFrame:
    """A drop with the ids of ``columns`` replaced by numbers of the dictionaries under ``path``.

    ``ratings`` are read once to learn their ids and once to replace them, for each column.
    """
    out = ratings
    for column in columns:
        out = apply_index(out, column, grow(ratings, column, f"{path}/{column}"), min_rows)
    return out
