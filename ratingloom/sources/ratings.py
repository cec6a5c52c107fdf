"""Triples in headerless CSV: item, user, rating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom.schema import TRIPLE


def read_triples(
    spark: SparkSession,
    path: str | list[str],
    mode: str = "FAILFAST",
    id_offset: int = 0,
    with_seq: bool = False,
    corrupt_column: str = "_corrupt_record",
    with_file: bool = False,
) -> DataFrame:
    """Read one file, many files or a glob of triples.

    A line that has not three whole numbers fails the job, whichever columns are asked for, unless
    ``mode`` is ``PERMISSIVE``, which keeps its text in ``corrupt_column``. ``id_offset`` is added to
    both ids (-1 turns 1-based ids to 0-based). ``with_seq`` adds an arrival order from the file, the
    block and the place in the block, ``with_file`` the name of the file.
    """
    permissive = mode.upper() == "PERMISSIVE"
    names = TRIPLE.fieldNames()
    fields = [T.StructField(f"_{n}", T.StringType()) for n in (*names, "line")]
    df = spark.read.schema(T.StructType(fields)).csv(
        path, header=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_line"
    )
    if with_file:
        df = df.withColumn("file", F.col("_metadata.file_path"))
    if with_seq:
        from ratingloom.sources.blocks import arrival_order

        df = arrival_order(df)
    line = F.coalesce("_line", F.concat_ws(",", *[F.coalesce(f"_{n}", F.lit("")) for n in names]))
    values = {n: F.col(f"_{n}").try_cast("int") for n in names}
    bad = F.col("_line").isNotNull()
    for value in values.values():
        bad = bad | value.isNull()
    if not permissive:
        # In a filter, so that no choice of columns can prune the check away.
        df = df.where(
            F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), line)).cast("boolean"))
            .otherwise(F.lit(True))
        )
    shift = {"item": id_offset, "user": id_offset, "rating": 0}
    columns = [(v + shift[n]).cast("int").alias(n) for n, v in values.items()]
    columns += [F.when(bad, line).alias(corrupt_column)] if permissive else []
    return df.select(*columns, *(["seq"] if with_seq else []), *(["file"] if with_file else []))
