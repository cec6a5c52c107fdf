"""Triples that arrive in drops: a table of the files read, so that a rerun takes only new ones.

The arrival order ``seq`` goes on where the last drop ended, and files that have been read keep theirs.
Files of a drop are ordered by name. Nothing is recorded before :meth:`Drop.commit`: a job that ends
early takes the same files again and gives their rows the same ``seq``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.session import materialize
from ratingloom.sources import manifest
from ratingloom.sources.ratings import read_triples

FILES = "file string, bytes bigint, n_rows bigint, first_seq bigint"


def listed(spark: SparkSession, pattern: str) -> dict[str, int]:
    """Bytes of the files that a path or glob names, or that lie in folders it names."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    system = make(pattern).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in system.globStatus(make(pattern)) or []:
        for file in system.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if file.isFile() and file.getPath().getName()[0] not in "._":
                found[file.getPath().toString()] = file.getLen()
    return found


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files read so far: ``(file, bytes, n_rows, first_seq)``."""
    _, found = manifest.latest(spark, path)
    if found is None:
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).parquet(*[f"{path}/{f}" for f in found["folders"]])


@dataclass
class Drop:
    """New rows, ``(item, user, rating, seq)``, and the files that they come from."""

    ratings: DataFrame
    files: DataFrame
    path: str
    version: int
    state: dict

    def commit(self) -> None:
        """Record the files as read, once what was made of the rows has been written."""
        spark = self.ratings.sparkSession
        folder = manifest.fresh_folder("files")
        self.files.write.parquet(f"{self.path}/{folder}")
        state = self.state | {"folders": [*self.state["folders"], folder]}
        self.version, self.state = manifest.publish(spark, self.path, state, self.version), state


def take(spark: SparkSession, pattern: str, path: str, **options) -> Drop | None:
    """The files of ``pattern`` that the table under ``path`` does not have; None if there are none.

    A file that has been read and has another size now is an error. ``options`` go to
    :func:`read_triples`. The rows are parsed once, into the scratch folder.
    """
    version, state = manifest.latest(spark, path)
    state = state or {"rows": 0, "folders": []}
    known = {r["file"]: r["bytes"] for r in files(spark, path).select("file", "bytes").collect()}
    there = listed(spark, pattern)
    changed = sorted(f for f, n in there.items() if known.get(f, n) != n)
    if changed:
        raise ValueError(f"files have changed since they were read: {', '.join(changed[:3])}")
    fresh = sorted(set(there) - set(known))
    if not fresh:
        return None
    rows = materialize(read_triples(spark, fresh, with_seq=True, with_file=True, **options), "drop")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).collect()
    plain = lambda name: spark._jvm.java.net.URI(name).getPath()
    of_file = {plain(r["file"]): (r["n"], r["first"]) for r in counts}
    local = spark._jvm.org.apache.hadoop.fs.Path
    base, table, total = state["rows"], [], 0
    for name in fresh:
        n, first = of_file.get(local(name).toUri().getPath(), (0, total))
        table.append((name, there[name], n, base + first))
        total += n
    ratings = rows.withColumn("seq", F.col("seq") + base).drop("file")
    return Drop(
        ratings, spark.createDataFrame(table, FILES), path, version,
        {"rows": base + total, "folders": state["folders"]},
    )
