"""Where intermediate tables live, and the sizes that decide between join strategies."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table is broadcast only when its counted rows fit in this many bytes.
BROADCAST_BYTES = 256 * 1024 * 1024


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    A local session without that setting gets a fresh temporary folder. On a cluster a
    machine-local folder would be lost with its executor, so an unset folder is an error there.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ratingloom-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/ratingloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage, survives executor loss, and gives Catalyst true file sizes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of scratch tables that nothing reads any more.

    Only files in the scratch folder are touched.
    """
    for df in tables:
        spark = df.sparkSession
        root = f"{scratch_root(spark)}/ratingloom/".split("://")[-1].split(":", 1)[-1].lstrip("/")
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if root in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES
