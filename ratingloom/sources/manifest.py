"""Manifests: small JSON files that say which folders of a stored result count.

Data goes to folders with names of their own first; a manifest that names them is then published under
the next version number, by a rename. So a reader sees the result before a write or after it and
never half of it, and a job that is ended in between leaves folders that nothing refers to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_manifest"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def latest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The newest version and its content; ``(0, None)`` if there is none."""
    system, folder = _file_system(spark, f"{path}/{FOLDER}")
    if not system.exists(folder):
        return 0, None
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    versions = [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]
    if not versions:
        return 0, None
    stream = system.open(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{max(versions):08}.json"))
    try:
        return max(versions), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, content: dict, after: int) -> int:
    """Store ``content`` as the version that follows ``after``; fails if somebody else was first."""
    system, folder = _file_system(spark, f"{path}/{FOLDER}")
    make = spark._jvm.org.apache.hadoop.fs.Path
    system.mkdirs(folder)
    target, draft = make(folder, f"{after + 1:08}.json"), make(folder, f".{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(json.dumps(content, sort_keys=True).encode())
    out.close()
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise FileExistsError(f"{path}: version {after + 1} has been published by another writer")
    return after + 1


def fresh_folder(label: str) -> str:
    """A folder name that no other write uses."""
    return f"{label}-{uuid.uuid4().hex}"
