"""Intermediate tables in the folder that the driver and all executors share.

A table written here cuts the lineage of what comes after it and survives the
loss of any executor, unlike a cache or a local checkpoint.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in plain local mode a temporary one if that is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="cellwright-")
    return _own[sc.applicationId]


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cellwright-{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table."""
    if not _roots:
        atexit.register(_at_exit)
    _roots[_root(spark)] = spark
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


_roots: dict[str, SparkSession] = {}
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Delete the tables stored inside the block when it ends, but for those put into ``keep``.

    What is kept belongs to the scope around this one, if there is one.
    """
    _scopes.append([])
    try:
        yield
    finally:
        mine = _scopes.pop()
        kept = {df.__dict__.get("stored_at") for df in keep}
        for path in mine:
            if path in kept and _scopes:
                _scopes[-1].append(path)
            elif path not in kept:
                _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application. Results not yet consumed become unreadable."""
    _delete(spark, _root(spark))
    _roots.pop(_root(spark), None)


def _at_exit() -> None:
    for spark in list(_roots.values()):
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # the JVM is gone; the cluster's own clean-up has the rest
            return
