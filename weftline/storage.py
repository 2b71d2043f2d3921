"""Scratch tables in the folder that all executors share.

Iterative operators cut their lineage by writing each round as Parquet under
``spark.checkpoint.dir`` and reading it back. That costs one computation (an
eager ``checkpoint()`` costs two unless the rows are also cached), survives the
loss of any executor, and leaves the next round a plain file scan whose size
the optimizer knows.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_NUMBER = itertools.count()
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master with the setting unset
    gets a temporary folder; on a cluster the setting must be there."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="weftline-")
    return _LOCAL["dir"]


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def session_path(spark: SparkSession) -> str:
    """A folder of this run under the shared one; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/weftline-{_RUN}"
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/weftline-{_RUN}/{name}-{next(_NUMBER)}"
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob on whatever file system it names, sorted."""
    fs, p = _file_system(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file (a manifest, a configuration), None if it is not there."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _file_system(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


class Scratch:
    """A written table: ``df`` reads it, ``drop()`` deletes its files."""

    def __init__(self, df: DataFrame, name: str, partition_by: Iterable[str] = ()):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.partitionBy(*partition_by).parquet(self.path)
        # The schema is known, so that reading it back starts no inference job.
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a written table."""
    return Scratch(df, name).df
