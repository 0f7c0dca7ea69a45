"""Session settings the engine relies on, and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Log times carry no zone of their own; every operator works in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``; where that is
    unset, a folder in the session's warehouse, which executors share as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return (configured or f"{warehouse}/_work").rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and how it names paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder below :func:`work_dir`, deleted when the session's JVM ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = file_system(spark, path)
    files.mkdirs(at(path))
    files.deleteOnExit(at(path))
    return path


@contextmanager
def open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, a task that writes by partition columns keeps up to ``most`` files open.

    Else it sorts its rows by those columns first, and holds all of them to do so.
    Beyond ``most`` files it sorts the rows that are left.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)
