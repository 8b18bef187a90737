"""The folder that driver and executors share, for tables that must stay as they are."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; a local folder only if it names none and runs in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:/") else f"file://{found}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """A table whose partitions and their rows are the same in every later scan."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark removes the shuffle files of each finished action.  For steps that are taken one after the other, each of which writes what it leaves."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
