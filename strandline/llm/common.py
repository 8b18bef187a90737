"""What the operators of this subpackage share: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Rows of one Arrow batch that goes to Python; texts may be long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what one Arrow batch holds; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only if the session names none."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:/") else f"file://{found}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: later jobs start from there, whatever executor is lost."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of cut() that no later step reads."""
    remove(df.sparkSession, df._strandline_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, write: Callable[[pa.NativeFile], None]) -> None:
    """Writes a file under another name and then moves it, so that a task that runs again or twice leaves one whole file."""
    store, path = store_of(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as sink:
        write(sink)
    if store.get_file_info(path).type != fs.FileType.NotFound:  # not every store moves onto a file that is there
        store.delete_file(path)
    store.move(part, path)


def opened(uri: str) -> pa.NativeFile:
    """A file for random access; local ones are mapped into memory."""
    store, path = store_of(uri)
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def release() -> None:
    """Gives memory that a task no longer uses back to the system: Python workers live on, and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker keeps between tasks, by the name of its user; the steps of others clear it.
KEPT: dict[str, Callable[[], None]] = {}


def in_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, keeps: str = "") -> DataFrame:
    """mapInArrow that leaves the worker small.  keeps: whose kept memory the step goes on with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in KEPT if n != keeps]:
            KEPT.pop(name)()
        try:
            yield from step(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def unused(name: str, columns: list[str]) -> str:
    """A column name that none of these is."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


# Handing each scan partition what concerns it.


def stable(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, text and other columns, whose partitions are the same in every scan: a plain scan as it is (its plan has no step but these), anything else written first.

    How Spark splits files follows the number of cores it has unless spark.sql.files.minPartitionNum is set; so it is, to what they are
    now, since executors may come and go.  Later scans compare checksums of the texts all the same."""
    conf = docs.sparkSession.conf
    if not conf.get("spark.sql.files.minPartitionNum", None):
        conf.set("spark.sql.files.minPartitionNum", str(docs.sparkSession.sparkContext.defaultParallelism))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep])
    plan = [x.strip(" +-:*()0123456789").split(" ")[0].split("(")[0] for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if x.strip()]
    return rows if "FileScan" in plan and set(plan) <= {"FileScan", "Project", "Filter", "ColumnarToRow", "WholeStageCodegen"} else cut(rows, "texts")


def same_text(raw: list[bytes], rows: np.ndarray, sums: np.ndarray) -> None:
    """Stops the job if a scan's partitions hold other texts than in the first scan."""
    seen: dict[int, int] = {}
    for r, t in zip(rows.tolist(), sums.tolist(), strict=True):
        if seen.setdefault(r, t) != t or r >= len(raw):
            raise ValueError("the scan's partitions have changed")
    for r, t in seen.items():
        if zlib.crc32(raw[r]) != t:
            raise ValueError("the scan's partitions have changed")


def hand(df: DataFrame, label: str) -> str:
    path = new_folder(df.sparkSession, label)
    df.repartition(partitions(df.sparkSession), "part").write.partitionBy("part").parquet(path)
    return path


def handed(path: str, part: int) -> pa.Table | None:
    store, root = store_of(f"{path}/part={part}")
    if store.get_file_info(root).type == fs.FileType.NotFound:
        return None
    files = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
    tables = []
    for f in sorted(files):
        with store.open_input_file(f) as source:
            tables.append(pq.ParquetFile(source).read())
    return pa.concat_tables(tables) if tables else None
