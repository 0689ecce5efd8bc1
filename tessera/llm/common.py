"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: list[str] = []
#: Folders of the tables that cut() returned, by identity.
_paths: dict[int, str] = {}
#: How to empty the caches that this Python worker keeps between tasks, by operator.
_held: dict[str, Callable[[], None]] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of words for the operators that count words or shingles.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, whose tasks run on this machine, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _local_dir[0]


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_remove, spark, path)
    gc.collect()
    if hasattr(spark, "_jvm"):
        spark._jvm.System.gc()  # lets Spark drop the shuffle files that only this write needed
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python few rows at a time, so that what a worker and its buffers hold stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def drop(*written: DataFrame) -> None:
    """Remove tables that cut() returned, once all that reads them has been written."""
    for df in written:
        _remove(df.sparkSession, _paths[id(df)])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is None:
            return
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may have ended; the folder's owner clears it then
        pass


def begin(operator: str, empty: Callable[[], None] | None = None) -> None:
    """Called in a worker as a task begins. Spark hands a worker from one operator to the next, so what others remember is emptied, and the memory returned; ``empty`` says how, once this one's turn is over."""
    others = [_held.pop(k) for k in [*_held] if k != operator]
    if empty:
        _held[operator] = empty
    if others:
        for forget in others:
            forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, UPPER, UPPER.lower())


def fields(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns under internal names, so that other columns of the input can't clash: fields(df, doc_id="id")."""
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
