"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Java form of the word separator: ASCII white space only.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where neither ``spark.checkpoint.dir`` nor an earlier call set one, a session
    on one machine (tests) gets a temporary folder, removed at exit. On a cluster
    that is an error: a folder of the driver's machine is not shared.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the session's JVM ends: what a
    result is read from must outlive the call that wrote it."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that :func:`scratch_folder` gave, or one in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` now and cut its lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def counted_cut(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut`, and the number of its rows, counted as they are written: no job goes
    through them again. Tasks that Spark repeats may count twice, so it is at least the number."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return done, seen.get["n"]


#: Of each module, by name, what its tasks leave in a Python worker for later ones.
KEPT: dict[str, dict] = {}


def trim() -> None:
    """Give back what Arrow and the C library hold unused (the latter under glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def settled(batches: Iterator[pa.RecordBatch], keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches of a task. Before each one Arrow gives back what it holds unused, which
    a reused Python worker otherwise keeps from batch to batch and from task to task.

    Of :data:`KEPT` only what the task ``keeps`` stays: a worker that goes on to another
    kind of task has no use for the rest, and would hold it beside its new work."""
    for name, kept in KEPT.items():
        if name != keeps:
            kept.clear()
    trim()
    for batch in batches:
        pa.default_memory_pool().release_unused()
        yield batch
        del batch
    trim()


def hex60(key: Column) -> Column:
    """The first 60 bits of a string's MD5 as a non-negative long; null as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
