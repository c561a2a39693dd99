"""Session builder and table loading shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "brindle", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI and AQE on.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster, where the
    submit configuration decides; tests and the bench pass local values.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= conf
    return builder.config(map=settings).getOrCreate()


def local_session(app: str = "brindle-local", cores: int | None = None, **conf: str) -> SparkSession:
    """A small single-machine session, for tests and the bench."""
    cores = cores or min(8, os.cpu_count() or 1)
    return build_session(
        app,
        master=f"local[{cores}]",
        shuffle_partitions=cores,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"} | conf,
    )


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one table; zone-less timestamps become UTC instants.

    The projection stays on top of the scan, so column pruning and filters
    on other columns still reach Parquet.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    naive = [name for name, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({name: F.col(name).cast("timestamp") for name in naive}) if naive else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` or an earlier call
    names it. A session on one machine (tests) without one gets a temporary folder,
    removed at exit; on a cluster that is an error, as executors share no local folder."""
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


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the session's JVM ends: what a
    result is read from must outlive the call that wrote it."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder and all in it."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _path(spark, folder)
    return files.exists(path)


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` now and cut its lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
