"""Session, table access, lineage cuts and shipping of Python code to executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import sys
import tempfile
import time

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as tests and the benchmark use it; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodecast")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; on a local master without it a temporary one, which is deleted at the end."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodecast-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, so that a lost executor costs nothing before it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has shuffle files and checkpoints that no table needs any longer deleted; else they stay until the driver happens to collect its garbage, which doesn't depend on the disk."""
    for pause in (0.5, 0):  # listeners hold a query a little longer
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def broadcast_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, marked to be broadcast where it has no more than `rows` rows, which are few columns of categories; else left to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship_by_value(module: str) -> None:
    """Pickles the functions of a module with their code, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def smoke_folder() -> str:
    return os.environ.get("SMOKE_SF_DIR", "/root/testdata/sf0.001")


def bench_folder() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def worker_cache() -> dict:
    """A dict that a Python worker keeps from task to task."""
    import types

    return sys.modules.setdefault("_lodecast_worker_cache", types.ModuleType("_lodecast_worker_cache")).__dict__
