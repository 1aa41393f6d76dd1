"""The folder that driver and executors share, and what is written there."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master without it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tallyweave-')}"
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint(rows: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


#: Folders of work_dir, which are removed when the driver ends.
_MADE: list[str] = []


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder in the shared folder, removed when the driver ends."""
    _MADE.append(new_dir(spark, what))
    return _MADE[-1]


def remove(folder: str) -> None:
    with contextlib.suppress(OSError):
        fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1))
        fs.delete_dir(path)


@atexit.register
def _remove_all() -> None:
    while _MADE:
        remove(_MADE.pop())


def stored(rows: DataFrame, folder: str) -> DataFrame:
    """rows, written to a folder and read from there."""
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what is referred to no more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
