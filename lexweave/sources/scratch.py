"""Folders for tables that live as long as the driver."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, kind: str) -> str:
    """Where loaded tables go: the shared folder of a cluster, a temporary one of a local session. Removed when the driver ends."""
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        path = tempfile.mkdtemp(prefix=f"lexweave-{kind}-")
    else:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{base.rstrip('/')}/lexweave-{kind}-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    return path


def written(frame: DataFrame, kind: str) -> DataFrame:
    """``frame`` as a Parquet table of its own: what is read several times is computed once."""
    path = f"{folder(frame.sparkSession, kind)}/rows"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a scratch path as a task's Python sees it, and the path within it."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


@atexit.register
def cleanup() -> None:
    """Best-effort removal of all that was loaded."""
    for spark, path in _FOLDERS:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already at interpreter exit
            pass
    _FOLDERS.clear()
