"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_cleared: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset a temporary one is used if the master is local, as in tests.

    On a cluster a machine's own folder would be read by no other, so the setting is asked for.
    """
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="spark-cut-")
        base = f"file://{_own_folder}"
    return base.rstrip("/")


def _clear(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_folder(spark: SparkSession, kind: str = "cut") -> str:
    """A new folder's path in the shared one; all of an application's are removed when its driver ends."""
    folder = f"{shared_folder(spark)}/{kind}/{spark.sparkContext.applicationId}"
    if folder not in _cleared:
        _cleared.add(folder)
        atexit.register(_clear, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then start from files that every executor can read: a lost executor costs no
    recomputation, and two consumers of the result don't compute it twice.
    """
    path = fresh_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
