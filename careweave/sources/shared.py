"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


#: Folders of written tables, and those of the scratch that is open.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a new local folder only where it is unset and
    all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table written now: later plans start from it."""
    path = new_folder(df.sparkSession, name)
    # ids are hexadecimal digits, which take half the room with an entropy code
    df.write.mode("append").option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    if (kept := _SCRATCH.get()) is not None:
        kept.append(table)
    return table


def passes(table: DataFrame, most: int, buckets: int) -> int:
    """In how many passes over a written table each has at most so many bytes."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[table])
    n = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(1, min(buckets, -(-n // most)))


def dropped(*tables: DataFrame) -> None:
    """Written tables that no later plan reads go now, and with them what was shuffled to make
    them: Spark deletes that once the driver's garbage is collected."""
    for table in tables:
        if path := _FOLDERS.pop(table, None):
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if spark := SparkSession.getActiveSession():
        spark._jvm.java.lang.System.gc()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside go at the end, whether it succeeds or fails."""
    kept: list[DataFrame] = []
    token = _SCRATCH.set(kept)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        dropped(*kept)
