"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
WORD_SPACE = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB, so that long texts don't add up in a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all
    runs on one machine, as in tests, a new local folder is made and remembered.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Cut the lineage of ``df`` by a Parquet table in the shared folder. The table that it
    was made from, and that nothing else will read, may be given up for it.

    Whoever doesn't clear the table leaves it until the application ends."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    until_the_end(spark, path)
    if instead_of is not None:
        for old in {f.rpartition("/")[0] for f in instead_of.inputFiles()}:
            _delete(spark, old)
    _tables().append(path)
    return spark.read.schema(df.schema).parquet(path)


_OF_THREAD = threading.local()


def _tables() -> list[str]:
    """Tables written by this thread that nobody has deleted: queries of other threads
    have lists of their own."""
    if not hasattr(_OF_THREAD, "tables"):
        _OF_THREAD.tables = []
    return _OF_THREAD.tables


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def until_the_end(spark: SparkSession, path: str) -> None:
    """Delete a folder that is there when the application ends."""
    at, files = _place(spark, path)
    files.deleteOnExit(at)


def _delete(spark: SparkSession, path: str) -> None:
    at, files = _place(spark, path)
    files.delete(at, True)


def clear(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables that this thread wrote after its first ``since``, but for the last
    ``keep``."""
    tables = _tables()
    for path in tables[since : len(tables) - keep]:
        _delete(spark, path)
    tables[since : len(tables) - keep] = []


def n_tables() -> int:
    return len(_tables())


def whole_vectors(df: DataFrame, vector_col: str) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector_col).isNotNull() & F.coalesce(good, F.lit(False))


#: Keys that hold more than one in so many rows are hot: there are fewer of them than that.
HOT_SHARE = 1000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of their key's line in ``facts`` (null is a key, too).

    ``weight`` is the column of ``facts`` that counts the rows of a key. Keys of more than a
    thousandth of all rows are fewer than a thousand, so their lines are broadcast and the
    rows stay where they are; the rows of all other keys are joined by shuffle."""
    n = facts.agg(F.sum(weight)).first()[0] or 0
    same = F.col(key).eqNullSafe(F.col("_key"))
    facts = facts.withColumnRenamed(key, "_key")
    hot = F.broadcast(facts.where(F.col(weight) * HOT_SHARE > n))
    cold = rows.join(hot.select("_key"), same, "left_anti").join(facts.where(F.col(weight) * HOT_SHARE <= n), same)
    return rows.join(hot, same).unionByName(cold).drop("_key", weight)


def crc_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def text_key(text_col: str) -> Column:
    """128-bit content key of a text; a null text counts as the empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def word_count(text_col: str) -> Column:
    """Number of matches of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
