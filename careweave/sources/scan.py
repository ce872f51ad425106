"""Scans of source tables, and sinks. Everything is lazy but for the sinks' writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careweave.config import Source
from careweave.functions import rules


def lookback_hours(lookback: dict[str, str], kind: str) -> int:
    """``24h``, ``3d`` or plain hours; the kind's entry or the default one."""
    text = str(lookback.get(kind, lookback.get("default", "24h"))).strip().lower()
    return int(text[:-1]) * 24 if text.endswith("d") else int(text.removesuffix("h"))


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A source table in any format that Spark reads (parquet, csv, json, orc, jdbc ...)."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load(path) if path else reader.load()


def incremental(df: DataFrame, key: str, watermark=None, hours: int = 0, mode: str = "incremental") -> DataFrame:
    """Rows whose key is after the watermark less the look-back; all in full mode or
    without a watermark. The comparison reaches the scan as a pushed filter."""
    if mode != "incremental" or watermark is None:
        return df
    return df.where(F.col(key) > F.lit(watermark) - F.expr(f"INTERVAL {hours} HOURS"))


def exclude(df: DataFrame, predicate: str | None) -> DataFrame:
    """Without rows of the predicate, nor those where it is null."""
    return df.where(f"NOT ({predicate})") if predicate else df


def first_per_record(df: DataFrame, record_id: str, key: str) -> DataFrame:
    """First row of each record by the incremental key; rows without an id all stay."""
    row = F.xxhash64(*df.columns)
    # one pass; rows without an id are spread by their content instead of meeting in one task
    spread = F.when(F.col(record_id).isNull(), row)
    nth = F.row_number().over(Window.partitionBy(record_id, spread).orderBy(F.col(key).asc_nulls_last(), row))
    return df.withColumn("_nth", nth).where(F.col(record_id).isNull() | (F.col("_nth") == 1)).drop("_nth")


def annotate(df: DataFrame, source: Source, payload: bool = False) -> DataFrame:
    """Source name and kind; the raw row as JSON only on demand, as it needs all columns."""
    extra = {"_source_name": F.lit(source.name), "_source_type": F.lit(source.kind)}
    return df.withColumns(({"_raw_payload": F.to_json(F.struct("*"))} if payload else {}) | extra)


def scan(df: DataFrame, source: Source, watermark=None, lookback: dict[str, str] | None = None, mode: str = "full", payload: bool = False) -> DataFrame:
    rows = incremental(df, source.incremental_key, watermark, lookback_hours(lookback or {}, source.kind), mode)
    return annotate(first_per_record(exclude(rows, source.exclude), source.fields["source_record_id"], source.incremental_key), source, payload)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def watermarks(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, value) with the largest incremental key of each source."""
    return union_all([df.agg(F.max(key).cast("string").alias("value")).select(F.lit(f"watermark_{name}").alias("key"), "value") for name, (df, key) in frames.items()])


def advance(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """The stored watermarks (key, value) after a run that saw others; none goes back.

    They are compared as times, however they are written; what is no time loses."""
    rows = stored.unionByName(seen).where("value IS NOT NULL")
    return rows.groupBy("key").agg(F.max_by("value", F.struct(rules.parse_ts(F.col("value")), "value")).alias("value"))


def last_of_each(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The last row of each key by ``order``; by content if that leaves a tie or is missing."""
    content = F.xxhash64(*df.columns)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order or []), content))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def keeping(new: DataFrame, old: DataFrame, key: str, column: str) -> DataFrame:
    """``new`` with a column as it was for keys that were there (a creation time, say)."""
    before = old.select(key, F.col(column).alias("_kept"))
    return new.join(before, key, "left").withColumn(column, F.coalesce("_kept", column)).drop("_kept")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None, keep: str | None = None) -> DataFrame:
    """``old`` with rows of ``new`` in place of those of the same key, each key once.

    ``order``: the last row of a key in ``new`` counts. ``keep``: this column stays as it
    was for keys that were there."""
    new = last_of_each(new, key, [order] if order else None)
    if keep:
        new = keeping(new, old, key, keep)
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """``old`` without the children of the parents in ``new``, and ``new``."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def recent_history(history: DataFrame, batch: DataFrame, as_of, days: int) -> DataFrame:
    """The batch and what is stored of its patients since so many days; the batch wins."""
    kept = history.join(batch.select("patient_key").distinct(), "patient_key", "left_semi").where(F.col("event_ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    return kept.join(batch.select("event_id"), "event_id", "left_anti").unionByName(batch, allowMissingColumns=True)


def refresh_mart(source: DataFrame, mart: DataFrame, key: str, stamp: str = "updated_at") -> DataFrame:
    """Rows of ``source`` stamped after all of ``mart`` are merged into it by key."""
    last = mart.agg(F.max(stamp).alias("_last"))
    fresh = source.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(stamp) > F.col("_last"))).drop("_last")
    return upsert(mart, fresh, key)


def insert_new(source: DataFrame, mart: DataFrame, key: str) -> DataFrame:
    return mart.unionByName(source.join(mart.select(key), key, "left_anti"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def full_refresh(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def publish(df: DataFrame, columns: list[str], path: str) -> None:
    """A mart that is a plain projection of a table."""
    df.select(*columns).write.mode("overwrite").parquet(path)
