"""Tables laid out for the search of single keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a row group: a search reads at least one.
GROUP_BYTES = 1 << 20


def write_sorted(df: DataFrame, path: str, key: str, filters: dict[str, int] | None = None, files: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Write ``df`` in ranges of ``key``, so that a search for one opens one row group.

    ``filters``: other columns that are searched for, with their number of distinct values in
    a file; a Bloom filter in each row group tells where such a value can't be."""
    df = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    writer = df.sortWithinPartitions(key).write.option("parquet.block.size", group_bytes).option("parquet.page.size", group_bytes // 16)
    for column, n in (filters or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", n)
    writer.parquet(path)


def found(df: DataFrame, **values: str | int) -> DataFrame:
    """Rows with these values; literals of the columns' own types, so that files are skipped."""
    for column, value in values.items():
        df = df.where(F.col(column) == F.lit(value).cast(df.schema[column].dataType))
    return df
