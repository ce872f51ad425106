"""Table tests on large tables: keys that occur twice, without shuffling the keys.

A key's hash names a cell, about 32 cells for each row. Tasks tell only which cells they
saw, and which of them more than once: sorted cells as differences, two to four bytes each,
cut by segments of the cells. Whoever merges a segment knows the cells that were seen twice.
Only rows of such cells, which are the true doubles and about one row in 32 more, are
grouped by their keys. A key with many rows is one cell of each task.

Several keys, and all tests that look at one row at a time, share a scan.

Defined cases: a key with a null in any column is not tested; keys are equal as ``groupBy``
has it (-0.0 is 0.0, NaN is NaN); an empty table has no doubles; repeated rows are doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweave.sources.shared import written

#: Cells for each row, and rows for each segment, as powers of two.
SPARE_BITS, SEGMENT_BITS = 5, 22
#: Cells that a task holds before it sends them on.
HELD = 4_000_000
#: Doubled cells that are broadcast (16 MB); more are joined by shuffle.
BROADCAST_CELLS = 1_000_000


def packed(cells: np.ndarray) -> bytes:
    """Sorted distinct cells as differences, in as few bytes as the greatest one needs."""
    steps = np.diff(cells, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if int(steps.max(initial=0)) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + steps.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64))


def _told(keys: Sequence[np.ndarray], shift: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(test, segment, cells seen, cells seen again) of what a task holds of each test."""
    for test, held in enumerate(keys):
        cells, counts = np.unique(held, return_counts=True)
        segments, starts = np.unique(cells >> shift, return_index=True)
        ends = np.append(starts, len(cells))[1:]
        for segment, a, z in zip(segments.tolist(), starts, ends, strict=True):
            inside = cells[a:z] - (segment << shift)
            yield test, segment, packed(inside), packed(inside[counts[a:z] > 1])


def _cells(df: DataFrame, keys: Mapping[str, Sequence[str]], bits: int) -> list[Column]:
    """The cell of each key of a row, null where the key has a null."""
    known = lambda columns: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return [F.when(known(columns), F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits)) for columns in keys.values()]


def doubled_cells(df: DataFrame, keys: Mapping[str, Sequence[str]], bits: int, segment_bits: int = SEGMENT_BITS, held: int = HELD) -> DataFrame:
    """(test, cell): cells that two rows or more have; tests are numbered as in ``keys``."""
    shift = min(bits, segment_bits + SPARE_BITS)
    kind = "test int, segment long, seen binary, again binary"
    schema = pa.schema([("test", pa.int32()), ("segment", pa.int64()), ("seen", pa.binary()), ("again", pa.binary())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in keys]
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(_told([np.concatenate(x) if x else np.zeros(0, np.int64) for x in kept], shift))
            for i in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 1000], strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for column, mine in zip(b.columns, kept, strict=True):
                mine.append(column.drop_null().to_numpy())
            n += b.num_rows * len(kept)
            if n >= held:
                yield from flush()
                kept, n = [[] for _ in keys], 0
        yield from flush()

    def merge(told: pa.Table) -> pa.Table:
        test, segment = told.column("test")[0].as_py(), told.column("segment")[0].as_py()
        cells, counts = np.unique(np.concatenate([unpacked(x) for x in told.column("seen").to_pylist()]), return_counts=True)
        again = [cells[counts > 1], *(unpacked(x) for x in told.column("again").to_pylist())]
        found = np.unique(np.concatenate(again)) + (segment << shift)
        return pa.table({"test": pa.array(np.full(len(found), test, np.int32)), "cell": pa.array(found)})

    cells = df.select(*(c.alias(f"c{k}") for k, c in enumerate(_cells(df, keys, bits))))
    return cells.mapInArrow(tell, kind).groupBy("test", "segment").applyInArrow(merge, "test int, cell long")


def candidates(df: DataFrame, keys: Mapping[str, Sequence[str]], broadcast: int = BROADCAST_CELLS, **how) -> DataFrame:
    """(test, key columns) of all rows whose cell is doubled: all rows of doubled keys, and
    a few others. Columns of other tests are null."""
    columns = list(dict.fromkeys(c for x in keys.values() for c in x))
    bits = min(62, max(SPARE_BITS, math.ceil(math.log2(max(1, df.count()))) + SPARE_BITS))
    found = written(doubled_cells(df, keys, bits, **how), "doubled-cells")
    few = found.count() <= broadcast
    tested = [F.struct(F.lit(k).alias("test"), c.alias("cell")) for k, c in enumerate(_cells(df, keys, bits))]
    each = df.select(*columns, F.explode(F.array(*tested)).alias("at")).where("at.cell IS NOT NULL").select(*columns, "at.*")
    near = each.join(F.broadcast(found) if few else found, ["test", "cell"], "left_semi")
    mine = lambda c: F.col("test").isin([k for k, x in enumerate(keys.values()) if c in x])
    return near.select("test", *(F.when(mine(c), F.col(c)).alias(c) for c in columns))


def doubles(df: DataFrame, keys: Mapping[str, Sequence[str]], **how) -> DataFrame:
    """(test, key columns, n) of each key that occurs n > 1 times; ``keys`` names the columns
    of each test."""
    rows = candidates(df, keys, **how)
    named = F.element_at(F.array(*map(F.lit, keys)), F.col("test") + 1)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).where("n > 1").withColumn("test", named)


def report(df: DataFrame, not_null: Sequence[str] = (), accepted: Mapping[str, Sequence[str]] | None = None, unique: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(test, subject, violations, failed): rows that break each test, in one scan for all tests
    of single rows; for ``unique`` the rows of a key beyond its first. Failed: any violation."""
    wrong = {("not_null", c): F.col(c).isNull() for c in not_null}
    wrong |= {("accepted_values", c): F.col(c).isNotNull() & ~F.col(c).isin(*values) for c, values in (accepted or {}).items()}
    parts = []
    if wrong:
        counts = df.agg(*(F.count_if(x).alias(f"v{k}") for k, x in enumerate(wrong.values())))
        lines = F.array(*(F.struct(F.lit(t).alias("test"), F.lit(c).alias("subject"), F.col(f"v{k}").alias("violations")) for k, (t, c) in enumerate(wrong)))
        parts.append(counts.select(F.inline(lines)))
    if unique:
        spare = doubles(df, unique).groupBy(F.col("test").alias("subject")).agg(F.sum(F.col("n") - 1).alias("violations"))
        names = df.sparkSession.createDataFrame([(x,) for x in unique], "subject string")
        parts.append(names.join(spare, "subject", "left").select(F.lit("unique").alias("test"), "subject", F.coalesce("violations", F.lit(0)).alias("violations")))
    return reduce(DataFrame.union, parts).withColumn("failed", F.col("violations") > 0)
