"""Windows over keys of any size, by slices of a key's time.

A placeholder record number may be the key of half of all rows, and a window partitioned by
the key alone is then one task's work. Here the rows of heavy keys are cut into slices of
time, each about a thousandth of all rows; a window runs inside a slice, an associative
summary of each slice (a sum, a maximum, a last value) runs over the slices of its key, and
what comes before a slice is brought to its rows. Rows, numbers and order are those of a
window over the whole key.

Heavy keys hold more than a 500th of the rows each, so there are fewer than 500 of them and
fewer than 2,000 slices: the summaries are broadcast. Where no key is heavy, which is most
often so, nothing is joined and the plan is that of plain windows. A key's time is divided
into 4,096 equal cells; rows within one cell (such as those of one instant) stay together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careweave.sources.shared import written

SHARE, CELLS = 500, 4096


def _same(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])


def _attached(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of few ``facts``, by keys that may be null."""
    for k in keys:
        facts = facts.withColumnRenamed(k, f"_of_{k}")
    return df.join(F.broadcast(facts), _same(keys), how).drop(*(f"_of_{k}" for k in keys))


class Slices:
    """Slices of the keys of a table. ``cells``: (keys, _lo, _width, _slices) of heavy keys."""

    def __init__(self, keys: Sequence[str], cells: DataFrame | None = None) -> None:
        self.keys, self.cells = list(keys), cells

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], at: str, rows: int) -> Slices:
        """Keys of more than ``rows`` rows, and of more than a 500th of all, are cut by the
        timestamp ``at``, by which their order begins."""
        n = df.count()
        limit = max(rows, n // SHARE)
        if n <= limit:
            return cls(keys)
        micros = F.unix_micros(at)
        heavy = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(micros).alias("_lo"), F.max(micros).alias("_hi")).where((F.col("_n") > limit) & F.col("_lo").isNotNull())
        heavy = written(heavy.select(*keys, "_lo", F.expr(f"(_hi - _lo) div {CELLS} + 1").alias("_width")), "heavy-keys")
        if heavy.isEmpty():
            return cls(keys)
        cell = F.expr(f"coalesce((unix_micros({at}) - _lo) div _width, 0)").cast("int")
        counted = _attached(df.select(*keys, at), heavy, keys, "inner").groupBy(*keys, cell.alias("_cell")).agg(F.count("*").alias("_n"))
        places = heavy.select("*", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("_cell"))
        for k in keys:
            counted = counted.withColumnRenamed(k, f"_of_{k}")
        dense = places.join(counted.withColumnRenamed("_cell", "_in"), _same(keys) & (F.col("_cell") == F.col("_in")), "left")
        before = F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
        dense = dense.withColumn("_slice", F.floor(F.coalesce(before, F.lit(0)) / F.lit(max(1, limit // 2))).cast("int"))
        cells = dense.groupBy(*keys, "_lo", "_width").agg(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "_slice"))), lambda x: x["_slice"]).alias("_slices"))
        return cls(keys, written(cells, "slices"))

    def cut(self, df: DataFrame, at: str) -> DataFrame:
        """``df`` with the slice of each row; as it is if no key is heavy."""
        if self.cells is None:
            return df
        found = F.expr(f"get(_slices, cast(coalesce((unix_micros({at}) - _lo) div _width, 0) as int))")
        out = _attached(df, self.cells, self.keys)
        return out.withColumns({"_slice": F.coalesce(found, F.lit(0)), "_cut": F.col("_slices").isNotNull()}).drop("_lo", "_width", "_slices")

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop("_slice", "_cut")

    def running(self, df: DataFrame, order: Sequence[Column], **wanted: tuple[str, Column]) -> DataFrame:
        """Adds running values of each key in ``order``. Kinds: ``sum`` of the rows up to and
        with this one, ``max`` of those before it, ``last`` value that isn't null of those
        before it, ``latest``: the same with this one."""
        order = [o.alias(f"_o{i}") for i, o in enumerate(order)]
        df = df.withColumns({f"_v_{name}": value for name, (_, value) in wanted.items()})
        local = Window.partitionBy(*self.keys, *(["_slice"] if self.cells is not None else [])).orderBy(*order)
        upto, before = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
        value = lambda name: F.col(f"_v_{name}")
        kinds = {
            "sum": lambda v: F.sum(v).over(upto),
            "max": lambda v: F.max(v).over(before),
            "last": lambda v: F.last(v, ignorenulls=True).over(before),
            "latest": lambda v: F.last(v, ignorenulls=True).over(upto),
        }
        out = df.withColumns({name: kinds[kind](value(name)) for name, (kind, _) in wanted.items()})
        if self.cells is not None:
            place = F.struct(*order)
            sums = {"sum": F.sum, "max": F.max}
            whole = {n: sums[k](value(n)) if k in sums else F.max_by(value(n), F.when(value(n).isNotNull(), place)) for n, (k, _) in wanted.items()}
            parts = df.where("_cut").groupBy(*self.keys, "_slice").agg(*(c.alias(f"_c_{n}") for n, c in whole.items()))
            earlier = Window.partitionBy(*self.keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
            over = {"sum": lambda c: F.sum(c).over(earlier), "max": lambda c: F.max(c).over(earlier)}
            carry = parts.select(*self.keys, "_slice", *(over.get(k, lambda c: F.last(c, ignorenulls=True).over(earlier))(F.col(f"_c_{n}")).alias(f"_c_{n}") for n, (k, _) in wanted.items()))
            out = _attached(out, written(carry, "carry"), [*self.keys, "_slice"])
            join = {"sum": lambda a, c: F.coalesce(a + F.coalesce(c, F.lit(0)), c), "max": F.greatest}
            out = out.withColumns({n: join.get(k, F.coalesce)(F.col(n), F.col(f"_c_{n}")) for n, (k, _) in wanted.items()}).drop(*(f"_c_{n}" for n in wanted))
        return out.drop(*(f"_v_{name}" for name in wanted))

    def least(self, df: DataFrame, group: Sequence[str], **wanted: Column) -> DataFrame:
        """Adds the least value of each group, whose rows follow each other in one key."""
        sliced = self.cells is not None
        w = Window.partitionBy(*group, *(["_slice"] if sliced else []))
        out = df.withColumns({name: F.min(value).over(w) for name, value in wanted.items()})
        if sliced:
            # a slice's end is crossed by one group at most
            crossing = df.where("_cut").groupBy(*group).agg(*(F.min(v).alias(f"_c_{n}") for n, v in wanted.items()), F.min("_slice").alias("_a"), F.max("_slice").alias("_z")).where("_a < _z").drop("_a", "_z")
            out = _attached(out, written(crossing, "crossing"), group)
            out = out.withColumns({n: F.least(F.col(n), F.col(f"_c_{n}")) for n in wanted}).drop(*(f"_c_{n}" for n in wanted))
        return out
