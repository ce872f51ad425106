"""Doubled keys by cells against plain grouping."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from careweave.operators import doubles

KEYS = {"one": ["k"], "two": ["a", "b"], "number": ["x"]}


def table(spark, n=4000, seed=5):
    r = random.Random(seed)
    rows = [(f"k{r.randrange(3 * n)}" if r.random() < 0.6 else "hot", r.choice([None, "p", "q", ""]), r.randrange(n), r.choice([0.0, -0.0, float("nan"), None, r.random()])) for _ in range(n)]
    return spark.createDataFrame(rows, "k string, a string, b int, x double").repartition(5)


def plain(df, keys):
    out = []
    for name, columns in keys.items():
        known = df.dropna(subset=[c for c in columns if c != "x"]).where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
        for r in known.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").collect():
            out.append((name, *(str(r[c]) if c in columns else "None" for c in ("k", "a", "b", "x")), r["n"]))
    return sorted(out)


def shown(found):
    return sorted((r["test"], *(str(r[c]) for c in ("k", "a", "b", "x")), r["n"]) for r in found.collect())


@pytest.mark.parametrize("how", [{}, {"held": 300, "segment_bits": 6}, {"broadcast": 0}])
def test_doubles_equal_grouping(spark, how):
    df = table(spark)
    assert shown(doubles.doubles(df, KEYS, **how)) == plain(df, KEYS) != []


def test_few_rows_are_grouped(spark):
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 1000 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    rows = doubles.candidates(df, {"k": ["k"]})
    true = n // 1000 + 1
    assert true <= rows.count() < true + n / 16
    assert doubles.doubles(df, {"k": ["k"]}).collect() == [("k", 7, true)]
    # what tasks send: about two bytes for each row, and a hot key is one cell
    told = list(doubles._told([np.random.default_rng(1).integers(0, 1 << 21, 1 << 16)], 27))
    assert len(told) == 1 and len(told[0][2]) < 2.1 * (1 << 16)
    assert len(list(doubles._told([np.zeros(100_000, np.int64)], 27))[0][2]) == 2


def test_cells_are_packed_without_loss():
    for top in (1, 200, 60_000, 1 << 31, 1 << 61):
        cells = np.unique(np.random.default_rng(top % 97).integers(0, top, 500))
        assert (doubles.unpacked(doubles.packed(cells)) == cells).all()
    assert len(doubles.unpacked(doubles.packed(np.zeros(0, np.int64)))) == 0


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "k string, a string, b int, x double")
    assert doubles.doubles(empty, KEYS).count() == 0
    got = doubles.report(empty, ["k"], {"a": ["p"]}, {"one": ["k"]}).collect()
    assert sorted(map(tuple, got)) == [("accepted_values", "a", 0, False), ("not_null", "k", 0, False), ("unique", "one", 0, False)]
    nulls = spark.createDataFrame([(None, "z", 1, None)] * 3 + [("v", None, 1, 1.0)] * 4, empty.schema)
    got = {r["subject"]: r["violations"] for r in doubles.report(nulls, ["a"], {"k": ["w"]}, {"one": ["k"], "two": ["a", "b"]}).collect()}
    assert got == {"a": 4, "k": 4, "one": 3, "two": 2}
