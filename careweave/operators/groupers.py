"""Episode types from tables of DRG ranges and diagnosis prefixes, of any size.

Distinct numbers and codes are looked up once, and come back to the rows by an equi-join.
Ranges lie in cells of equal width, a range in each that it reaches, so a number is compared
with the ranges of its cell; a code is looked for by each of its beginnings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careweave import config

RANGES = "type string, low int, high int, rank int"
PREFIXES = "type string, prefix string, rank int"
#: Numbers of a cell, and letters of a prefix at most.
CELL, LONGEST = 64, 8


def default_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The built-in types: earlier ones win."""
    ranges = [(name, a, z, i) for i, (name, pairs) in enumerate(config.DRG_RANGES.items()) for a, z in pairs]
    prefixes = [(name, p, i) for i, (name, words) in enumerate(config.DIAGNOSIS_PREFIXES.items()) for p in words]
    return spark.createDataFrame(ranges, RANGES), spark.createDataFrame(prefixes, PREFIXES)


def by_range(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """(number, type): the type of the first range by rank that holds the number; others are missing."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    laid = ranges.where("low <= high").withColumn("_cell", F.explode(F.sequence(cell("low"), cell("high"))))
    asked = numbers.where("number IS NOT NULL").select("number").distinct().withColumn("_cell", cell("number"))
    met = asked.join(laid, "_cell").where(F.col("number").between(F.col("low"), F.col("high")))
    return met.groupBy("number").agg(F.min_by("type", F.struct("rank", "low", "type")).alias("type"))


def by_prefix(codes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(code, type): the type of the first prefix by rank that the code begins with."""
    asked = codes.where("code IS NOT NULL").select("code").distinct()
    parts = asked.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("code"), F.lit(LONGEST))), lambda n: F.substring("code", F.lit(1), n))))
    return parts.join(prefixes, "prefix").groupBy("code").agg(F.min_by("type", F.struct("rank", "prefix", "type")).alias("type"))


def typed(rows: DataFrame, ranges: DataFrame, prefixes: DataFrame, code: str = "code", drg: str = "drg", otherwise: str = "unclassified") -> DataFrame:
    """Adds ``episode_type``: by the DRG if it is in a range, else by the diagnosis code."""
    rows = rows.withColumns({"_number": F.col(drg).try_cast("int"), "_code": F.replace(F.upper(code), F.lit("."), F.lit(""))})
    numbers = by_range(rows.select(F.col("_number").alias("number")), ranges).select(F.col("number").alias("_number"), F.col("type").alias("_by_drg"))
    codes = by_prefix(rows.select(F.col("_code").alias("code")), prefixes).select(F.col("code").alias("_code"), F.col("type").alias("_by_code"))
    out = rows.join(numbers, "_number", "left").join(codes, "_code", "left")
    return out.withColumn("episode_type", F.coalesce("_by_drg", "_by_code", F.lit(otherwise))).drop("_number", "_code", "_by_drg", "_by_code")
