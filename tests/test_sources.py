"""Similar names, databases, look-ups, groupers and the registry's upkeep."""

import random

import pytest
from pyspark.sql import functions as F

from careweave import source_queries
from careweave.config import Settings
from careweave.functions import rules, similarity
from careweave.operators import facility, groupers
from careweave.sources import database, lookups

WORDS = ["ALDER", "CREEK", "STONE", "BRIDGE", "FERN", "HILL", "WILLOW", "BEND", "CEDAR", "FLATS", "RIVER", "MERCY", "SAINT", "LUKE", "MARY", "GENERAL", "REGIONAL", "COMMUNITY", "É9", "X"]


def names(n, seed):
    r = random.Random(seed)
    return sorted({" ".join(r.choice(WORDS) for _ in range(r.randint(1, 4))) for _ in range(n)})


def misspelt(name, r):
    letters = list(name)
    for _ in range(r.randint(0, 4)):
        k = r.randrange(len(letters))
        letters[k : k + 1] = r.choice([[], [letters[k]] * 2, ["Q"], [" "]])
    return " ".join("".join(letters).split())


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.95])
def test_similar_names_share_a_first_key(threshold):
    r = random.Random(5)
    index = names(250, 1) + [" ".join(WORDS[:12]), " ".join(WORDS[1:13]), "A", ""]
    asked = [misspelt(n, r) if n else n for n in index[::3]] + ["", " ".join(WORDS[:11]) + " LUKES"]
    letters = "".join(index)
    weights = (*(letters.count(k) for k in similarity.KINDS), 3)
    for a in asked:
        mine = set(similarity.keys(a, weights, threshold))
        for b in index:
            if (a or b) and similarity.token_sort_ratio(a, b) >= threshold:
                key = similarity.first_key(a, b, weights, threshold)
                assert key in mine and key in set(similarity.keys(b, weights, threshold))
                bits = [similarity.signature(similarity.letter_counts(x), weights) for x in (a, b)]
                assert (bits[0] ^ bits[1]).bit_count() <= similarity.apart(len(a), len(b), threshold)


def test_best_similar_name_equals_brute_force(spark):
    r = random.Random(7)
    index = names(400, 2)
    asked = [n for n in {misspelt(n, r) for n in index[::2]} if n]
    facilities = spark.createDataFrame([(f"F{i}", n, None, None, None, [], i) for i, n in enumerate(index)], "canonical_id string, canonical_name string, npi string, ccn string, facility_type string, aliases array<string>, ordinal int")
    table = facility.name_index(facilities, {})
    known = {x["normal"]: (x["facility_id"], x["place"]["ordinal"]) for x in table.collect()}
    got = {x["normal"]: (x["facility_id"], round(x["score"], 9)) for x in facility.similar_names(spark.createDataFrame([(a,) for a in asked], "normal string"), table, 0.85).collect()}
    want = {}
    for a in asked:
        near = [(-similarity.token_sort_ratio(a, b), place, i) for b, (i, place) in known.items()]
        score, _, best = min(near)
        if -score >= 0.85:
            want[a] = (best, round(-score, 9))
    assert got == want and len(want) > 50


def test_registry_upkeep(spark):
    rows = spark.createDataFrame([("F1", "One", "1", None, "acute", ["UNO"], 0), ("F2", "Two", "2", None, None, None, 1)], "canonical_id string, canonical_name string, npi string, ccn string, facility_type string, aliases array<string>, ordinal int")
    with pytest.raises(facility.UnknownFacility):
        facility.add_alias(rows, "F9", "x")
    more = facility.add_facility(facility.add_alias(rows, "F2", "Second Med Ctr"), "Third Hosp.", npi="3")
    assert [r["canonical_id"] for r in facility.lookup(more, alias="SECOND MEDICAL CENTER").collect()] == ["F2"]
    third = facility.lookup(more, alias="third hospital").first()
    assert third["ordinal"] == 2 and third["canonical_id"] == spark.range(1).select(facility.new_id(rules.normal_name(F.lit("Third Hosp.")))).first()[0]
    changed = facility.upsert_facilities(more, more.where("canonical_id = 'F1'").withColumn("canonical_name", F.lit("First")))
    assert {r["canonical_id"]: (r["canonical_name"], r["ordinal"]) for r in changed.collect()}["F1"] == ("First", 0) and changed.count() == 3
    assert facility.lookup(more, alias=" ").count() == 0 and facility.add_facility(rows.limit(0), "New").first()["ordinal"] == 0


def test_database_reads_are_split_and_pushed_down(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.timestamp_seconds(F.lit(880_000_000) + F.col("id") * 86_400).alias("o_orderdate"), F.concat((F.col("id") % 5 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority"), F.lit("unread").alias("o_comment")).write.parquet(f"{tmp_path}/orders.parquet")
    url, name = source_queries.in_database(spark, str(tmp_path))
    whole = database.table(spark, url, name, by="o_orderkey", parts=4)
    assert whole.count() == 1000 and whole.rdd.getNumPartitions() == 4
    rows = database.source_rows(whole, source_queries._SOURCE, "2000-01-01 00:00:00")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(o_orderdate" in plan and "StringStartsWith(o_orderpriority,5)" in plan.replace(" ", "") and "o_comment" not in plan
    assert rows.count() == spark.read.parquet(f"{tmp_path}/orders.parquet").where("o_orderdate > '1999-12-31' AND o_orderpriority NOT LIKE '5%'").count()
    parts = database.split_by_text(spark, url, name, '"o_orderpriority"', ["2", "3"])
    assert parts.count() == 1000 and parts.rdd.getNumPartitions() == 3
    assert database.split_by_text(spark, url, name, '"o_orderpriority"', []).count() == 1000
    assert database.table(spark, url, "(SELECT * FROM orders WHERE 1 = 0) t", by='o_orderkey').count() == 0


def test_look_ups_read_few_rows(spark, tmp_path):
    rows = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("encounter_id"), F.md5(F.col("id").cast("string")).alias("npi"), F.lit("x" * 50).alias("more"))
    lookups.write_sorted(rows, f"{tmp_path}/t", "encounter_id", {"npi": 60_000}, files=4, group_bytes=64 << 10)
    one = rows.first()
    for asked in ({"encounter_id": one["encounter_id"]}, {"npi": one["npi"]}):
        found = lookups.found(spark.read.parquet(f"{tmp_path}/t"), **asked)
        plan = found._jdf.queryExecution().executedPlan()
        assert [r["npi"] for r in found.collect()] == [one["npi"]] and found.count() == 1
        leaves = plan.collectLeaves()
        read = leaves.apply(0).metrics().apply("numOutputRows").value()
        assert 0 <= read <= 0.05 * 60_000


def test_groupers_by_table_equal_the_built_in_ones(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "I50.9", "s72.0", "O80", "F32", "", "Q9", "D05.1", "Z37.0", "Z3"]), r.choice([None, "470", "765", "885", "abc", "", "0", "41", "999", "958"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "code string, drg string")
    ranges, prefixes = groupers.default_tables(spark)
    got = groupers.typed(df.withColumn("want", rules.episode_type(F.col("code"), F.col("drg"))), ranges, prefixes)
    assert got.where("NOT want <=> episode_type").count() == 0 and got.count() == 300
    made = spark.createDataFrame([("a", 0, 10**6, 2), ("b", 500, 500, 1), ("c", 700, 600, 0)], groupers.RANGES)
    assert {x["number"]: x["type"] for x in groupers.by_range(spark.createDataFrame([(500,), (650,), (-1,), (None,)], "number int"), made).collect()} == {500: "b", 650: "a"}


def test_condition_forms(spark):
    df = spark.createDataFrame([("111", "A"), ("851", "B"), (None, None)], "code string, kind string")
    told = lambda text: [x[0] for x in df.select(rules.class_rule(text)).collect()]
    assert told("code LIKE '11%'") == [True, False, False] and told("code LIKE '%51'") == [False, True, False] and told("code like '%5%'") == [False, True, False]
    assert told("code IN ('111', 851)") == [True, True, False] and told("kind = 'B'") == [False, True, False] and told("code LIKE '111'") == [True, False, False]
    for text in ("", "code", "code LIKE 11", "code IN ()", "code IN ('1' '2')", "code = 'a' OR 1 = 1", "code == 'a'", "code IN ('1'", "; drop"):
        assert told(text) == [False] * 3
    assert Settings().slice_rows == 50_000
