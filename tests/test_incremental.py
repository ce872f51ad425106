"""Runs on batches against one run over all, stored tables, and what is counted on the way."""

import hashlib
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from careweave.config import Settings, Source
from careweave.functions import rules
from careweave.operators import stitch
from careweave.plans import incremental, reconciliation
from careweave.sources import feeds, scan
from careweave.sources.keyed import Conflict, Run, Store, Table
from careweave.sources.shared import shared_dir

T0 = datetime(2024, 1, 1)
LATE = Source(**{**feeds.ADT.__dict__, "incremental_key": "arrived"})
FEED = "patient_mrn string, message_ts timestamp, message_control_id string, sending_facility string, hl7_event string, patient_class string, facility_npi string, arrived timestamp"


def messages(n, patients=12, seed=3):
    r, out = random.Random(seed), []
    for k in range(n):
        at = T0 + timedelta(hours=r.randrange(40 * 24))
        came = at + timedelta(hours=r.choice([0, 1, 30, 24 * 9]))
        name = r.choice([f[1] for f in feeds.FACILITIES[:2]])
        out.append((f"P{r.randrange(patients)}", at, f"M{k}", name, r.choice(["A01", "A01", "A03", "A03", "A13", "A04"]), r.choice("IIEO"), None, came))
    return out


def shown(store):
    """Encounters by what they are, not by their ids or the run that made them."""
    rows = store.read(incremental.ENCOUNTERS)
    what = rows.drop("encounter_id", "run_id", "created_at", "updated_at", "transfer_chain", "source_event_ids", "episode_id")
    return sorted(map(str, what.withColumns({"events": F.array_join(F.array_sort("source_event_ids") if "source_event_ids" in what.columns else F.array(), ","), "chain": F.lit(0)}).collect()))


def test_batches_equal_one_run(spark, tmp_path):
    rows, known = messages(260), feeds.facilities(spark)
    # a message is sent again with another time, or with another patient
    rows += [(p, at + timedelta(hours=70), *rest, came + timedelta(days=12)) for p, at, *rest, came in rows[::17]]
    rows += [(f"P{(int(p[1:]) + 5) % 14}", *rest, came + timedelta(days=13)) for p, *rest, came in rows[3:260:19]]
    feed = spark.createDataFrame(rows, FEED).cache()
    whole, parts = Store(spark, f"file://{tmp_path}/whole"), Store(spark, f"file://{tmp_path}/parts")
    last = feed.groupBy("message_control_id").agg(F.max_by(F.struct("*"), "arrived").alias("row")).select("row.*")
    incremental.run(whole, [(LATE, last)], known, feeds.AS_OF, "whole")
    made = 0
    for k, day in enumerate((12, 13, 26, 99)):
        came = feed.where(F.col("arrived") < T0 + timedelta(days=day))
        batch = came.groupBy("message_control_id").agg(F.max_by(F.struct("*"), "arrived").alias("row")).select("row.*")
        outcome = incremental.run(parts, [(LATE, batch)], known, feeds.AS_OF, f"batch{k}")
        made += outcome.created - outcome.removed
        assert parts.read(incremental.ENCOUNTERS).count() == made
    assert shown(whole) == shown(parts)
    ids = parts.read(incremental.ENCOUNTERS).select("encounter_id")
    assert ids.distinct().count() == ids.count()
    detail = parts.read(incremental.DETAIL)
    assert detail.count() == parts.read(incremental.CANONICAL).count() == last.count()
    assert detail.join(ids, "encounter_id", "left_anti").count() == 0
    incremental.recompute_episodes(parts, feeds.AS_OF, "episodes")
    assert parts.read(incremental.ENCOUNTERS).where("episode_id IS NULL").count() == 0
    # nothing new: an empty batch
    before = shown(parts)
    outcome = incremental.run(parts, [(LATE, feed.where("arrived < '2020-01-01'"))], known, feeds.AS_OF, "empty")
    assert (outcome.created, outcome.updated, outcome.removed) == (0, 0, 0) and shown(parts) == before
    assert incremental.watermarks(parts) == {"adt_vendor_x": max(r[-1] for r in rows)}


def test_history_is_read_by_bucket_and_month(spark, tmp_path):
    store, known = Store(spark, f"file://{tmp_path}/store"), feeds.facilities(spark)
    rows = [("P1", T0 + timedelta(days=31 * k), f"M{k}", feeds.FACILITIES[0][1], kind, "I", None, T0 + timedelta(days=k)) for k in range(12) for kind in ("A01", "A03")]
    rows = [(p, at + timedelta(hours=5 * (k % 2)), f"M{k}", *rest) for k, (p, at, _, *rest) in enumerate(rows)]
    feed = spark.createDataFrame(rows, FEED)
    incremental.run(store, [(LATE, feed)], known, feeds.AS_OF, "first")
    snapshot = store.snapshot()
    assert len(snapshot.folders["canonical_events"]) == 12  # months of one bucket
    like = store.read(incremental.CANONICAL)
    quiet = spark.createDataFrame([("P1", T0 + timedelta(days=300))], "patient_key string, quiet timestamp")
    files = incremental.history(store, snapshot, quiet, like).inputFiles()
    assert {f.rpartition("month=")[2][:7] for f in files} == {"2024-10", "2024-11", "2024-12"}
    assert incremental.history(store, snapshot, quiet.where("quiet IS NULL"), like).count() == 0
    # a message that comes again in another month leaves its old one
    moved = [(p, at - timedelta(days=60), *rest[:-1], T0 + timedelta(days=50)) for p, at, *rest in rows if rest[0] == "M22"]
    incremental.run(store, [(LATE, spark.createDataFrame(moved, FEED))], known, feeds.AS_OF, "second")
    stored = store.read(incremental.CANONICAL)
    assert stored.count() == 24 and stored.select("event_id").distinct().count() == 24
    kept = {k for k, f in store.snapshot().folders["canonical_events"].items() if snapshot.folders["canonical_events"].get(k) == f}
    assert len(kept) == 10  # files of other months are the same


def test_quiet_moments(spark):
    hours = lambda h: T0 + timedelta(hours=h)
    stays = spark.createDataFrame(
        [("A", "a1", hours(0), hours(10), True), ("A", "a2", hours(100), hours(110), True), ("A", "a3", hours(300), hours(310), True), ("B", "b1", hours(0), hours(10), False), ("B", "b2", hours(500), hours(501), True), ("C", "c1", hours(0), hours(10), True)],
        "patient_key string, encounter_id string, first_event_ts timestamp, last_event_ts timestamp, has_discharge boolean",
    )
    for since, want in (({"A": 305, "B": 600, "C": 11, "D": 5}, {"A": hours(110), "B": None, "C": None, "D": None}), ({"A": 900, "C": 100}, {"A": hours(310), "C": hours(10)}), ({"A": 150}, {"A": hours(10)}), ({"A": 20}, {"A": None})):
        changed = spark.createDataFrame([(p, hours(h)) for p, h in since.items()], "patient_key string, since timestamp")
        for settings in (Settings(), Settings(slice_rows=1)):
            assert {r["patient_key"]: r["quiet"] for r in incremental.quiet_before(stays, changed, settings).collect()} == want


CLAIM = "member_id string, claim_id string, admission_date date, discharge_date date, facility_name string, received_date timestamp, bill_type_code string, payer_code string, drg_code string, primary_dx string, all_diagnosis_codes string, billing_npi string, claim_status string"


def claim(name, came, left, where):
    """A claim of P1 from some day to another."""
    return ("P1", name, (T0 + timedelta(days=came)).date(), (T0 + timedelta(days=left)).date(), where, T0 + timedelta(days=20), "131", "PAY1", "291", "E11.9", "E11.9", None, "PAID")


def test_a_record_on_both_sides_of_a_moment(spark, tmp_path):
    """The halves of a claim lie in stays of one id once a late message parts the second from its stay."""
    known, (away, _, near) = feeds.facilities(spark), (f[1] for f in feeds.FACILITIES[:3])
    say = lambda h, rid, where, code, cls, came: ("P1", T0 + timedelta(hours=h), rid, where, code, cls, None, T0 + timedelta(days=came))
    early, late = [say(8, "M1", near, "A03", "I", 10), say(90, "M2", near, "A03", "I", 10), say(123, "M3", near, "A01", "E", 10)], [say(74, "M4", away, "A03", "I", 30)]
    claims = (feeds.CLAIMS, spark.createDataFrame([claim("C1", 0, 3, near)], CLAIM))
    whole, parts = Store(spark, f"file://{tmp_path}/whole"), Store(spark, f"file://{tmp_path}/parts")
    incremental.run(whole, [(LATE, spark.createDataFrame(early + late, FEED)), claims], known, feeds.AS_OF, "whole")
    incremental.run(parts, [(LATE, spark.createDataFrame(early, FEED)), claims], known, feeds.AS_OF, "first")
    incremental.run(parts, [(LATE, spark.createDataFrame(late, FEED))], known, feeds.AS_OF, "second")
    assert shown(whole) == shown(parts)
    assert sum(len(r["source_event_ids"]) for r in parts.read(incremental.ENCOUNTERS).collect()) == parts.read(incremental.CANONICAL).count() == 6


def test_stays_that_begin_together_keep_their_order(spark, tmp_path):
    """Of two stays admitted at one instant the ids by content decide, though one keeps its id of the first run."""
    named = lambda where, rid: hashlib.sha256(f"P1|{where}|{rid}".encode()).hexdigest()
    first = next(f"M{k}" for k in range(99) if (named("FAC_001", f"M{k}") < named("FAC_002", "C1")) != (named("FAC_001", "C2") < named("FAC_002", "C1")))
    known, (here, there) = feeds.facilities(spark), (f[1] for f in feeds.FACILITIES[:2])
    feed = (LATE, spark.createDataFrame([("P1", T0 + timedelta(hours=5), first, here, "A03", "O", None, T0)], FEED))
    claims = (feeds.CLAIMS, spark.createDataFrame([claim("C1", 0, 0, there), claim("C2", 0, 1, here)], CLAIM))
    whole, parts = Store(spark, f"file://{tmp_path}/whole"), Store(spark, f"file://{tmp_path}/parts")
    incremental.run(whole, [feed, claims], known, feeds.AS_OF, "whole")
    incremental.run(parts, [feed], known, feeds.AS_OF, "first")
    incremental.run(parts, [claims], known, feeds.AS_OF, "second")
    ids = {r["encounter_id"] for r in parts.read(incremental.ENCOUNTERS).collect()}
    assert ids == {named("FAC_001", first), named("FAC_002", "C1")}
    again = lambda store: {(r["facility_id"], r["is_readmission"], r["readmission_days"]) for r in store.read(incremental.ENCOUNTERS).collect()}
    assert again(whole) == again(parts) and len(again(whole)) == 2


def test_runs_leave_only_their_store(spark, tmp_path):
    """What a run writes on the way is gone after it, and groups of patients give the rows of all at once."""
    feed, known = spark.createDataFrame(messages(120), FEED), feeds.facilities(spark)
    names = lambda: set(os.listdir(shared_dir(spark).removeprefix("file://")))
    whole, parts = Store(spark, f"file://{tmp_path}/whole"), Store(spark, f"file://{tmp_path}/parts")
    before = names()
    incremental.run(whole, [(LATE, feed)], known, feeds.AS_OF, "whole")
    small = Settings(pass_bytes=8_000)
    with pytest.raises(incremental.ErrorRateExceeded):
        incremental.run(parts, [(LATE, feed)], known, feeds.AS_OF, "halted", settings=small, limit=0.0)
    assert names() == before
    for k, day in enumerate((20, 99)):
        incremental.run(parts, [(LATE, feed.where(F.col("arrived") < T0 + timedelta(days=day)))], known, feeds.AS_OF, f"batch{k}", settings=small)
    assert names() == before and shown(whole) == shown(parts)
    versions = {f.rpartition("/")[0] for f in parts.snapshot(1).folders["encounters"].values()}
    assert len(versions) > 1  # in several passes
    assert sorted(parts.read(incremental.DETAIL).drop("encounter_id").collect()) == sorted(whole.read(incremental.DETAIL).drop("encounter_id").collect())


def test_a_run_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    table, store = Table("t", "k", buckets=4), Store(spark, f"file://{tmp_path}/store")
    rows = lambda n, v: spark.range(n).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    first = store.begin("first")
    first.upsert(table, rows(40, "a"))
    first.commit()
    folders = store.snapshot().folders["t"]
    one = store.begin("one")
    one.upsert(table, rows(1, "b"))
    assert store.read(table).where("v = 'b'").count() == 0
    other = store.begin("other")
    other.upsert(table, rows(2, "c"))
    one.commit()
    changed = [b for b, f in store.snapshot().folders["t"].items() if folders[b] != f]
    assert len(changed) == 1 and store.read(table).where("v = 'b'").count() == 1  # other buckets are the same files
    with pytest.raises(Conflict):
        other.commit()
    assert store.read(table, store.snapshot(1)).where("v = 'a'").count() == 40
    monkeypatch.setattr(Run, "commit", lambda self: (_ for _ in ()).throw(OSError("lost")))
    lost = store.begin("lost")
    lost.put(table, rows(3, "d"))
    with pytest.raises(OSError):
        lost.commit()
    assert store.read(table).count() == 40 and store.vacuum() > 0 and store.read(table).count() == 40
    assert store.read("nothing") is None and store.read("nothing", schema=table_schema()).count() == 0


def table_schema():
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([StructField("k", LongType())])


def test_upserts_keep_the_last_of_each_key(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "a", "x")], "k int, v string, made string")
    new = spark.createDataFrame([(2, "b", "y"), (2, "c", "y"), (3, "d", "y"), (3, "d", "y")], "k int, v string, made string")
    got = sorted(map(tuple, scan.upsert(old, new, "k", order="v", keep="made").collect()))
    assert got == [(1, "a", "x"), (2, "c", "x"), (3, "d", "y")]
    assert scan.upsert(old, new, "k").groupBy("k").count().where("count > 1").count() == 0
    children, store = Table("c", "k", by="parent", buckets=3), Store(spark, f"file://{tmp_path}/store")
    rows = lambda xs: spark.createDataFrame(xs, "parent string, k int")
    run = store.begin("r")
    run.replace(children, rows([("p", 1), ("p", 2), ("q", 3)]), rows([]))
    run.replace(children, rows([("p", 4)]), rows([("q", 0)]))
    run.commit()
    assert [tuple(r) for r in store.read(children).collect()] == [("p", 4)]
    run = store.begin("cleared")
    run.clear("c")
    run.commit()
    assert store.read(children) is None


def test_bad_rows_are_told_apart_and_halt_a_run(spark, tmp_path):
    rows = [("P1", "2024-01-01", "M1", "S", "A01", "I", None, T0), (None, "2024-01-01", "M2", "S", "A01", "I", None, T0), ("P1", "10:00", "M3", "S", "A01", "I", None, T0), ("P1", " ", "M4", "S", "A03", "I", None, T0)]
    feed = spark.createDataFrame(rows, FEED.replace("message_ts timestamp", "message_ts string"))
    claims = spark.createDataFrame([("P1", "C1", "2024-01-02", "2024"), ("P1", "C2", "2024-01", "2024-01-09")], "member_id string, claim_id string, admission_date string, discharge_date string")
    for c in ("facility_name", "payer_code", "drg_code", "primary_dx", "all_diagnosis_codes", "billing_npi", "bill_type_code", "claim_status", "received_date"):
        claims = claims.withColumn(c, F.lit("2024-02-01" if c == "received_date" else "x"))
    taken = reconciliation.ingested([(LATE, feed), (feeds.CLAIMS, claims)])
    assert {r["source"]: (r["records_in"], r["records_out"], r["errors"]) for r in taken.accounts.collect()} == {"adt_vendor_x": (4, 1, 3), "claims_clearinghouse": (2, 1, 1)}
    assert {(r["source_record_id"], r["reject_reason"]) for r in taken.rejected.collect()} == {("M2", "patient_missing"), ("M3", "time_unreadable"), ("M4", "time_missing"), ("C2", "time_unreadable")}
    assert '"message_ts":"10:00"' in {r["source_record_id"]: r["raw"] for r in taken.rejected.collect()}["M3"]
    assert sorted((r["source_record_id"], r["event_type"]) for r in taken.events.collect()) == [("C1", "CLAIM_ADMIT"), ("M1", "ADMIT")]
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(incremental.ErrorRateExceeded):
        incremental.run(store, [(LATE, feed)], feeds.facilities(spark), feeds.AS_OF, "bad")
    assert store.numbers() == [] and incremental.watermarks(store) == {}
    incremental.run(store, [(LATE, feed)], feeds.facilities(spark), feeds.AS_OF, "let", limit=0.9)
    assert store.read(incremental.REJECTED).count() == 3 and store.read(incremental.METRICS).first()["errors"] == 3


def test_times_of_strict_iso(spark):
    wanted = {"2024": None, "2024-01": None, "10:00": None, "9/1/2024": None, "2024-0115": None, "2024-02-30": None, "2024-01-15T25:00": None, "20240115": "2024-01-15 00:00:00.0", "20240115T1030": "2024-01-15 10:30:00.0", "2024-01-15T10:30:00,5Z": "2024-01-15 10:30:00.5", " 2024-01-15 10:30:00+0200 ": "2024-01-15 08:30:00.0"}
    df = spark.createDataFrame([(k,) for k in wanted], "v string")
    assert {r["v"]: r["t"] for r in df.select("v", F.date_format(rules.parse_ts(F.col("v")), "yyyy-MM-dd HH:mm:ss.S").alias("t")).collect()} == wanted


def test_an_earlier_stay_is_continued_once(spark):
    at = lambda h: T0 + timedelta(hours=h)
    new = spark.createDataFrame([("n1", "P", "F", at(0), at(5)), ("n2", "P", "F", at(20), at(30)), ("old2", "P", "F", at(100), datetime(9999, 1, 1)), ("n4", "P", "F", at(99), at(101))], "encounter_id string, patient_key string, facility_id string, first_event_ts timestamp, last_event_ts timestamp")
    old = spark.createDataFrame([("old1", "P", "F", at(8), at(12)), ("old2", "P", "F", at(99), at(120))], "encounter_id string, patient_key string, facility_id string, first_event_ts timestamp, last_event_ts timestamp")
    got = dict(map(tuple, stitch.stable_ids(new, old, "2024-02-01").collect()))
    assert got == {"n1": "old1", "n2": "n2", "old2": "old2", "n4": "n4"}


def test_watermarks_are_compared_as_times(spark):
    stored = spark.createDataFrame([("watermark_a", "2024-01-15 10:00:00"), ("watermark_b", "9/1/2024")], "key string, value string")
    seen = spark.createDataFrame([("watermark_a", "2024-01-15T09:00:00"), ("watermark_b", "2024-01-01")], "key string, value string")
    assert dict(map(tuple, scan.advance(stored, seen).collect())) == {"watermark_a": "2024-01-15 10:00:00", "watermark_b": "2024-01-01"}
