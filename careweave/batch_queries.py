"""Queries of heavy patients and of runs on batches, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careweave import queries
from careweave.config import Settings
from careweave.operators import dedup, encounters, episodes, facility, quality, reconcile, score, stitch
from careweave.config import Source
from careweave.oracles import EVENTS, LINK, MERGED, ORDERS, STAYS, STITCH, with_
from careweave.plans import incremental, reconciliation
from careweave.sources import feeds
from careweave.sources.keyed import Store
from careweave.sources.shared import new_folder, written
from careweave.table_queries import ORACLE_SQL, QUERIES, query, shown_encounters  # noqa: F401: registered there

#: Half of all events and stays are those of one record number.
CROWDED = Settings(slice_rows=200)
_CROWD_EVENTS = EVENTS.replace("'P' || user_id AS p", "CASE WHEN event_id % 2 = 0 THEN 'P0' ELSE 'P' || user_id END AS p")
_CROWD_ORDERS = ORDERS.replace("'P' || o_custkey AS p", "CASE WHEN o_orderkey % 2 = 0 THEN 'P0' ELSE 'P' || o_custkey END AS p")


def _crowded(rows: DataFrame, number: str) -> DataFrame:
    even = F.substring(number, 2, 20).cast("long") % 2 == 0
    return rows.withColumn("patient_key", F.when(even, "P0").otherwise(F.col("patient_key")))


def _crowd_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.stitch(_crowded(queries._resolved(spark, sf_dir), "source_record_id"), CROWDED)


@query(with_(_CROWD_EVENTS, STITCH) + " SELECT sys AS source_system, rid AS source_record_id, side, CAST(enc AS BIGINT) AS encounter_no, eid AS encounter_id, coalesce(role, 'kept') AS role FROM dup")
def crowded_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.mark_duplicates(_crowd_stitched(spark, sf_dir), CROWDED)
    return rows.select(*queries.EVENT, "encounter_no", "encounter_id", F.coalesce("role", F.lit("kept")).alias("role"))


@query(with_(_CROWD_EVENTS, STITCH, MERGED).replace("WITH", "WITH RECURSIVE", 1) + " SELECT p AS patient_key, eid AS encounter_id, merged AS merged_id FROM mg")
def crowded_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = dedup.merge_overlaps(_crowd_stitched(spark, sf_dir), CROWDED)
    return merged.select("patient_key", "encounter_id", "merged_id").distinct()


@query(with_(_CROWD_ORDERS, LINK) + " SELECT eid AS encounter_id, link, CAST(ep AS BIGINT) AS episode_no, epid AS episode_id FROM l4")
def crowded_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episodes.link(_crowded(feeds.stays(spark, sf_dir), "encounter_id"), CROWDED)
    return rows.select("encounter_id", "link", "episode_no", "episode_id")


# runs on batches


def _before(sources: list[tuple[Source, DataFrame]], time: str) -> list[tuple[Source, DataFrame]]:
    return [(s, df.where(F.col(s.incremental_key) < time)) for s, df in sources]


def _soiled(spark: SparkSession, sf_dir: str) -> list[tuple[Source, DataFrame]]:
    """Messages of which some lack a patient or a time that can be read."""
    rows, e = feeds.adt(spark, sf_dir), F.substring("message_control_id", 2, 20).cast("long")
    at = F.when(e % 11 == 0, "2024-01").when(e % 13 == 0, "10:00").when(e % 19 == 0, " ").otherwise(F.date_format("message_ts", "yyyyMMdd'T'HHmmss"))
    return [(feeds.ADT, rows.withColumns({"message_ts": at, "patient_mrn": F.when(e % 17 > 0, F.col("patient_mrn"))})), (feeds.AUTH, feeds.auth(spark, sf_dir))]


def two_runs(spark: SparkSession, sf_dir: str) -> Store:
    """A store after a first batch, a second with all that came later, and one that is halted."""
    store, sources, known = Store(spark, new_folder(spark, "store")), reconciliation.default_feeds(spark, sf_dir), feeds.facilities(spark)
    incremental.run(store, _before(sources, "2024-01-18"), known, feeds.AS_OF, "first")
    incremental.run(store, sources, known, feeds.AS_OF, "second")
    try:
        incremental.run(store, _soiled(spark, sf_dir), known, feeds.AS_OF, "third", mode="full")
    except incremental.ErrorRateExceeded:
        return store
    raise AssertionError("a batch of bad rows was stored")


# by what they are: an encounter keeps the id that it had before its first event came late
_WHOLE = ORACLE_SQL["encounters"]


@query(f"SELECT * EXCLUDE (encounter_id) FROM ({_WHOLE})")
def incremental_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches by watermark give the encounters of one run over all."""
    return shown_encounters(two_runs(spark, sf_dir).read(incremental.ENCOUNTERS)).drop("encounter_id")


@query(f"SELECT * EXCLUDE (encounter_id) FROM ({_WHOLE})")
def moved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fifth message names a wrong patient at first, and is sent again with the right one."""
    store, sources, known = Store(spark, new_folder(spark, "store")), dict((s.name, (s, df)) for s, df in reconciliation.default_feeds(spark, sf_dir)), feeds.facilities(spark)
    feed, rows = sources[feeds.ADT.name]
    late = replace(feed, incremental_key="arrived")
    fifth = F.substring("message_control_id", 2, 20).cast("long") % 5 == 0
    wrong = F.when(fifth, F.concat("patient_mrn", F.lit("0"))).otherwise(F.col("patient_mrn"))
    first = rows.withColumns({"arrived": F.col("message_ts"), "patient_mrn": wrong})
    again = rows.where(fifth).withColumn("arrived", F.col("message_ts") + F.expr("INTERVAL 400 DAY"))
    others = [x for name, x in sources.items() if name != feed.name]
    incremental.run(store, [(late, first), *others], known, feeds.AS_OF, "first")
    incremental.run(store, [(late, again)], known, feeds.AS_OF, "second")
    return shown_encounters(store.read(incremental.ENCOUNTERS)).drop("encounter_id")


@query(with_(EVENTS) + """, m(source, last) AS (SELECT 'adt_vendor_x', max(ts) FROM adt_typed WHERE sys = 'adt_vendor_x' UNION ALL SELECT 'adt_vendor_y', max(ts) FROM adt_typed WHERE sys = 'adt_vendor_y' UNION ALL SELECT 'claims_clearinghouse', max(ts + INTERVAL 20 DAY) FROM claim_raw UNION ALL SELECT 'auth_portal', max(ts) FROM fe WHERE kind = 'signup' AND e % 3 = 0)
  SELECT source, strftime(last, '%Y-%m-%d %H:%M:%S.%f') AS watermark FROM m""")
def run_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks after the runs: those of the last that was committed."""
    stored = two_runs(spark, sf_dir).read(incremental.WATERMARKS)
    return stored.select(F.col("key").alias("source"), F.date_format("value", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("watermark"))


_SOILED = """, b AS (SELECT CAST(substr(rid, 2) AS BIGINT) AS n, rid FROM adt_typed WHERE sys = 'adt_vendor_x'),
  w AS (SELECT rid, CASE WHEN n % 17 = 0 THEN 'patient_missing' WHEN n % 11 = 0 OR n % 13 = 0 THEN 'time_unreadable' WHEN n % 19 = 0 THEN 'time_missing' END AS reason FROM b)"""


@query(with_(EVENTS) + _SOILED + """ SELECT 'adt_vendor_x' AS source, count(*) AS records_in, count(*) FILTER (WHERE reason IS NULL) AS records_out, count(reason) AS errors FROM w
  UNION ALL SELECT 'auth_portal', count(*), count(*), 0 FROM fe WHERE kind = 'signup' AND e % 3 = 0""")
def batch_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and errors of feeds with bad rows, counted as they are read."""
    return reconciliation.ingested(_soiled(spark, sf_dir)).accounts


@query(with_(EVENTS) + _SOILED + " SELECT 'adt_vendor_x' AS source, rid AS source_record_id, reason AS reject_reason FROM w WHERE reason IS NOT NULL")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciliation.ingested(_soiled(spark, sf_dir)).rejected.select("source", "source_record_id", "reject_reason")


@query(with_(ORDERS) + " SELECT eid AS encounter_id, p AS patient_key, CASE WHEN k % 2 = 0 THEN 'second' ELSE 'first' END AS run_id, CASE WHEN k % 3 > 0 THEN 'first' ELSE 'second' END AS made FROM (SELECT *, CAST(substr(eid, 2) AS BIGINT) AS k FROM s) WHERE (k % 2 = 0 OR k % 3 > 0) AND k % 35 <> 1")
def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after two runs that change and remove rows by key, and one that isn't committed."""
    table, store = incremental.Table("stays", "encounter_id", "patient_key"), Store(spark, new_folder(spark, "store"))
    rows, k = feeds.stays(spark, sf_dir).select("encounter_id", "patient_key"), F.substring("encounter_id", 2, 20).cast("long")
    for run_id, part in (("first", k % 3 > 0), ("second", k % 2 == 0), ("third", k > 0)):
        run = store.begin(run_id)
        fresh = rows.where(part).withColumns({"run_id": F.lit(run_id), "made": F.lit(run_id)})
        # the last of a key's rows counts
        again = fresh.withColumns({"run_id": F.lit("a"), "made": F.lit("a"), "nth": F.lit(0)}).unionByName(fresh.withColumn("nth", F.lit(1)))
        gone = rows.where(k % 35 == 1) if run_id == "second" else None
        run.upsert(table, again.where(k % 35 != 1) if run_id == "second" else again, order=["nth"], keep="made", remove=gone)
        if run_id != "third":
            run.commit()
    return store.read(table).select("encounter_id", "patient_key", "run_id", "made")


@query(with_(EVENTS) + """ SELECT 'canonical_events' AS name, count(*) AS n FROM adt_typed WHERE sys = 'adt_vendor_y' UNION ALL SELECT 'encounter_events', count(*) FROM adt_typed WHERE sys = 'adt_vendor_y'
  UNION ALL SELECT 'watermarks', 2 UNION ALL SELECT 'run_metrics', 2""")
def refreshed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full refresh clears what was derived; watermarks and run metrics stay."""
    store, known = Store(spark, new_folder(spark, "store")), feeds.facilities(spark)
    incremental.run(store, [(feeds.AUTH, feeds.auth(spark, sf_dir))], known, feeds.AS_OF, "first")
    incremental.run(store, [(feeds.ADT_Y, feeds.adt_y(spark, sf_dir))], known, feeds.AS_OF, "second", mode="full")
    tables = (incremental.CANONICAL, incremental.DETAIL, incremental.WATERMARKS, incremental.METRICS)
    return spark.createDataFrame([(t.name, store.read(t).count()) for t in tables], "name string, n long")


# values that the default feeds leave constant


_CODES = "['J18.9','I50.9','S72.0','E11.9','O80','F32.9','R06.0','N18.3']"


@query(with_(EVENTS, STITCH) + f""", a AS (SELECT eid, pos, ({_CODES})[CAST(substr(rid, 2) AS BIGINT) % 8 + 1] AS code FROM dup WHERE sys = 'adt_vendor_x' AND CAST(substr(rid, 2) AS BIGINT) % 3 = 0)
  SELECT eid AS encounter_id, arg_min(code, pos) AS admitting_diagnosis FROM a GROUP BY eid""")
def admitting_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters with an admitting diagnosis, which some messages bring."""
    e = F.substring("message_control_id", 2, 20).cast("long")
    messages = feeds.adt(spark, sf_dir).withColumn("reason_code", F.when(e % 3 == 0, feeds.pick(feeds.NPI_CODES, e)))
    source = Source(**{**feeds.ADT.__dict__, "fields": {**feeds.ADT.fields, "principal_diagnosis": "reason_code"}})
    sources = [(s, df) for s, df in reconciliation.default_feeds(spark, sf_dir) if s.name != source.name]
    events = reconciliation.ingested([*sources, (source, messages)]).events
    events = written(stitch.stitch(written(facility.resolve(events, feeds.facilities(spark)), "canonical-events")), "stitched-events")
    rows = reconcile.reconcile(dedup.mark_duplicates(events), stitch.encounters(events), feeds.AS_OF)
    return rows.where("admitting_diagnosis IS NOT NULL").select("encounter_id", "admitting_diagnosis")


@query(with_(EVENTS, STITCH, STAYS) + _SOILED + """, d AS (SELECT (SELECT count(DISTINCT eid) FROM dup WHERE role = 'duplicate') / (SELECT count(*) FROM stay) AS v), n AS (SELECT (SELECT count(*) FROM w) + (SELECT count(*) FROM fe WHERE kind = 'signup' AND e % 3 = 0) AS n)
  SELECT 'duplicate_rate' AS metric_name, round(v, 6) AS metric_value, CASE WHEN v >= 0.15 THEN 'fail' WHEN v >= 0.05 THEN 'warn' ELSE 'pass' END AS status FROM d
  UNION ALL SELECT 'failed_event_rate', round((SELECT count(reason) FROM w) / n, 6), CASE WHEN (SELECT count(reason) FROM w) / n >= 0.05 THEN 'fail' WHEN (SELECT count(reason) FROM w) / n >= 0.02 THEN 'warn' ELSE 'pass' END FROM n
  UNION ALL SELECT 'encounters_created', (SELECT count(*) FROM stay WHERE CAST(substr(p, 2) AS INT) % 2 = 1)::DOUBLE, 'pass' UNION ALL SELECT 'encounters_updated', (SELECT count(*) FROM stay WHERE CAST(substr(p, 2) AS INT) % 2 = 0)::DOUBLE, 'pass'""")
def run_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of duplicates, bad rows, and encounters that were there before."""
    settings = Settings(flag_duplicates=True)
    events = queries._stitched(spark, sf_dir)
    rows = reconcile.reconcile(events, stitch.encounters(events), feeds.AS_OF, settings)
    scored = written(score.score(score.stale(rows, facility.facility_types(feeds.facilities(spark)), feeds.AS_OF)), "scored")
    audit = encounters.audit_rows(scored, scored.where("int(substring(patient_key, 2)) % 2 = 0"), "encounter_id", "encounter", "run", feeds.AS_OF)
    taken = reconciliation.ingested(_soiled(spark, sf_dir))
    judged = quality.statuses(quality.metrics(scored, taken.accounts, taken.events.agg(F.count("*").alias("n")), audit))
    rates = ("duplicate_rate", "failed_event_rate", "encounters_created", "encounters_updated")
    return judged.where(F.col("metric_name").isin(*rates)).select("metric_name", F.round("metric_value", 6).alias("metric_value"), "status")


@query(with_(ORDERS) + """, x AS (SELECT *, CAST(substr(eid, 2) AS BIGINT) AS k FROM s), b AS (SELECT *, CASE WHEN k % 10 = 0 THEN a - INTERVAL 1 DAY WHEN k % 11 = 0 THEN NULL ELSE d END AS out_, CASE WHEN k % 7 = 0 THEN 1.5 ELSE conf END AS c FROM x)
  SELECT 'admit_before_discharge' AS assertion, count(*) AS violations FROM b WHERE status = 'closed' AND out_ < a UNION ALL SELECT 'closed_has_discharge', count(*) FROM b WHERE status = 'closed' AND out_ IS NULL
  UNION ALL SELECT 'encounter_score_range', count(*) FROM b WHERE c > 1 UNION ALL SELECT 'episode_score_range', count(*) FROM b WHERE k % 5 = 0 AND c > 1
  UNION ALL SELECT 'detail_has_encounter', count(*) FROM lineitem WHERE l_orderkey % 4 = 0""")
def broken_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions on tables that break each of them."""
    k = F.substring("encounter_id", 2, 20).cast("long")
    rows = feeds.stays(spark, sf_dir)
    rows = rows.withColumns({"discharge_ts": F.when(k % 10 == 0, F.col("admit_ts") - F.expr("INTERVAL 1 DAY")).when(k % 11 > 0, F.col("discharge_ts")), "confidence_score": F.when(k % 7 == 0, 1.5).otherwise(F.col("confidence_score"))})
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    named = F.concat(F.when(F.col("l_orderkey") % 4 == 0, "X").otherwise("E"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"))
    return quality.assertions(rows, lines.select(named.alias("encounter_id")), rows.where(k % 5 == 0))


@query(with_(ORDERS, LINK) + ", e AS (SELECT epid, CASE WHEN CAST(substr(any_value(p), 2) AS BIGINT) % 2 = 0 THEN 'updated' ELSE 'created' END AS action FROM l4 GROUP BY epid) SELECT epid AS entity_id, 'episode' AS entity_type, action, sha256('run|episode|' || epid || '|' || action) AS audit_id FROM e")
def episode_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = written(episodes.episodes(episodes.link(feeds.stays(spark, sf_dir)), feeds.AS_OF), "episodes")
    lines = encounters.audit_rows(table, table.where("int(substring(patient_key, 2)) % 2 = 0"), "episode_id", "episode", "run", feeds.AS_OF)
    return lines.select("entity_id", "entity_type", "action", "audit_id")
