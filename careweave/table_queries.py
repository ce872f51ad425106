"""Queries of scans, sinks, registries, stored tables and inspections, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careweave import config
from careweave.config import Settings
from careweave.operators import dedup, encounters, episodes, facility, quality, reconcile, stitch
from careweave.oracles import EVENTS, MERGED, MERGED_RECON, MERGED_SCORE, MERGED_STAYS, MERGED_TRANSFERS, ORDERS, LINK, STITCH, STAYS, TRANSFERS, with_
from careweave.plans import reconciliation
from careweave.sources import feeds, registry, scan
from careweave.sources.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


_TIME = "'%Y-%m-%d %H:%M:%S.%f'"


# scans and sinks


@query(with_(EVENTS) + f" SELECT 'M' || e AS message_control_id, strftime(ts, {_TIME}) AS message_ts, code AS hl7_event FROM adt_raw UNION ALL SELECT NULL, strftime(ts, {_TIME}), code FROM adt_raw WHERE e % 7 = 0")
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which some were sent again, and some twice without an id."""
    rows = feeds.adt(spark, sf_dir).select("message_control_id", "message_ts", "hl7_event")
    number = F.substring("message_control_id", 2, 20).cast("long")
    again = rows.where(number % 3 == 0).withColumns({"message_ts": F.col("message_ts") + F.expr("INTERVAL 1 HOUR"), "hl7_event": F.lit("late")})
    unnamed = rows.where(number % 7 == 0).withColumn("message_control_id", F.lit(None).cast("string"))
    return scan.first_per_record(rows.union(again).union(unnamed), "message_control_id", "message_ts").select("message_control_id", _time("message_ts"), "hl7_event")


@query(with_(EVENTS) + """ SELECT '{"message_control_id":"M' || e || '","hl7_event":"' || code || '"}' AS payload, 'adt_vendor_x' AS source, 'adt' AS kind FROM adt_raw""")
def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.annotate(feeds.adt(spark, sf_dir).select("message_control_id", "hl7_event"), feeds.ADT, payload=True)
    return rows.select(F.col("_raw_payload").alias("payload"), F.col("_source_name").alias("source"), F.col("_source_type").alias("kind"))


_WATERMARKS = """ SELECT 'watermark_adt_vendor_x' AS key, CAST(max(ts) AS VARCHAR) AS value FROM adt_all WHERE sys = 'adt_vendor_x'{0}
  UNION ALL SELECT 'watermark_adt_vendor_y', CAST(max(ts) AS VARCHAR) FROM adt_all WHERE sys = 'adt_vendor_y'{0}
  UNION ALL SELECT 'watermark_claims_clearinghouse', CAST(max(ts + INTERVAL 20 DAY) AS VARCHAR) FROM fe WHERE kind = 'purchase'{1}
  UNION ALL SELECT 'watermark_auth_portal', CAST(max(ts) AS VARCHAR) FROM fe WHERE kind = 'signup' AND e % 3 = 0{1}"""


@query(with_(EVENTS) + _WATERMARKS.format("", ""))
def source_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.watermarks({s.name: (df, s.incremental_key) for s, df in reconciliation.default_feeds(spark, sf_dir)})


@query(with_(EVENTS) + _WATERMARKS.format(" AND ts < TIMESTAMP '2024-01-15'", ""))
def stored_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after a run of all sources up to some day and a later run of two."""
    sources = {s.name: (df, s.incremental_key) for s, df in reconciliation.default_feeds(spark, sf_dir)}
    early = {name: (df.where(F.col(key) < "2024-01-15"), key) for name, (df, key) in sources.items()}
    late = {name: sources[name] for name in ("claims_clearinghouse", "auth_portal")}
    where = new_folder(spark, "watermarks")
    scan.full_refresh(scan.watermarks(early), where)
    return scan.advance(spark.read.parquet(where), scan.watermarks(late))


@query("SELECT l_orderkey AS parent, l_linenumber AS child, l_quantity AS amount FROM lineitem WHERE l_orderkey % 2 = 1 OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2) UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber <= 2")
def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), F.col("l_quantity").alias("amount"))
    return scan.replace_children(old, old.where("parent % 2 = 0 AND child <= 2").withColumn("amount", F.col("amount") + 1), "parent")


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN event_type ELSE 'second' END AS event_type, CASE WHEN event_id % 5 < 3 THEN 0 ELSE 2 END AS version FROM events")
def upserted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events, some of which come again twice in a batch: the last one counts."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.lit(0).alias("version"))
    batch = rows.where("event_id % 5 >= 3")
    batch = batch.withColumns({"event_type": F.lit("first"), "version": F.lit(1)}).union(batch.withColumns({"event_type": F.lit("second"), "version": F.lit(2)}))
    return scan.upsert(rows.where("event_id % 5 < 4"), batch, "event_id", order="version")


@query("""WITH b AS (SELECT * FROM events WHERE event_id % 50 = 0) SELECT event_id, user_id AS patient_key, 'batch' AS side FROM b
  UNION ALL SELECT event_id, user_id, 'stored' FROM events WHERE event_id % 50 <> 0 AND user_id IN (SELECT user_id FROM b) AND ts >= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY""")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("patient_key"), F.col("ts").cast("timestamp").alias("event_ts"))
    side = lambda name: F.lit(name).alias("side")
    found = scan.recent_history(rows.select("*", side("stored")), rows.where("event_id % 50 = 0").select("*", side("batch")), "2024-02-01", 14)
    return found.select("event_id", "patient_key", "side")


@query("SELECT event_id, event_type FROM events")
def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is cleared, refilled and appended to."""
    rows, where = table(spark, sf_dir, "events").select("event_id", "event_type"), new_folder(spark, "appended")
    scan.append(rows.limit(10), where)
    scan.full_refresh(rows.where("event_id % 3 = 0"), where)
    scan.append(rows.where("event_id % 3 > 0"), where)
    return scan.read(spark, where)


@query("SELECT o_orderkey AS k, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS stamped FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') UNION ALL SELECT o_orderkey, 'old', strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'")
def refreshed_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    mart = rows.where("updated_at < '1998-01-01'").withColumn("status", F.lit("old"))
    return scan.refresh_mart(rows, mart, "k").select("k", "status", F.date_format("updated_at", "yyyy-MM-dd").alias("stamped"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE c_mktsegment END AS name FROM customer")
def inserted_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("name"))
    return scan.insert_new(rows, rows.where("k % 2 = 0").withColumn("name", F.lit("kept")), "k")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def published_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = new_folder(spark, "mart")
    scan.publish(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"], where)
    return spark.read.parquet(where)


# registries


def _provider_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Provider files of the public layouts, from suppliers and customers."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    key, n = F.col("s_suppkey"), F.col("c_custkey")
    orgs = s.select(
        key.cast("string").alias("NPI"), F.when(key % 3 == 0, "1").otherwise("2").alias("Entity Type Code"), F.when(key % 7 > 0, F.col("s_name")).alias(registry.NPPES_NAME),
        F.when(key % 2 == 0, F.upper("s_name")).otherwise("").alias(registry.NPPES_OTHER), F.when(key % 4 > 0, F.concat(F.lit("T"), "s_nationkey")).alias("Healthcare Provider Taxonomy Code_1"), F.lit("207Q").alias("Healthcare Provider Taxonomy Code_3"),
    )
    others = s.where(key % 5 == 0).select(key.cast("string").alias("NPI"), F.explode(F.array(F.lit("Another Name"), F.concat(F.lit("Clinic "), (key % 4).cast("string")), F.lit(""))).alias(registry.NPPES_OTHER))
    hospitals = c.where(n % 2 == 0).select(n.cast("string").alias("PRVDR_NUM"), F.col("c_name").alias("FAC_NAME"), F.when(n % 3 == 0, F.lit("Alias")).alias("MLT_FAC_ORG_NAME"), F.when(n % 5 > 0, "01").otherwise("02").alias("PRVDR_CTGRY_CD"), feeds.pick(["01", "27", "04", "05", "99"], n / 2).alias("PRVDR_CTGRY_SBTYP_CD"), F.col("c_mktsegment").alias("CITY_NAME"), F.lit("9").alias("GNRL_FAC_TYPE_CD"))
    iqies = c.where(n % 2 == 1).select(n.cast("string").alias("prvdr_num"), F.when(n % 9 > 0, F.col("c_name")).alias("fac_name"), F.col("c_name").alias("mlt_fac_org_name"), F.lit("IL").alias("state_cd"), F.lit("21").alias("prvdr_type_id"), (n % 4).cast("string").alias("gnrl_fac_type_cd"))
    return orgs, others, hospitals, iqies


@query("""WITH o AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 > 0 THEN s_name WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE '' END AS name, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE '' END AS other, s_nationkey AS nk FROM supplier WHERE s_suppkey % 3 > 0),
  a AS (SELECT *, list_sort(list_distinct(list_concat(CASE WHEN other <> '' AND other <> name THEN [other] ELSE [] END, CASE WHEN k % 5 = 0 THEN ['Another Name', 'Clinic ' || (k % 4)] ELSE [] END))) AS names FROM o WHERE name <> ''),
  h AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 > 0 THEN '01' ELSE '02' END AS cat, (['01','27','04','05','99'])[CAST(floor(c_custkey / 2) AS INT) % 5 + 1] AS sub, * FROM customer WHERE c_custkey % 2 = 0)
  SELECT 'NPI:' || k AS canonical_id, name AS canonical_name, k::VARCHAR AS npi, '' AS ccn, '' AS facility_type, '' AS facility_type_raw, CASE WHEN len(names) > 0 THEN '["' || array_to_string(names, '","') || '"]' ELSE '' END AS aliases, 'nppes' AS source, '' AS city,
    CASE WHEN k % 4 > 0 THEN '["T' || nk || '","207Q"]' ELSE '["207Q"]' END AS taxonomy_codes, '' AS pos_category_code, '' AS pos_provider_type_id FROM a
  UNION ALL SELECT 'CCN:' || k, c_name, '', k::VARCHAR, CASE WHEN cat = '01' THEN CASE sub WHEN '01' THEN 'acute' WHEN '27' THEN 'ltach' WHEN '04' THEN 'psych' WHEN '05' THEN 'rehab' ELSE '' END ELSE '' END, cat || ':' || sub, CASE WHEN k % 3 = 0 THEN '["Alias"]' ELSE '' END, 'pos_hospital', c_mktsegment, '', cat, '' FROM h
  UNION ALL SELECT 'CCN:' || c_custkey, c_name, '', c_custkey::VARCHAR, '', (c_custkey % 4)::VARCHAR, '', 'pos_iqies', '', '', '', '21' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 9 > 0""")
def combined_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.build_registry(*_provider_files(spark, sf_dir))
    return rows.select("canonical_id", "canonical_name", "npi", "ccn", "facility_type", "facility_type_raw", "aliases", "source", "city", "taxonomy_codes", "pos_category_code", "pos_provider_type_id")


@query("SELECT s_suppkey::VARCHAR AS npi, CASE WHEN s_suppkey % 5 = 0 THEN 'Another Name|Clinic ' || (s_suppkey % 4) END AS names FROM supplier WHERE s_suppkey % 5 = 0")
def other_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.othernames(_provider_files(spark, sf_dir)[1]).select("npi", F.concat_ws("|", F.array_sort("othernames")).alias("names"))


_KNOWN = "CASE WHEN l_suppkey % 2 = 0 THEN 'NPI:' ELSE 'CCN:' END || l_suppkey"


@query(f"""SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_suppkey % 11 = 0 THEN 'GIVEN' WHEN l_suppkey % 10 = 0 THEN NULL ELSE {_KNOWN} END AS facility_id,
  CASE WHEN l_suppkey % 11 = 0 THEN 'customer_provided' WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'npi_registry' ELSE 'ccn_registry' END AS facility_match_type,
  CASE WHEN l_suppkey % 11 > 0 AND l_suppkey % 10 > 0 THEN s_name END AS known_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def registry_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown names whose number, in a column or in the raw payload, the registry knows."""
    key = F.col("l_suppkey")
    given = key % 11 == 0
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
    rows = lines.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.when(key % 10 == 0, " ").otherwise(F.concat(F.lit("Qq Zzyx "), key.cast("string"))).alias("facility_raw"),
        F.when((key % 2 == 0) & (key % 4 > 0), key.cast("string")).alias("npi"), F.when(key % 2 == 1, key.cast("string")).alias("ccn"),
        F.when(given, "GIVEN").alias("facility_id"), F.when(given, "customer_provided").alias("facility_match_type"), F.when(key % 4 == 0, F.to_json(F.struct(key.cast("string").alias("npi")))).alias("raw_payload"),
    )
    found = facility.resolve(rows, feeds.facilities(spark), registry.load_registry(feeds.supplier_registry(spark, sf_dir)))
    known = F.when(F.col("facility_match_type").endswith("_registry"), F.col("facility_name")).alias("known_name")
    return found.select("k", "line", "facility_id", "facility_match_type", known)


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.load_registry(feeds.supplier_registry(spark, sf_dir))


@query("""WITH r AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'NPI:' ELSE 'CCN:' END || s_suppkey AS id, * FROM supplier)
  SELECT 'npi' AS how, id AS canonical_id, 1 AS n_aliases FROM r WHERE s_suppkey = 4 UNION ALL SELECT 'ccn', id, 1 FROM r WHERE s_suppkey = 7 UNION ALL SELECT 'id', id, 1 FROM r WHERE id = 'NPI:6'
  UNION ALL SELECT 'name', id, 1 FROM r WHERE s_name = (SELECT s_name FROM supplier WHERE s_suppkey = 3) UNION ALL SELECT 'alias', id, 2 FROM r WHERE s_suppkey = 8""")
def facility_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facility.add_alias(_registered(spark, sf_dir), "NPI:8", "THE EIGHTH")
    asked = {"npi": {"npi": "4"}, "ccn": {"ccn": "7"}, "id": {"facility_id": "NPI:6"}, "name": {"alias": "Supplier#000000003"}, "alias": {"alias": "THE EIGHTH"}}
    return scan.union_all([facility.lookup(rows, **what).select(F.lit(how).alias("how"), "canonical_id", F.size("aliases").alias("n_aliases")) for how, what in asked.items()])


@query(with_(ORDERS) + """, r AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'NPI:' ELSE 'CCN:' END || s_suppkey AS id, upper(s_name) AS alias, s_name AS name, s_suppkey AS k FROM supplier)
  SELECT id AS facility_id, CASE WHEN id = 'NPI:2' THEN alias || '|' || (SELECT alias || '|' || name FROM r WHERE k = 1) ELSE alias END AS aliases, (SELECT count(*) FROM s WHERE id = CASE fid WHEN 'FAC_1' THEN 'NPI:2' WHEN 'FAC_2' THEN 'NPI:2' END) AS n_stays FROM r WHERE k <> 1""")
def merged_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A facility becomes an alias of another one, which takes over its stays."""
    stays = feeds.stays(spark, sf_dir).select("encounter_id", F.when(F.col("facility_id") == "FAC_1", "CCN:1").when(F.col("facility_id") == "FAC_2", "NPI:2").alias("facility_id"))
    merged, moved = facility.merge_facility(_registered(spark, sf_dir), stays, "CCN:1", "NPI:2")
    n = moved.where("facility_id IS NOT NULL").groupBy("facility_id").agg(F.count("*").alias("n"))
    return merged.select(F.col("canonical_id").alias("facility_id"), F.concat_ws("|", "aliases").alias("aliases")).join(n, "facility_id", "left").select("facility_id", "aliases", F.coalesce("n", F.lit(0)).alias("n_stays"))


@query(with_(EVENTS) + " SELECT fid AS facility_id, count(*) AS n_events FROM res WHERE mt = 'new' GROUP BY fid")
def unresolved_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = reconciliation.canonical_events(reconciliation.default_feeds(spark, sf_dir))
    return facility.unresolved(facility.new_facilities(facility.resolve(events, feeds.facilities(spark)))).select("facility_id", "n_events")


# encounters over several runs


@query(with_(ORDERS) + f""", n AS (SELECT eid, p, fid, a AS x, coalesce(d, a) AS y FROM s), o AS (SELECT 'Q' || eid AS q, p, fid, a + INTERVAL 1 DAY AS x, coalesce(d, a) + INTERVAL 2 DAY AS y FROM s WHERE CAST(substr(eid, 2) AS BIGINT) % 3 = 0),
  hit AS (SELECT n.eid, arg_min(q, {{'a': abs(epoch_us(n.x) - epoch_us(o.x)), 'b': q}}) AS q FROM n JOIN o ON n.p = o.p AND n.fid = o.fid AND n.x <= o.y + INTERVAL {Settings().window_hours} HOUR AND o.x <= n.y + INTERVAL {Settings().window_hours} HOUR WHERE o.y >= TIMESTAMP '2000-01-01' - INTERVAL 1500 DAY GROUP BY n.eid),
  won AS (SELECT arg_min(hit.eid, {{'a': abs(epoch_us(n.x) - epoch_us(o.x)), 'b': hit.eid}}) AS eid, hit.q FROM hit JOIN n ON n.eid = hit.eid JOIN o ON o.q = hit.q GROUP BY hit.q)
  SELECT eid AS encounter_id, coalesce(q, eid) AS stable_id FROM n LEFT JOIN won USING (eid)""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.stays(spark, sf_dir).select("encounter_id", "patient_key", "facility_id", F.col("admit_ts").alias("first_event_ts"), F.coalesce("discharge_ts", "admit_ts").alias("last_event_ts"))
    prior = rows.where("int(substring(encounter_id, 2)) % 3 = 0").withColumns({"encounter_id": F.concat(F.lit("Q"), "encounter_id"), "first_event_ts": F.col("first_event_ts") + F.expr("INTERVAL 1 DAY"), "last_event_ts": F.col("last_event_ts") + F.expr("INTERVAL 2 DAYS")})
    return stitch.stable_ids(rows, prior, "2000-01-01", Settings(history_days=1500))


def _stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from careweave import queries

    return queries._stitched(spark, sf_dir)


@query(with_(EVENTS, STITCH, STAYS) + TRANSFERS + ", c2 AS (SELECT p, c FROM c1 GROUP BY p, c HAVING count(*) > 1) SELECT (SELECT count(*) FROM c2) AS transfers, (SELECT count(*) FROM st WHERE t IN ('CANCEL_ADMIT', 'CANCEL_DISCHARGE')) AS cancellations")
def stitch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stitched(spark, sf_dir)
    return stitch.stitch_counts(events, stitch.transfers(stitch.encounters(events)))


@query(with_(EVENTS, STITCH, MERGED).replace("WITH", "WITH RECURSIVE", 1) + " SELECT p AS patient_key, eid AS encounter_id, merged AS merged_id FROM mg")
def merged_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.merge_overlaps(_stitched(spark, sf_dir)).select("patient_key", "encounter_id", "merged_id").distinct()


@query(with_(EVENTS, STITCH, MERGED, MERGED_STAYS, MERGED_RECON).replace("WITH", "WITH RECURSIVE", 1) + """, r0 AS (SELECT dupm.*, CASE WHEN role IS NULL AND is_in AND evt = coalesce(adm.a, fst.a) THEN 'admit_anchor' WHEN role IS NULL AND is_out AND evt = dis.a THEN 'discharge_anchor' END AS k FROM dupm JOIN rec0 USING (eid))
  SELECT eid AS encounter_id, sha256(sys || '|' || rid || '|' || t0) AS event_id, t AS event_type, strftime(evt, '%Y-%m-%d %H:%M:%S.%f') AS event_ts, sys AS source_system, coalesce(role, CASE WHEN k IS NOT NULL AND row_number() OVER (PARTITION BY eid, k ORDER BY pos) = 1 THEN k END, 'supporting') AS role_in_encounter FROM r0""")
def encounter_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciliation.run_feeds(spark, sf_dir).detail.withColumn("event_ts", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(with_(ORDERS) + """ SELECT eid AS entity_id, CASE WHEN k % 3 = 0 THEN 'updated' ELSE 'created' END AS action, sha256('run|encounter|' || eid || '|' || CASE WHEN k % 3 = 0 THEN 'updated' ELSE 'created' END) AS audit_id FROM (SELECT *, CAST(substr(eid, 2) AS BIGINT) AS k FROM s) WHERE k % 2 = 0""")
def encounter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = feeds.stays(spark, sf_dir), F.substring("encounter_id", 2, 20).cast("long")
    return encounters.audit_rows(rows.where(k % 2 == 0), rows.where(k % 3 == 0), "encounter_id", "encounter", "run", feeds.AS_OF).select("entity_id", "action", "audit_id")


@query(with_(EVENTS) + """, f AS (SELECT DISTINCT fid, CASE how WHEN 'new' THEN 'Lakeside Walk-In Practice' ELSE 'ALDR CREEK REGIONL HOSP' END AS raw, mt FROM res WHERE mt IN ('new', 'fuzzy'))
  SELECT sha256('run|' || fid || '|' || raw || '|' || mt) AS audit_id, fid AS entity_id, mt AS action FROM f""")
def facility_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = reconciliation.canonical_events(reconciliation.default_feeds(spark, sf_dir))
    return encounters.facility_audit_rows(facility.resolve(events, feeds.facilities(spark)), "run", feeds.AS_OF).select("audit_id", "entity_id", "action")


@query(with_(ORDERS) + """, w AS (SELECT eid, status, CAST(substr(eid, 2) AS BIGINT) AS k FROM s) SELECT eid AS encounter_id, CASE WHEN k % 2 = 0 THEN 'second' ELSE 'first' END AS run_id, CASE WHEN k % 3 > 0 THEN '1' ELSE '2' END AS made FROM w WHERE k % 2 = 0 OR k % 3 > 0""")
def materialized_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored encounters after a second run that has some of them and some new ones."""
    rows, k = feeds.stays(spark, sf_dir).select("encounter_id", "patient_key"), F.substring("encounter_id", 2, 20).cast("long")
    of = lambda df, run, at: df.withColumns({"run_id": F.lit(run), "created_at": F.lit(f"2024-01-0{at} 00:00:00").cast("timestamp")})
    fresh = of(rows.where(k % 2 == 0), "second", 2)
    tables = reconciliation.Tables(*[fresh] * 7, fresh, fresh.select("encounter_id"), fresh)
    stored, _, _ = reconciliation.materialize(tables, of(rows.where(k % 3 > 0), "first", 1), fresh.select("encounter_id").limit(0), "second", feeds.AS_OF)
    return stored.select("encounter_id", "run_id", F.dayofmonth("created_at").cast("string").alias("made"))


@query(with_(ORDERS, LINK) + " SELECT eid AS encounter_id, epid AS episode_id FROM l4")
def recomputed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored encounters with the ids of their episodes filled in anew."""
    stored = feeds.stays(spark, sf_dir).withColumn("episode_id", F.lit("stale"))
    return episodes.recompute(stored, feeds.AS_OF)[1].select("encounter_id", "episode_id")


# quality and inspection

_METRICS = "SELECT unnest(['duplicate_rate','missing_discharge_rate','reconciliation_mismatch_rate','facility_unresolved_rate','auth_without_admit_rate','claims_only_rate','low_confidence_rate','avg_confidence_score','failed_event_rate','events_ingested','encounters_created','encounters_updated']) AS metric_name, unnest([0.0, avg(f3::INT), avg(f2::INT), avg(f7::INT), avg(f1::INT), avg(f5::INT), avg((round(conf::DOUBLE, 9) < 0.6)::INT), avg(conf::DOUBLE), 0.0, (SELECT count(*) FROM res)::DOUBLE, count(*)::DOUBLE, 0.0]) AS v FROM banded JOIN flagged USING (eid)"
_LIMITS = ", ".join(f"('{k}', {w}::DOUBLE, {f}::DOUBLE)" for k, (w, f) in config.THRESHOLDS.items())
_JUDGED = with_(EVENTS, STITCH, MERGED, MERGED_STAYS, MERGED_RECON, MERGED_SCORE).replace("WITH", "WITH RECURSIVE", 1) + f", m AS ({_METRICS}), lim(metric_name, warn, fail) AS (VALUES {_LIMITS}), judged AS (SELECT m.*, warn, fail, CASE WHEN v >= fail THEN 'fail' WHEN v >= warn THEN 'warn' ELSE 'pass' END AS status FROM m LEFT JOIN lim USING (metric_name))"


@query(_JUDGED + " SELECT metric_name, round(v, 6) AS metric_value, status, CASE WHEN status <> 'pass' THEN printf('%s=%.4f is %s', metric_name, v, status) END AS detail FROM judged")
def run_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconciliation.quality_rows(reconciliation.run_feeds(spark, sf_dir), "run", feeds.AS_OF)
    return rows.select("metric_name", F.round("metric_value", 6).alias("metric_value"), "status", "detail")


@query(_JUDGED + " SELECT metric_name, status, CASE status WHEN 'fail' THEN fail ELSE warn END AS threshold, status = 'fail' AS blocks FROM judged WHERE status <> 'pass'")
def quality_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics beyond a threshold, and whether they block the run."""
    judged = reconciliation.judged(reconciliation.run_feeds(spark, sf_dir))
    stops = quality.blocked(judged).withColumn("blocks", F.lit(True))
    return quality.alerts(judged).drop("metric_value").join(stops, "metric_name", "left").withColumn("blocks", F.coalesce("blocks", F.lit(False)))


@query("SELECT event_type AS source, count(*) AS records_in, count(*) - count(*) FILTER (WHERE event_id % 9 = 0) AS records_out, count(*) FILTER (WHERE event_id % 9 = 0) AS errors, (SELECT avg((event_id % 9 = 0)::INT) >= 0.05 FROM events) AS halt FROM events GROUP BY event_type")
def error_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _stages(spark, sf_dir)
    return lines.crossJoin(F.broadcast(quality.error_halt(lines).select("halt")))  # one row


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if(F.col("event_id") % 9 == 0)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("records_in"), (F.count("*") - bad).alias("records_out"), bad.alias("errors"))


@query("SELECT 'ingest' AS stage, 'run' AS run_id, count(*) AS records_in, count(*) - count(*) FILTER (WHERE event_id % 9 = 0) AS records_out, count(*) FILTER (WHERE event_id % 9 = 0) AS errors, 'completed' AS status FROM events")
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.stage_rows(_stages(spark, sf_dir), "ingest", "run", "2024-01-31 00:00:00", "2024-01-31 01:00:00").drop("started_at", "ended_at")


@query("""SELECT 'not_null' AS test, count(*) AS violations FROM orders WHERE o_orderkey % 17 = 0 UNION ALL SELECT 'unique', count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)
  UNION ALL SELECT 'accepted_values', count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'relationships', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)""")
def table_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    found = {
        "not_null": quality.not_null(orders.withColumn("at", F.when(F.col("o_orderkey") % 17 > 0, F.col("o_orderdate"))), "at"), "unique": quality.unique(orders, "o_custkey"),
        "accepted_values": quality.accepted_values(orders, "o_orderstatus", ["O", "F"]), "relationships": quality.relationships(lines, "l_suppkey", table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0"), "s_suppkey"),
    }
    return scan.union_all([df.agg(F.lit(name).alias("test"), F.count("*").alias("violations")) for name, df in found.items()])


@query(with_(EVENTS, STITCH, MERGED, MERGED_STAYS, MERGED_RECON, MERGED_SCORE).replace("WITH", "WITH RECURSIVE", 1) + """ SELECT 'admit_before_discharge' AS assertion, count(*) AS violations FROM banded JOIN flagged USING (eid) WHERE status = 'closed' AND dis.a < coalesce(adm.a, fst.a)
  UNION ALL SELECT 'closed_has_discharge', count(*) FROM banded JOIN flagged USING (eid) WHERE status = 'closed' AND dis.a IS NULL UNION ALL SELECT 'encounter_score_range', count(*) FROM banded WHERE NOT conf BETWEEN 0 AND 1 UNION ALL SELECT 'episode_score_range', 0 UNION ALL SELECT 'detail_has_encounter', 0""")
def run_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = reconciliation.run_feeds(spark, sf_dir)
    return quality.assertions(tables.encounters, tables.detail, reconciliation.with_episodes(tables, feeds.AS_OF)[0])


def _run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of run metrics for each day and kind of event."""
    bad = F.count_if(F.col("event_id") % 9 == 0)
    run = F.concat(F.lit("R"), F.date_format("ts", "yyyyMMdd")).alias("run_id")
    return table(spark, sf_dir, "events").groupBy(run, F.col("event_type").alias("stage")).agg(F.count("*").alias("records_in"), (F.count("*") - bad).alias("records_out"), bad.alias("errors"), F.date_trunc("DAY", F.min("ts")).alias("started_at"))


@query("SELECT 'R' || strftime(ts, '%Y%m%d') AS run_id, count(*) AS records_in, count(*) - count(*) FILTER (WHERE event_id % 9 = 0) AS records_out, count(*) FILTER (WHERE event_id % 9 = 0) AS errors FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latest_run(_run_metrics(spark, sf_dir))


@query("SELECT event_type AS stage, count(*) AS records_in FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1")
def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run_stages(_run_metrics(spark, sf_dir), "R20240110").select("stage", "records_in")


@query(with_(ORDERS) + ", k AS (SELECT * FROM s WHERE eid = 'E000000000007') SELECT k.eid AS encounter_id, p AS patient_key, CAST(l_linenumber AS VARCHAR) AS event_id, strftime(l_shipdate, '%Y-%m-%d') AS event_day FROM k JOIN lineitem ON l_orderkey = 7")
def encounter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("E"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("encounter_id"), F.col("l_linenumber").cast("string").alias("event_id"), F.col("l_shipdate").alias("event_ts"))
    found = quality.encounter_events(feeds.stays(spark, sf_dir), detail, "E000000000007")
    return found.select("encounter_id", "patient_key", "event_id", F.date_format("event_ts", "yyyy-MM-dd").alias("event_day"))


@query("SELECT 'A' || o_orderkey AS audit_id, o_orderstatus AS action FROM orders WHERE o_orderdate >= (SELECT date_trunc('month', max(o_orderdate)) FROM orders)")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines of the last run, where each month is one."""
    at = F.date_trunc("MONTH", "o_orderdate")
    audit = table(spark, sf_dir, "orders").select(F.concat(F.lit("A"), "o_orderkey").alias("audit_id"), F.col("o_orderstatus").alias("action"), at.alias("created_at"), F.date_format(at, "yyyyMM").alias("run_id"))
    return quality.run_log(audit).select("audit_id", "action")


# the published encounters

_NAMES = "CASE fid " + " ".join(f"WHEN '{f[0]}' THEN '{f[1].replace(chr(39), chr(39) * 2)}'" for f in feeds.FACILITIES) + " ELSE 'Lakeside Walk-In Practice' END"
_TYPES = "CASE fid " + " ".join(f"WHEN '{f[0]}' THEN '{f[4]}'" for f in feeds.FACILITIES) + " END"


@query(with_(EVENTS, STITCH, MERGED, MERGED_STAYS, MERGED_RECON, MERGED_SCORE).replace("WITH", "WITH RECURSIVE", 1) + MERGED_TRANSFERS + f""", b AS (SELECT b.*, coalesce(adm.a, fst.a) AS a, dis.a AS d, {_TYPES} AS ft FROM flagged b),
  num AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY a, eid) AS nth FROM b),
  hit AS (SELECT x.eid, arg_max(y.d, y.nth) AS d FROM num x JOIN num y ON x.p = y.p AND y.nth < x.nth AND y.ft = 'acute' AND y.d > x.a - INTERVAL 31 DAY WHERE x.ft = 'acute' GROUP BY x.eid)
  SELECT num.eid AS encounter_id, num.p AS patient_key, fid AS facility_id, {_NAMES} AS facility_name, strftime(a, {_TIME}) AS admit_ts, strftime(num.d, {_TIME}) AS discharge_ts, round((epoch_us(num.d) - epoch_us(a)) / 3600000000, 6) AS los_hours,
    CASE coalesce(pc, 'outpatient') WHEN 'ed' THEN 'ed_only' ELSE coalesce(pc, 'outpatient') END AS encounter_type, num.status, etype = 'inpatient' AS is_acute, drg, payer AS payer_id, pdx AS principal_diagnosis, CAST(NULL AS VARCHAR) AS admitting_diagnosis, dx,
    has_adt, has_claims, has_auth, systems AS source_systems, num.n AS n_events, coalesce(adm.s, fst.s) AS admit_source, dis.s AS discharge_source, obs AS obs_to_ip, coalesce(chain.n, 0) AS chain_length, ft AS facility_type, round(conf::DOUBLE, 6) AS confidence_score, shown AS confidence_flags,
    hit.eid IS NOT NULL AS is_readmission, CAST(floor((epoch_us(a) - epoch_us(hit.d)) / 86400000000) AS INT) AS readmission_days
  FROM num JOIN banded ON banded.eid = num.eid LEFT JOIN hit ON hit.eid = num.eid LEFT JOIN chain ON chain.eid = num.eid""")
def published_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encounter table with its lists as text."""
    return shown_encounters(reconciliation.run_feeds(spark, sf_dir).encounters)


def shown_encounters(rows: DataFrame) -> DataFrame:
    joined = lambda c: F.concat_ws(",", c).alias(c)
    return rows.select(
        "encounter_id", "patient_key", "facility_id", "facility_name", _time("admit_ts"), _time("discharge_ts"), F.round("los_hours", 6).alias("los_hours"), "encounter_type", "status", "is_acute", "drg", "payer_id", "principal_diagnosis", "admitting_diagnosis", F.concat_ws(",", "diagnosis_codes.code").alias("dx"),
        "has_adt", "has_claims", "has_auth", joined("source_systems"), F.size("source_event_ids").cast("long").alias("n_events"), "admit_source", "discharge_source", "obs_to_ip", F.coalesce(F.size("transfer_chain"), F.lit(0)).cast("long").alias("chain_length"), "facility_type", F.round("confidence_score", 6).alias("confidence_score"), joined("confidence_flags"),
        "is_readmission", "readmission_days",
    )


# under the name of the table itself
QUERIES["encounters"], ORACLE_SQL["encounters"] = QUERIES.pop("published_encounters"), ORACLE_SQL.pop("published_encounters")


@query(with_(EVENTS, STITCH) + " SELECT eid AS encounter_id FROM dup WHERE role = 'duplicate' GROUP BY eid")
def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters that get the optional flag of duplicates."""
    events = _stitched(spark, sf_dir)
    rows = reconcile.reconcile(events, stitch.encounters(events), feeds.AS_OF, Settings(flag_duplicates=True))
    return rows.where(F.array_contains("flags", "DUPLICATE_DETECTED")).select("encounter_id")


@query(with_(EVENTS, STITCH) + """, x AS (SELECT eid, p, arg_min(fid, pos) AS f, min(evt) AS begun FROM st GROUP BY eid, p), y AS (SELECT eid, CASE WHEN CAST(substr(p, 2) AS INT) % 2 = 0 AND eid = min(eid) OVER (PARTITION BY p, f, begun) THEN 'Q' || eid ELSE eid END AS q FROM x)
  SELECT sys AS source_system, rid AS source_record_id, side, q AS encounter_id FROM st JOIN y USING (eid)""")
def continued_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run of the same events: stays of even patients keep their earlier ids, of
    stays that begin together at one facility one."""
    events = _stitched(spark, sf_dir)
    prior = stitch.encounters(events).where("int(substring(patient_key, 2)) % 2 = 0").withColumn("encounter_id", F.concat(F.lit("Q"), "encounter_id"))
    return reconciliation.with_stable_ids(events, prior, feeds.AS_OF).select("source_system", "source_record_id", "side", "encounter_id")
