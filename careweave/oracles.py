"""SQL that gives the same rows as the queries, written on its own for DuckDB."""

from __future__ import annotations

from careweave import config

_EVENTS = r"""
ev AS (
  SELECT event_id AS e, ts, event_type AS kind, 'P' || user_id AS p, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k,
         CAST((user_id + (day(ts) - 1) // 7) % 5 AS INT) AS fac
  FROM events
),
fe AS (
  SELECT *, CASE WHEN k % 10 = 0 AND fac <> 3 THEN fac END AS npi_fac,
         CASE WHEN e % 50 = 0 THEN 'new' WHEN e % 50 = 25 THEN 'fuzzy' ELSE 'exact' END AS how
  FROM ev
),
adt_raw AS (
  SELECT *, CASE kind WHEN 'signup' THEN 'A01' WHEN 'view' THEN 'A03'
           WHEN 'click' THEN (['A01','A02','A06','A08'])[e % 4 + 1]
           WHEN 'error' THEN (['A11','A13','A12','A04','A31'])[e % 5 + 1] END AS code,
         (['I','I','E','O'])[(e // 7) % 4 + 1] AS cls
  FROM fe WHERE kind <> 'purchase'
),
adt_all AS (
  SELECT 'adt_vendor_x' AS sys, 'M' || e AS rid, ts, code, cls, p, how, fac, npi_fac FROM adt_raw
  UNION ALL
  SELECT 'adt_vendor_y', 'Y' || e, ts + INTERVAL 10 MINUTE, code, cls, p, how, fac, npi_fac FROM adt_raw
  WHERE code IN ('A01','A03') AND cls = 'I' AND e % 8 = 0
),
adt_typed AS (
  SELECT *, CASE WHEN code = 'A01' THEN CASE cls WHEN 'E' THEN 'ED_ARRIVAL' WHEN 'O' THEN 'OBS_START' ELSE 'ADMIT' END
                 WHEN code = 'A03' THEN CASE cls WHEN 'E' THEN 'ED_DEPARTURE' WHEN 'O' THEN 'OBS_END' ELSE 'DISCHARGE' END
                 WHEN code = 'A02' THEN 'TRANSFER_IN' WHEN code = 'A04' THEN 'REGISTRATION' WHEN code = 'A06' THEN 'OBS_TO_IP'
                 WHEN code = 'A11' THEN 'CANCEL_ADMIT' WHEN code = 'A12' THEN 'CANCEL_TRANSFER' ELSE 'CANCEL_DISCHARGE' END AS t
  FROM adt_all WHERE code NOT IN ('A08','A31')
),
claim_raw AS (
  SELECT *, CAST(ts AS DATE) - k % 3 AS came, (['111','121','131','141','851'])[k % 5 + 1] AS bill,
         (['470','291','765','885','193','abc','','871'])[k % 8 + 1] AS drg,
         [(['J18.9','I50.9','S72.0','E11.9','O80','F32.9','R06.0','N18.3'])[(k + i) % 8 + 1] FOR i IN [0, 1, 2]] AS dx
  FROM fe WHERE kind = 'purchase' AND e % 20 <> 0
),
claim_half AS (
  SELECT *, 0 AS side, CAST(came AS TIMESTAMP) AS evt, 'CLAIM_ADMIT' AS t FROM claim_raw
  UNION ALL
  SELECT *, 1, CAST(came + k % 6 AS TIMESTAMP), 'CLAIM_DISCHARGE' FROM claim_raw WHERE e % 40 <> 3
),
canon AS (
  SELECT sys, 'adt' AS st, rid, 0 AS side, p, ts AS evt, t, t AS t0,
         CASE WHEN t LIKE 'OBS%' THEN 'observation' WHEN t LIKE 'ED%' THEN 'ed' WHEN cls = 'I' THEN 'inpatient' WHEN cls = 'E' THEN 'ed' ELSE 'outpatient' END AS pc,
         t IN ('ADMIT','ED_ARRIVAL','OBS_START','TRANSFER_IN') AS af, t IN ('DISCHARGE','ED_DEPARTURE','OBS_END','TRANSFER_OUT') AS df,
         CAST(NULL AS VARCHAR) AS auth_status, CAST(NULL AS VARCHAR) AS payer, CAST(NULL AS VARCHAR) AS drg, CAST(NULL AS VARCHAR) AS pdx, CAST(NULL AS VARCHAR[]) AS dx,
         ts AS ingested, how, fac, npi_fac
  FROM adt_typed
  UNION ALL
  SELECT 'claims_clearinghouse', 'claims', 'C' || e, side, p, evt, t, t,
         CASE WHEN bill IN ('111','121') THEN 'inpatient' WHEN bill = '851' THEN 'ed' ELSE 'outpatient' END,
         CASE WHEN side = 0 THEN true END, CASE WHEN side = 1 THEN true END,
         NULL, 'PAY' || (k % 4), drg, dx[1], dx, ts + INTERVAL 20 DAY, how, fac, NULL
  FROM claim_half
  UNION ALL
  SELECT 'auth_portal', 'auth', 'A' || e, 0, p, ts - INTERVAL 1 HOUR,
         CASE k % 4 WHEN 0 THEN 'AUTH_REQUESTED' WHEN 1 THEN 'AUTH_APPROVED' WHEN 2 THEN 'AUTH_DENIED' ELSE 'AUTH_MODIFIED' END,
         CASE k % 4 WHEN 0 THEN 'AUTH_REQUESTED' WHEN 1 THEN 'AUTH_APPROVED' WHEN 2 THEN 'AUTH_DENIED' ELSE 'AUTH_MODIFIED' END,
         NULL, false, false, (['pending','approved','denied','modified'])[k % 4 + 1], 'PAY' || (k % 4), NULL, NULL, NULL, ts, how, fac, NULL
  FROM fe WHERE kind = 'signup' AND e % 3 = 0
),
res AS (
  SELECT *, CASE st WHEN 'claims' THEN 1 WHEN 'adt' THEN 2 ELSE 3 END AS rk,
         CASE WHEN how = 'exact' THEN 'FAC_00' || (fac + 1) WHEN npi_fac IS NOT NULL THEN 'FAC_00' || (npi_fac + 1)
              WHEN how = 'fuzzy' THEN 'FAC_002' ELSE 'FAC_' || substr(sha256('LAKESIDE WALK IN PRACTICE'), 1, 12) END AS fid,
         CASE WHEN how = 'exact' THEN 'exact' WHEN npi_fac IS NOT NULL THEN 'npi' ELSE how END AS mt
  FROM canon
)"""

_ORD = "evt, rk, sys, rid, side"
_ADMIT = "t IN ('ADMIT','CLAIM_ADMIT','ED_ARRIVAL','OBS_START')"
_LEAVE = "t IN ('DISCHARGE','CLAIM_DISCHARGE','ED_DEPARTURE','OBS_END')"

_STITCH = f"""
w0 AS (
  SELECT *, {_ADMIT} AS is_in, {_LEAVE} AS is_out, ({_LEAVE} OR t = 'CANCEL_DISCHARGE') AS mark,
         CASE WHEN lag(evt) OVER o IS NULL OR evt > lag(evt) OVER o + INTERVAL 48 HOUR OR fid <> lag(fid) OVER o THEN 1 ELSE 0 END AS b,
         row_number() OVER o AS pos
  FROM res WINDOW o AS (PARTITION BY p ORDER BY {_ORD})
),
w1 AS (SELECT *, sum(b) OVER (PARTITION BY p ORDER BY pos) AS base FROM w0),
w2 AS (
  SELECT *, max(CASE WHEN mark THEN pos END) OVER q AS m_pos, coalesce(max(CASE WHEN pc = 'inpatient' THEN 1 END) OVER q, 0) AS seen
  FROM w1 WINDOW q AS (PARTITION BY p, base ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
w3 AS (
  SELECT w2.*, coalesce(w2.is_in AND w2.pc = 'inpatient' AND m.is_out AND w2.seen = 1, false) AS cand
  FROM w2 LEFT JOIN w1 m ON m.p = w2.p AND m.pos = w2.m_pos
),
w4 AS (SELECT *, cand AND row_number() OVER (PARTITION BY p, base, m_pos, cand ORDER BY pos) = 1 AS split FROM w3),
w5 AS (SELECT *, sum(CASE WHEN b = 1 OR split THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY pos) AS enc FROM w4),
enc_id AS (
  SELECT p, enc, sha256(p || '|' || arg_min(fid, pos) || '|' || coalesce(arg_min(rid, pos) FILTER (WHERE is_in), arg_min(rid, pos))) AS eid
  FROM w5 GROUP BY p, enc
),
st AS (SELECT w5.*, enc_id.eid FROM w5 JOIN enc_id USING (p, enc)),
dup AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY eid, t, fid, cl ORDER BY CASE st WHEN 'adt' THEN 100 WHEN 'claims' THEN 80 ELSE 40 END DESC, ingested, pos) > 1 THEN 'duplicate' END AS role
  FROM (SELECT *, sum(far) OVER (PARTITION BY eid, t, fid ORDER BY pos) AS cl
        FROM (SELECT *, CASE WHEN evt <= lag(evt) OVER (PARTITION BY eid, t, fid ORDER BY pos) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS far FROM st))
)"""

_STAYS = """
stay AS (
  SELECT eid, any_value(p) AS p, any_value(fid) AS fid,
    CASE min(CASE pc WHEN 'inpatient' THEN 1 WHEN 'observation' THEN 2 WHEN 'ed' THEN 3 WHEN 'outpatient' THEN 4 END) WHEN 1 THEN 'inpatient' WHEN 2 THEN 'observation' WHEN 3 THEN 'ed_only' ELSE 'outpatient' END AS etype,
    coalesce(arg_max(is_out, pos) FILTER (WHERE mark), false) AS has_d,
    CASE WHEN arg_max(t, pos) FILTER (WHERE t IN ('CANCEL_ADMIT','CANCEL_DISCHARGE')) = 'CANCEL_ADMIT' THEN 'cancelled'
         WHEN coalesce(max(pos) FILTER (WHERE is_out), 0) > coalesce(max(pos) FILTER (WHERE t = 'CANCEL_DISCHARGE'), 0) THEN 'closed' ELSE 'open' END AS status,
    coalesce(min(evt) FILTER (WHERE is_in), min(evt)) AS admit_ts, max(evt) FILTER (WHERE is_out) AS d_ts, min(evt) AS first_ts, count(*) AS n,
    array_to_string(list_sort(list(DISTINCT sys)), ',') AS systems,
    bool_or(st = 'adt') AS has_adt, bool_or(st = 'claims') AS has_claims, bool_or(st = 'auth') AS has_auth, bool_or(t = 'OBS_TO_IP') AS obs
  FROM dup GROUP BY eid
)"""

_RECON = """
prio AS (SELECT *, CASE st WHEN 'adt' THEN -100 WHEN 'claims' THEN -80 ELSE -40 END AS tp, CASE st WHEN 'claims' THEN -100 WHEN 'adt' THEN -80 ELSE -40 END AS cp FROM dup),
rec0 AS (
  SELECT eid,
    arg_min({'a': evt, 's': st}, {'x': tp, 'y': evt}) FILTER (WHERE is_in) AS adm, arg_min({'a': evt, 's': st}, pos) AS fst,
    arg_min({'a': evt, 's': st}, {'x': tp, 'y': evt}) FILTER (WHERE is_out) AS dis,
    arg_min(pc, {'x': cp, 'y': pos}) FILTER (WHERE pc IS NOT NULL) AS pc, arg_min(drg, {'x': cp, 'y': pos}) FILTER (WHERE drg IS NOT NULL) AS drg,
    arg_min(payer, {'x': cp, 'y': pos}) FILTER (WHERE payer IS NOT NULL) AS payer, arg_min(pdx, {'x': cp, 'y': pos}) FILTER (WHERE pdx IS NOT NULL) AS pdx,
    bool_or(st = 'adt') AS adt, bool_or(st = 'claims') AS claims, bool_or(st = 'auth') AS auth, bool_or(is_in) AS any_in, bool_or(is_out) AS any_out,
    abs(epoch_us(min(evt) FILTER (WHERE is_in AND st = 'adt')) - epoch_us(min(evt) FILTER (WHERE is_in AND st = 'claims'))) AS gap_in,
    abs(epoch_us(min(evt) FILTER (WHERE is_out AND st = 'adt')) - epoch_us(min(evt) FILTER (WHERE is_out AND st = 'claims'))) AS gap_out,
    min(evt) FILTER (WHERE is_in) AS first_in, min(evt) AS first_at, bool_or(st = 'adt' AND is_in) AS adt_in, bool_or(st = 'adt' AND is_out) AS adt_out,
    count(DISTINCT pc) AS n_pc, bool_or(mt = 'new') AS is_new
  FROM prio GROUP BY eid
),
code AS (
  SELECT eid, array_to_string(list(c ORDER BY cp, pos, i), ',') AS dx
  FROM (SELECT eid, c, cp, pos, i, row_number() OVER (PARTITION BY eid, c ORDER BY cp, pos, i) AS n
        FROM (SELECT eid, cp, pos, unnest(dx) AS c, generate_subscripts(dx, 1) AS i FROM prio)) WHERE n = 1 GROUP BY eid
),
rec AS (
  SELECT s.*, r.* EXCLUDE (eid), coalesce(code.dx, '') AS dx, TIMESTAMP '2024-02-15' AS now,
    auth AND NOT adt AND NOT claims AS f1, coalesce(gap_in > 86400000000, false) OR coalesce(gap_out > 86400000000, false) AS f2,
    NOT has_d AND coalesce(TIMESTAMP '2024-02-15' > first_in + INTERVAL 48 HOUR, false) AS f3, any_out AND NOT any_in AS f4, claims AND NOT adt AS f5,
    adt AND NOT claims AND TIMESTAMP '2024-02-15' > first_at + INTERVAL 45 DAY AS f6, is_new AS f7
  FROM stay s JOIN rec0 r USING (eid) LEFT JOIN code USING (eid)
),
flagged AS (
  SELECT *, list_filter([CASE WHEN f1 THEN 'AUTH_WITHOUT_ADMIT' END, CASE WHEN f2 THEN 'TIMESTAMP_MISMATCH' END, CASE WHEN f3 THEN 'MISSING_DISCHARGE' END, CASE WHEN f4 THEN 'ORPHAN_DISCHARGE' END,
    CASE WHEN f5 THEN 'CLAIMS_ONLY_ENCOUNTER' END, CASE WHEN f6 THEN 'ADT_ONLY_ENCOUNTER' END, CASE WHEN f7 THEN 'FACILITY_UNRESOLVED' END], lambda x: x IS NOT NULL) AS flags
  FROM rec
)"""

_SCORE = """
scored AS (
  SELECT eid, greatest(0.0, (30 * claims::INT + 20 * adt_in::INT + 10 * adt_out::INT + 10 * auth::INT + 5 * (NOT f7)::INT + 15 * (NOT f2)::INT + 10 * (n_pc <= 1)::INT) / 100.0
      - 0.15 * f3::INT - 0.20 * f4::INT - 0.10 * f2::INT - 0.10 * f5::INT - 0.10 * f7::INT - 0.05 * f1::INT - 0.20 * stale::INT) AS conf,
    array_to_string(list_concat(list_filter([CASE WHEN claims THEN 'HAS_CLAIMS' END, CASE WHEN adt_in THEN 'HAS_ADT_ADMIT' END, CASE WHEN adt_out THEN 'HAS_ADT_DISCHARGE' END, CASE WHEN auth THEN 'HAS_AUTH' END,
      CASE WHEN NOT f7 THEN 'FACILITY_RESOLVED' END, CASE WHEN NOT f2 THEN 'TIMESTAMPS_CONSISTENT' END, CASE WHEN n_pc <= 1 THEN 'PATIENT_CLASS_CONSISTENT' END], lambda x: x IS NOT NULL),
      flags, CASE WHEN stale THEN ['STALE_OPEN_ENCOUNTER'] ELSE [] END), ',') AS shown
  FROM (SELECT *, NOT has_d AND coalesce(now > first_in + to_days(CASE fid WHEN 'FAC_004' THEN 120 WHEN 'FAC_005' THEN 60 ELSE 30 END), false) AS stale FROM flagged)
),
banded AS (SELECT *, CASE WHEN round(conf, 9) >= 0.85 THEN 'high' WHEN round(conf, 9) >= 0.60 THEN 'medium' WHEN round(conf, 9) >= 0.30 THEN 'low' ELSE 'very_low' END AS band FROM scored)"""

_DX8 = "(['J18.9','I50.9','S72.0','E11.9','O80','F32.9','R06.0','N18.3'])[o_orderkey % 8 + 1]"
_ORDERS = f"""
s AS (
  SELECT 'P' || o_custkey AS p, 'E' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS eid, o_orderdate AS a,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 9 AS INT)) END AS d, 'FAC_' || (o_orderkey % 10) AS fid,
    (['acute','acute','acute','snf','rehab','psych'])[(o_orderkey % 10) % 6 + 1] AS ft,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'inpatient' WHEN '2' THEN 'ed_only' WHEN '3' THEN 'observation' ELSE 'outpatient' END AS et,
    left(o_orderpriority, 1) = '1' AS acute, CASE WHEN o_orderkey % 23 = 0 THEN 'cancelled' WHEN o_orderkey % 17 = 0 THEN 'open' ELSE 'closed' END AS status,
    (['470','291','765','885','193','abc','','871'])[o_orderkey % 8 + 1] AS drg, CASE WHEN o_orderkey % 3 > 0 THEN {_DX8} END AS pdx,
    CASE WHEN o_orderkey % 4 > 0 THEN {_DX8} END AS dx, (o_orderkey % 100) / 100.0 AS conf,
    CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 9) * 24.0 END AS los
  FROM orders
)"""

_LINK = """
l0 AS (
  SELECT *, row_number() OVER o AS pos, count(d) OVER q AS run,
    last_value(CASE WHEN d IS NOT NULL THEN {'d': d, 'acute': acute, 'fid': fid} END IGNORE NULLS) OVER q AS pr
  FROM s WINDOW o AS (PARTITION BY p ORDER BY a, eid), q AS (PARTITION BY p ORDER BY a, eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
l1 AS (
  SELECT *, CASE WHEN pr IS NULL THEN NULL WHEN pr.acute AND acute AND a <= pr.d + INTERVAL 30 DAY THEN 'readmission' WHEN pr.acute AND NOT acute AND a <= pr.d + INTERVAL 14 DAY THEN 'post_acute'
    WHEN et = 'ed_only' AND a <= pr.d + INTERVAL 7 DAY THEN 'ed_bounceback' WHEN pr.fid = fid AND a <= pr.d + INTERVAL 90 DAY AND NOT (pr.acute AND acute AND a <= pr.d + INTERVAL 30 DAY) THEN 'planned_return' END AS k
  FROM l0
),
l2 AS (SELECT *, min((k IS NOT NULL)::INT) OVER (PARTITION BY p, run ORDER BY pos) AS ok FROM l1),
l3 AS (SELECT *, sum(1 - ok) OVER (PARTITION BY p ORDER BY pos) AS ep FROM l2),
l4 AS (SELECT *, CASE WHEN ok = 1 THEN k END AS link, sha256('episode|' || first_value(eid) OVER (PARTITION BY p, ep ORDER BY pos)) AS epid FROM l3)"""


def _type_of(first_code: str, drg: str) -> str:
    number, code = f"TRY_CAST({drg} AS INT)", f"replace(upper({first_code}), '.', '')"
    by_drg = " ".join(f"WHEN {' OR '.join(f'{number} BETWEEN {a} AND {b}' for a, b in ranges)} THEN '{name}'" for name, ranges in config.DRG_RANGES.items())
    by_code = " ".join(f"WHEN {' OR '.join(f"starts_with({code}, '{x}')" for x in prefixes)} THEN '{name}'" for name, prefixes in config.DIAGNOSIS_PREFIXES.items())
    return f"CASE {by_drg} {by_code} ELSE 'unclassified' END"


_EPISODES = f"""
e0 AS (
  SELECT epid, any_value(p) AS p, min(a) AS start, CASE WHEN bool_or(d IS NULL AND status <> 'cancelled') THEN NULL ELSE max(d) END AS fin,
    array_to_string(list(eid ORDER BY pos), ',') AS ids, count(*) AS n, coalesce(bool_or(link = 'readmission'), false) AS rd, coalesce(bool_or(link = 'post_acute'), false) AS pa,
    bool_or(acute) AS acute, CASE WHEN bool_or(status = 'open') THEN 'active' ELSE 'closed' END AS status, arg_min(pdx, pos) FILTER (WHERE pdx <> '') AS pdx,
    arg_min(drg, pos) FILTER (WHERE drg <> '') AS drg, arg_min(dx, pos) FILTER (WHERE dx IS NOT NULL) AS dx1,
    sum(conf * CASE WHEN los > 0 THEN los ELSE 1.0 END) / sum(CASE WHEN los > 0 THEN los ELSE 1.0 END) AS conf
  FROM l4 GROUP BY epid
),
ef AS (SELECT epid, array_to_string(list(fid ORDER BY m), ',') AS fs, count(*) AS nf FROM (SELECT epid, fid, min(pos) AS m FROM l4 GROUP BY ALL) GROUP BY epid),
ec AS (SELECT epid, array_to_string(list(dx ORDER BY m), ',') AS dx FROM (SELECT epid, dx, min(pos) AS m FROM l4 WHERE dx IS NOT NULL GROUP BY ALL) GROUP BY epid),
ep AS (SELECT e0.*, fs, nf, coalesce(ec.dx, '') AS dx, {_type_of("dx1", "drg")} AS et FROM e0 JOIN ef USING (epid) LEFT JOIN ec USING (epid))"""

_KEYS = "sys AS source_system, rid AS source_record_id, side"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


TRANSFERS = """, c0 AS (SELECT eid, p, fid, first_ts, CASE WHEN lag(has_d) OVER o AND lag(fid) OVER o <> fid AND first_ts >= lag(d_ts) OVER o AND first_ts <= lag(d_ts) OVER o + INTERVAL 48 HOUR THEN 0 ELSE 1 END AS b FROM stay WINDOW o AS (PARTITION BY p ORDER BY first_ts, fid, eid)),
      c1 AS (SELECT *, sum(b) OVER (PARTITION BY p ORDER BY first_ts, fid, eid) AS c FROM c0)"""
MERGED_TRANSFERS = TRANSFERS + ", chain AS (SELECT eid, n FROM (SELECT *, count(*) OVER (PARTITION BY p, c) AS n FROM c1) WHERE n > 1)"

#: Overlapping stays of a patient at a facility, folded one after another.
MERGED = """
mst AS (
  SELECT p, eid, arg_min(fid, pos) AS fac, min(evt) AS start, max(evt) FILTER (WHERE is_out) AS d, arg_max(evt, pos) FILTER (WHERE mark) AS m,
    coalesce(arg_max(is_out, pos) FILTER (WHERE mark), false) AS c FROM dup GROUP BY p, eid
),
mnum AS (SELECT *, row_number() OVER (PARTITION BY p, fac ORDER BY start, eid) AS rn FROM mst),
mg(p, fac, rn, eid, merged, d, m, c) AS (
  SELECT p, fac, rn, eid, eid, d, m, c FROM mnum WHERE rn = 1
  UNION ALL
  SELECT x.p, x.fac, x.rn, x.eid, CASE WHEN NOT s.c OR x.start <= s.d THEN s.merged ELSE x.eid END,
    CASE WHEN NOT s.c OR x.start <= s.d THEN greatest(s.d, x.d) ELSE x.d END,
    CASE WHEN (NOT s.c OR x.start <= s.d) AND s.m IS NOT NULL AND (x.m IS NULL OR x.m < s.m) THEN s.m ELSE x.m END,
    CASE WHEN (NOT s.c OR x.start <= s.d) AND s.m IS NOT NULL AND (x.m IS NULL OR x.m < s.m) THEN s.c ELSE x.c END
  FROM mg s JOIN mnum x ON x.p = s.p AND x.fac IS NOT DISTINCT FROM s.fac AND x.rn = s.rn + 1
),
dupm AS (SELECT dup.* REPLACE (mg.merged AS eid) FROM dup JOIN mg ON mg.p = dup.p AND mg.eid = dup.eid)"""
MERGED_STAYS, MERGED_RECON, MERGED_SCORE = _STAYS.replace("FROM dup", "FROM dupm"), _RECON.replace("FROM dup", "FROM dupm"), _SCORE
EVENTS, STITCH, STAYS, ORDERS, LINK, EPISODES, with_ = _EVENTS, _STITCH, _STAYS, _ORDERS, _LINK, _EPISODES, _with


ORACLE_SQL: dict[str, str] = {
    "canonical_events": _with(_EVENTS) + f" SELECT {_KEYS}, sha256(sys || '|' || rid || '|' || t0) AS event_id, p AS patient_key, strftime(evt, '%Y-%m-%d %H:%M:%S.%f') AS event_ts, t AS event_type, pc AS patient_class, af AS admit_flag, df AS discharge_flag, auth_status, payer AS payer_id, drg, pdx AS principal_diagnosis, coalesce(dx[1] || ':1,' || dx[2] || ':2,' || dx[3] || ':3', '') AS dx FROM res",
    "record_errors": _with(_EVENTS) + " SELECT 'adt_vendor_x' AS source, count(*) AS records_in, count(*) AS records_out, 0::BIGINT AS errors FROM adt_typed WHERE sys = 'adt_vendor_x' UNION ALL SELECT 'adt_vendor_y', count(*), count(*), 0 FROM adt_typed WHERE sys = 'adt_vendor_y' UNION ALL SELECT 'claims_clearinghouse', count(*), count(*), 0 FROM claim_raw UNION ALL SELECT 'auth_portal', count(*), count(*), 0 FROM canon WHERE st = 'auth'",
    "facility_resolution": _with(_EVENTS) + f" SELECT {_KEYS}, fid AS facility_id, mt AS facility_match_type FROM res",
    "new_facilities": _with(_EVENTS) + " SELECT fid AS facility_id, 'Lakeside Walk-In Practice' AS canonical_name, count(*) AS n_events FROM res WHERE mt = 'new' GROUP BY fid",
    "stitch_sessions": _with(_EVENTS, _STITCH) + f" SELECT {_KEYS}, CAST(enc AS BIGINT) AS encounter_no, eid AS encounter_id FROM st",
    "near_duplicates": _with(_EVENTS, _STITCH) + f" SELECT {_KEYS}, coalesce(role, 'kept') AS role FROM dup",
    "encounter_metadata": _with(_EVENTS, _STITCH, _STAYS) + " SELECT eid AS encounter_id, p AS patient_key, etype AS encounter_type, status, has_d AS has_discharge, strftime(admit_ts, '%Y-%m-%d %H:%M:%S.%f') AS admit_ts, strftime(CASE WHEN has_d THEN d_ts END, '%Y-%m-%d %H:%M:%S.%f') AS discharge_ts, round(CASE WHEN has_d THEN (epoch_us(d_ts) - epoch_us(admit_ts)) / 3600000000 END, 6) AS los_hours, n AS n_events, systems AS source_systems, has_adt, has_claims, has_auth, obs AS obs_to_ip FROM stay",
    "transfer_chains": _with(_EVENTS, _STITCH, _STAYS) + TRANSFERS + """
      SELECT eid AS encounter_id, CAST(n AS INT) AS chain_length, s AS chain_start FROM (SELECT *, count(*) OVER (PARTITION BY p, c) AS n, first_value(eid) OVER (PARTITION BY p, c ORDER BY first_ts, fid, eid) AS s FROM c1) WHERE n > 1""",
    "reconciled": _with(_EVENTS, _STITCH, _STAYS, _RECON) + " SELECT eid AS encounter_id, strftime(coalesce(adm.a, fst.a), '%Y-%m-%d %H:%M:%S.%f') AS reconciled_admit_ts, coalesce(adm.s, fst.s) AS admit_source, strftime(dis.a, '%Y-%m-%d %H:%M:%S.%f') AS reconciled_discharge_ts, dis.s AS discharge_source, CASE coalesce(pc, 'outpatient') WHEN 'ed' THEN 'ed_only' ELSE coalesce(pc, 'outpatient') END AS reconciled_type, drg, payer AS payer_id, pdx AS principal_diagnosis, dx, array_to_string(flags, ',') AS flags FROM flagged",
    "flag_counts": _with(_EVENTS, _STITCH, _STAYS, _RECON) + " SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM flagged) GROUP BY flag",
    "confidence_scores": _with(_EVENTS, _STITCH, _STAYS, _RECON, _SCORE) + " SELECT eid AS encounter_id, round(conf::DOUBLE, 6) AS confidence, shown AS confidence_flags, band FROM banded",
    "confidence_bands": _with(_EVENTS, _STITCH, _STAYS, _RECON, _SCORE) + " SELECT band, count(*) AS n, round(avg(conf::DOUBLE), 6) AS avg_confidence FROM banded GROUP BY band",
    "event_roles": _with(_EVENTS, _STITCH, _STAYS, _RECON) + f""", r0 AS (SELECT dup.*, CASE WHEN role IS NULL AND is_in AND evt = coalesce(adm.a, fst.a) THEN 'admit_anchor' WHEN role IS NULL AND is_out AND evt = dis.a THEN 'discharge_anchor' END AS k FROM dup JOIN rec0 USING (eid))
      SELECT {_KEYS}, coalesce(role, CASE WHEN k IS NOT NULL AND row_number() OVER (PARTITION BY eid, k ORDER BY pos) = 1 THEN k END, 'supporting') AS role_in_encounter FROM r0""",
    "readmissions": _with(_ORDERS) + """, n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY a, eid) AS pos FROM s),
      hit AS (SELECT c.eid, arg_max(b.d, b.pos) AS d, arg_max(b.eid, b.pos) AS prior FROM n c JOIN n b ON b.p = c.p AND b.pos < c.pos AND b.ft = 'acute' AND b.d IS NOT NULL AND b.d > c.a - INTERVAL 31 DAY WHERE c.ft = 'acute' GROUP BY c.eid)
      SELECT n.eid AS encounter_id, hit.eid IS NOT NULL AS is_readmission, CAST(floor((epoch_us(n.a) - epoch_us(hit.d)) / 86400000000) AS INT) AS readmission_days, prior AS prior_encounter_id FROM n LEFT JOIN hit USING (eid)""",
    "episode_links": _with(_ORDERS, _LINK) + " SELECT eid AS encounter_id, link, CAST(ep AS BIGINT) AS episode_no, epid AS episode_id FROM l4",
    "episode_rows": _with(_ORDERS, _LINK, _EPISODES) + " SELECT epid AS episode_id, p AS patient_key, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS episode_start_ts, strftime(fin, '%Y-%m-%d %H:%M:%S.%f') AS episode_end_ts, round((epoch_us(fin) - epoch_us(start)) / 86400000000, 6) AS total_los_days, ids AS encounter_ids, n AS encounter_count, fs AS facility_sequence, CAST(nf AS INT) AS facility_count, rd AS includes_readmission, pa AS includes_post_acute, acute AS is_acute, status AS episode_status, pdx AS principal_diagnosis, et AS episode_type, round(conf::DOUBLE, 6) AS confidence_score, dx FROM ep",
    "episode_quality": _with(_ORDERS, _LINK, _EPISODES) + " SELECT count(*) AS episodes, round(avg(rd::INT), 6) AS readmission_rate, round(avg(conf::DOUBLE), 6) AS avg_confidence FROM ep",
    "facility_registry": "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'NPI:' ELSE 'CCN:' END || s_suppkey AS canonical_id, s_name AS canonical_name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS npi, CASE WHEN s_suppkey % 2 = 1 THEN CAST(s_suppkey AS VARCHAR) END AS ccn, (['acute','acute','acute','snf','rehab','psych'])[s_suppkey % 6 + 1] AS facility_type, upper(s_name) AS aliases, s_suppkey || ' Main St, ' || CASE WHEN s_suppkey % 3 > 0 THEN 'Springfield, IL' ELSE 'IL' END || CASE WHEN s_suppkey % 5 > 0 THEN ' 62701' ELSE '' END AS address FROM supplier",
    "overlap_merge": _with(_EVENTS, _STITCH, MERGED).replace("WITH", "WITH RECURSIVE", 1) + " SELECT count(*) AS events_before, count(*) FILTER (WHERE role IS NULL) AS events_after, count(*) FILTER (WHERE role = 'duplicate') AS duplicates, (SELECT count(DISTINCT eid) - count(DISTINCT merged) FROM mg) AS encounters_merged FROM dup",
    "incremental_scan": _with(_EVENTS) + " SELECT rid AS message_control_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS message_ts, code AS hl7_event FROM adt_typed WHERE sys = 'adt_vendor_x' AND ts > TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR",
    "upserted_stays": _with(_ORDERS) + " SELECT eid AS encounter_id, p AS patient_key, CASE WHEN CAST(substr(p, 2) AS INT) % 2 = 0 THEN 'closed' ELSE status END AS status, 'first' AS created_at FROM s",
}
