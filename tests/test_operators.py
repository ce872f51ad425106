"""Operators against plain folds on random rows, and hand-made cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from careweave import config
from careweave.config import Settings, Source
from careweave.functions import rules, similarity
from careweave.operators import canonical, dedup, encounters, episodes, facility, quality, score, stitch
from careweave.sources import registry, scan

T0 = datetime(2024, 1, 1)
EVENT = "patient_key string, event_ts timestamp, event_type string, patient_class string, facility_id string, facility_name string, source_type string, source_system string, source_record_id string, side int, event_id string, ingested_at timestamp"
KINDS = ("ADMIT", "DISCHARGE", "CANCEL_DISCHARGE", "CANCEL_ADMIT", "CLAIM_ADMIT", "CLAIM_DISCHARGE", "REGISTRATION", "OBS_START")


def event(p, hours, kind, cls="inpatient", fac="F1", src="adt", n=0):
    return (p, T0 + timedelta(hours=hours), kind, cls, fac, fac, src, f"{src}_x", f"{n:05d}", 0, f"{p}-{n}", T0)


def random_events(patients, n, kinds=KINDS):
    r, out = random.Random(11), []
    for p in range(patients):
        at = 0
        for k in range(n):
            at += r.choice([0, 1, 5, 20, 48, 49, 60])
            out.append(event(f"P{p}", at, r.choice(kinds), r.choice(["inpatient", "inpatient", "ed", None]), r.choice(["F1", "F1", "F1", "F2", None]), r.choice(["adt", "claims", "auth"]), p * 1000 + k))
    return out


RANK = {"claims": 1, "adt": 2, "auth": 3}


def ordered(rows):
    return sorted(rows, key=lambda e: (e[1], RANK[e[6]], e[7], e[8], e[9]))


def fold_stitch(rows):
    """Plain fold over one patient's events: list of encounters (lists of events)."""
    out = []
    for e in ordered(rows):
        if out:
            cur = out[-1]
            gap = e[1] - cur["last"] > timedelta(hours=48)
            far = e[4] is None or cur["fac"] is None or e[4] != cur["fac"]
            force = cur["has"] and e[2] in config.ADMIT_TYPES and e[3] == "inpatient" and cur["ip"]
        if not out or gap or far or force:
            out.append({"fac": e[4], "events": [], "has": False, "ip": False})
            cur = out[-1]
        cur["events"].append(e)
        cur["last"] = e[1]
        cur["ip"] |= e[3] == "inpatient"
        if e[2] in config.DISCHARGE_TYPES:
            cur["has"] = True
        if e[2] == "CANCEL_DISCHARGE":
            cur["has"] = False
    return out


@pytest.fixture(scope="module")
def stitched(spark):
    rows = random_events(40, 25)
    return rows, stitch.stitch(spark.createDataFrame(rows, EVENT)).cache()


def test_stitching_equals_a_fold(spark, stitched):
    rows, got = stitched
    want = {}
    for p in {e[0] for e in rows}:
        for k, enc in enumerate(fold_stitch([e for e in rows if e[0] == p]), 1):
            want |= {e[10]: k for e in enc["events"]}
    assert {r["event_id"]: r["encounter_no"] for r in got.collect()} == want
    general = Settings(transitions=(("inpatient", "inpatient"), ("inpatient", "inpatient")))
    assert {r["event_id"]: r["encounter_no"] for r in stitch.stitch(spark.createDataFrame(rows, EVENT), general).collect()} == want


HEAVY = Settings(slice_rows=3)
#: A record number that stands for many patients: half of all events, many within a session.
CROWD = [(p if k % 2 else "P0", *rest) for k, (p, *rest) in enumerate(random_events(20, 30))]


def test_heavy_patients_are_cut_and_come_out_the_same(spark, monkeypatch):
    from careweave.operators import slices

    monkeypatch.setattr(slices, "SHARE", 10_000)
    df = spark.createDataFrame(CROWD, EVENT).cache()
    cut = slices.Slices.of(df, ["patient_key"], "event_ts", 3)
    assert cut.cells.count() == 20 and cut.cut(df, "event_ts").where("patient_key = 'P0'").select("_slice").distinct().count() > 40
    for more in ({}, {"transitions": (("inpatient", "inpatient"), ("ed", "inpatient"))}, {"facility_must_match": False, "window_hours": 200}):
        whole, parts = (stitch.stitch(df, Settings(**more, **s)).cache() for s in ({}, {"slice_rows": 3}))
        numbers = lambda rows: sorted((r["event_id"], r["encounter_no"], r["encounter_id"]) for r in rows.collect())
        assert numbers(whole) == numbers(parts) and whole.columns == parts.columns
        marks = lambda s: sorted((r["event_id"], str(r["role"])) for r in dedup.mark_duplicates(whole, s).collect())
        assert marks(Settings()) == marks(HEAVY)
        merged = lambda s: sorted((r["event_id"], r["merged_id"]) for r in dedup.merge_overlaps(whole, s).collect())
        assert merged(Settings()) == merged(HEAVY)
        stays = stitch.encounters(whole).cache()
        chains = lambda s: sorted((r["encounter_id"], r["transfer_chain"] or []) for r in stitch.transfers(stays, s).collect())
        assert chains(Settings()) == chains(HEAVY)


def test_running_values_equal_plain_windows(spark, monkeypatch):
    from careweave.operators import slices
    from pyspark.sql.window import Window

    monkeypatch.setattr(slices, "SHARE", 10_000)
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "b", None]), T0 + timedelta(hours=r.randrange(300)), k, r.choice([None, r.randrange(50)])) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, t timestamp, n int, v int").cache()
    cut = slices.Slices.of(df, ["k"], "t", 5)
    got = cut.running(cut.cut(df, "t"), [F.col("t"), F.col("n")], s=("sum", F.col("v")), m=("max", F.col("v")), last=("last", F.col("v")), latest=("latest", F.col("v")))
    w = Window.partitionBy("k").orderBy("t", "n")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("n", F.sum("v").over(upto), F.max("v").over(before), F.last("v", True).over(before), F.last("v", True).over(upto))
    assert sorted(map(tuple, got.select("n", "s", "m", "last", "latest").collect())) == sorted(map(tuple, want.collect()))
    assert cut.cut(df, "t").groupBy("k", "_slice").count().agg(F.max("count")).first()[0] <= 20


def test_heavy_patients_in_episodes(spark, monkeypatch):
    from careweave.operators import slices

    monkeypatch.setattr(slices, "SHARE", 10_000)
    r, rows = random.Random(6), []
    for k in range(500):
        came = T0 + timedelta(days=r.randrange(900))
        rows.append(("P0" if k % 2 else f"P{k % 7}", f"E{k:04d}", came, r.choice([None, came + timedelta(days=r.randrange(9))]), "acute", f"F{r.randrange(3)}", r.random() < 0.5, r.choice(["inpatient", "ed_only"])))
    df = spark.createDataFrame(rows, STAY).cache()
    found = lambda s: sorted(map(str, episodes.link(df, s).select("encounter_id", "link", "episode_no", "episode_id").collect()))
    assert found(Settings()) == found(HEAVY)


def test_order_of_input_does_not_matter(spark, stitched):
    rows, got = stitched
    shuffled = stitch.stitch(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), EVENT).repartition(13))
    assert sorted((r["event_id"], r["encounter_id"]) for r in shuffled.collect()) == sorted((r["event_id"], r["encounter_id"]) for r in got.collect())


def test_status_of_encounters(spark):
    rows = [event("A", 0, "ADMIT"), event("A", 5, "DISCHARGE", n=1), event("A", 6, "CANCEL_DISCHARGE", n=2), event("B", 0, "ADMIT", n=3), event("B", 1, "CANCEL_ADMIT", n=4), event("B", 2, "DISCHARGE", n=5), event("C", 0, "ED_ARRIVAL", "ed", n=6), event("C", 4, "ADMIT", n=7), event("C", 30, "DISCHARGE", n=8)]
    got = {r["patient_key"]: r for r in stitch.encounters(stitch.stitch(spark.createDataFrame(rows, EVENT))).collect()}
    assert [got[p]["status"] for p in "ABC"] == ["open", "cancelled", "closed"]
    assert got["C"]["encounter_type"] == "inpatient" and got["C"]["los_hours"] == 30 and got["A"]["discharge_ts"] is None


def test_gap_of_exactly_the_window(spark):
    rows = [event("A", 0, "ADMIT"), event("A", 48, "REGISTRATION", n=1), event("B", 0, "ADMIT", n=2), event("B", 48.001, "REGISTRATION", n=3)]
    got = {(r["patient_key"], r["encounter_no"]) for r in stitch.stitch(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {("A", 1), ("B", 1), ("B", 2)}


def test_transfer_chain(spark):
    rows = [event("A", 0, "ADMIT"), event("A", 10, "DISCHARGE", n=1), event("A", 20, "ADMIT", fac="F2", n=2), event("A", 30, "DISCHARGE", fac="F2", n=3), event("A", 50, "ADMIT", fac="F3", n=4), event("A", 200, "ADMIT", fac="F1", n=5)]
    got = stitch.transfers(stitch.encounters(stitch.stitch(spark.createDataFrame(rows, EVENT)))).orderBy("first_event_ts").collect()
    assert [len(r["transfer_chain"] or []) for r in got] == [3, 3, 3, 0] and got[0]["transfer_chain"] == [r["encounter_id"] for r in got[:3]]


def test_near_duplicates_chain(spark):
    hours = [0, 0.5, 25 / 60 + 0.5, 10, 10 + 31 / 60]
    rows = [event("A", h, "ADMIT", None, src=s, n=k) for k, (h, s) in enumerate(zip(hours, ["claims", "adt", "adt", "adt", "adt"], strict=True))]
    got = dedup.mark_duplicates(stitch.stitch(spark.createDataFrame(rows, EVENT))).collect()
    assert {r["event_id"]: r["role"] for r in got} == {"A-0": "duplicate", "A-1": None, "A-2": "duplicate", "A-3": None, "A-4": None}


@pytest.mark.parametrize("kinds", [KINDS, tuple(k for k in KINDS if "CANCEL" not in k)])
def test_overlap_merge_equals_a_fold(spark, kinds):
    rows = random_events(30, 20, kinds)
    got = dedup.merge_overlaps(stitch.stitch(spark.createDataFrame(rows, EVENT)))
    stays = {}
    for r in got.collect():
        stays.setdefault(r["encounter_id"], []).append(r)
    groups, want = {}, {}
    for eid, es in stays.items():
        es.sort(key=lambda e: (e["event_ts"], RANK[e["source_type"]], e["source_system"], e["source_record_id"]))
        marks = [e for e in es if e["event_type"] in config.DISCHARGE_TYPES or e["event_type"] == "CANCEL_DISCHARGE"]
        outs = [e["event_ts"] for e in es if e["event_type"] in config.DISCHARGE_TYPES]
        groups.setdefault((es[0]["patient_key"], es[0]["facility_id"]), []).append({"id": eid, "start": es[0]["event_ts"], "out": max(outs, default=None), "mark": marks[-1]["event_ts"] if marks else None, "closed": bool(marks) and marks[-1]["event_type"] in config.DISCHARGE_TYPES})
    for g in groups.values():
        cur = None
        for x in sorted(g, key=lambda x: (x["start"], x["id"])):
            if cur and (not cur["closed"] or x["start"] <= cur["out"]):
                cur["out"] = max((t for t in (cur["out"], x["out"]) if t), default=None)
                if x["mark"] and (not cur["mark"] or x["mark"] >= cur["mark"]):
                    cur["mark"], cur["closed"] = x["mark"], x["closed"]
            else:
                cur = dict(x)
            want[x["id"]] = cur["id"]
    assert {eid: es[0]["merged_id"] for eid, es in stays.items()} == want


STAY = "patient_key string, encounter_id string, admit_ts timestamp, discharge_ts timestamp, facility_type string, facility_id string, is_acute boolean, encounter_type string"


def test_readmissions_and_episodes_equal_folds(spark):
    r, rows = random.Random(4), []
    for k in range(900):
        a = T0 + timedelta(days=r.randint(0, 500))
        t = r.choice(["acute", "acute", "snf"])
        rows.append((f"P{k % 60}", f"E{k:04d}", a, a + timedelta(days=r.randint(0, 40)) if r.random() < 0.8 else None, t, r.choice(["F1", "F2"]), t == "acute", r.choice(["inpatient", "ed_only"])))
    df = spark.createDataFrame(rows, STAY)
    again = {x["encounter_id"]: x["readmission_days"] for x in encounters.readmissions(df).collect()}
    linked = {x["encounter_id"]: (x["link"], x["episode_no"]) for x in episodes.link(df).collect()}
    for p in {x[0] for x in rows}:
        mine, group, no = sorted((x for x in rows if x[0] == p), key=lambda x: (x[2], x[1])), [], 0
        for i, x in enumerate(mine):
            hit = next((y for y in reversed(mine[:i]) if y[4] == "acute" and y[3] and (x[2] - y[3]).days <= 30), None) if x[4] == "acute" else None
            assert again[x[1]] == ((x[2] - hit[3]).days if hit else None)
            prior = next((y for y in reversed(group) if y[3]), None)
            kind = None
            if prior:
                gap = x[2] - prior[3]
                if prior[6] and x[6] and gap <= timedelta(30):
                    kind = "readmission"
                elif prior[6] and not x[6] and gap <= timedelta(14):
                    kind = "post_acute"
                elif x[7] == "ed_only" and gap <= timedelta(7):
                    kind = "ed_bounceback"
                elif prior[5] == x[5] and gap <= timedelta(90):
                    kind = "planned_return"
            group = [*group, x] if kind else [x]
            no += kind is None
            assert linked[x[1]] == (kind, no)


def test_rule_languages(spark):
    df = spark.createDataFrame([("A01 ", "E", "11_x"), (None, "E", "x11"), ("A01", "O", None)], "code string, cls string, bill string")
    one = lambda c: [r[0] for r in df.select(c).collect()]
    assert one(rules.equalities("code == 'A01' AND cls == 'E'")) == [True, False, False] and one(rules.equalities("code > 'A'")) == [False] * 3
    assert one(rules.class_rule("bill LIKE '11_%'")) == [True, False, False] and one(rules.class_rule("bill like '%11'")) == [False, True, False]
    assert one(rules.class_rule("bill IN ('x11', 'y')")) == [False, True, False] and one(rules.class_rule("bill = 'x11'")) == [False, True, False] and one(rules.class_rule("bill ~ 'x'")) == [False] * 3
    assert one(rules.type_in("event_type IN ('A01', 'B')", F.trim("code"))) == [True, False, True] and one(rules.type_in("nonsense", F.col("code"))) == [False] * 3


def test_names(spark):
    names = {"St. Mary's Med Ctr": "SAINT MARYS", "Memorial Regional Hosp.": "MEMORIAL REGIONAL", "HOSPITAL": "HOSPITAL", "Mt Sinai Health System East Campus": "MOUNT SINAI EAST CAMPUS", "  ": "", None: "", "Tri-City Genl Hosp - Main": "TRI CITY GENERAL MAIN", "EASTHEALTH": "EAST"}
    df = spark.createDataFrame([(k,) for k in names], "name string")
    assert [r[0] for r in df.select(rules.normal_name(F.col("name"))).collect()] == list(names.values())
    assert similarity.common_subsequence("ABCBDAB", "BDCABA") == 4 and similarity.token_sort_ratio("b a", "a b") == 1.0
    assert abs(similarity.token_sort_ratio("abcd", "abxd") - 0.75) < 1e-12


def test_diagnoses_and_claims(spark):
    raw = ['["J18.9", " ", "R06.0"]', '[{"code": "A", "type": "T", "sequence": 4}]', "J18.9, ;R06.0|X", "", None, "[broken"]
    got = spark.createDataFrame([(x,) for x in raw], "x string").select(canonical.diagnoses(F.col("x"))).collect()
    codes = [[(c["code"], c["sequence"]) for c in r[0]] if r[0] else None for r in got]
    assert codes == [[("J18.9", 1), ("R06.0", 3)], [("A", 4)], [("J18.9", 1), ("R06.0", 2), ("X", 3)], None, None, [("[broken", 1)]]
    source = Source(name="claims_a", kind="claims", fields={"patient_key": "p", "source_record_id": "c"}, incremental_key="k", admit=("a", "CLAIM_ADMIT"), discharge=("d", "CLAIM_DISCHARGE"))
    rows = spark.createDataFrame([("1", "c1", "2024-01-01", "2024-01-02", "2024-01-03"), ("1", "c2", "2024-01-01", None, None), (" ", "c3", "2024-01-01", None, None), ("1", "c4", "no date", None, None)], "p string, c string, a string, d string, k string")
    got = canonical.canonicalize(rows, source).collect()
    assert sorted((r["source_record_id"], r["side"]) for r in got) == [("c1", 0), ("c1", 1), ("c2", 0)]
    assert canonical.error_counts(rows, source).first()["errors"] == 2


def test_scans_and_sinks(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 2, None)], "id string, k int, v string")
    assert sorted((r["id"] or "", r["k"]) for r in scan.first_per_record(df, "id", "k").collect()) == [("", 1), ("", 2), ("a", 1)]
    assert scan.exclude(df, "v = 'x'").count() == 2  # a null predicate drops the row too
    assert scan.lookback_hours({"adt": "3d", "default": "5"}, "adt") == 72 and scan.lookback_hours({"default": "5"}, "auth") == 5
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "key int, v string, made int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "key int, v string, made int")
    assert sorted(map(tuple, scan.upsert(old, new, "key", keep="made").collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 9)]
    assert sorted(r["v"] for r in scan.replace_children(old, new, "key").collect()) == ["a", "c", "d"]
    assert sorted(r["v"] for r in scan.insert_new(new, old, "key").collect()) == ["a", "b", "d"]
    marts = scan.refresh_mart(spark.createDataFrame([(1, 5), (2, 1)], "key int, updated_at int"), spark.createDataFrame([(2, 3)], "key int, updated_at int"), "key")
    assert sorted(map(tuple, marts.collect())) == [(1, 5), (2, 3)]


def test_stable_ids_and_history(spark):
    stays = "encounter_id string, patient_key string, facility_id string, first_event_ts timestamp, last_event_ts timestamp"
    at = lambda h: T0 + timedelta(hours=h)
    new = spark.createDataFrame([("n1", "P", "F", at(100), at(120)), ("n2", "P", "F", at(900), at(901)), ("n3", "P", None, at(100), at(101))], stays)
    old = spark.createDataFrame([("o1", "P", "F", at(60), at(70)), ("o2", "P", "F", at(90), at(95)), ("o3", "P", "G", at(100), at(101))], stays)
    assert dict(map(tuple, stitch.stable_ids(new, old, "2024-01-20").collect())) == {"n1": "o2", "n2": "n2", "n3": "n3"}
    h = spark.createDataFrame([("e1", "P", at(0)), ("e2", "P", at(0)), ("e3", "Q", at(0))], "event_id string, patient_key string, event_ts timestamp")
    b = spark.createDataFrame([("e2", "P", at(5))], h.schema)
    assert sorted((r["event_id"], r["event_ts"]) for r in scan.recent_history(h, b, "2024-01-20", 90).collect()) == [("e1", at(0)), ("e2", at(5))]


def test_registry(spark):
    nppes = spark.createDataFrame([("1", "2", "Org A", "Other A", "T1", "X"), ("2", "1", "Person", "", "", ""), ("3", "2", "", "Only other", "", "")], f"NPI string, `Entity Type Code` string, `{registry.NPPES_NAME}` string, `{registry.NPPES_OTHER}` string, `Healthcare Provider Taxonomy Code_1` string, `Healthcare Provider Taxonomy Code_2` string")
    others = spark.createDataFrame([("1", "Third A"), ("1", "")], f"NPI string, `{registry.NPPES_OTHER}` string")
    pos = spark.createDataFrame([("010001", "Hosp", "01", "02", "1 Road", "Town", "AL", "36")], "PRVDR_NUM string, FAC_NAME string, PRVDR_CTGRY_CD string, PRVDR_CTGRY_SBTYP_CD string, ST_ADR string, CITY_NAME string, STATE_CD string, ZIP_CD string")
    built = registry.build_registry(nppes, others, pos)
    assert built.columns == list(registry.COLUMNS)
    got = {r["canonical_id"]: r for r in registry.load_registry(built).collect()}
    assert set(got) == {"NPI:1", "NPI:3", "CCN:010001"} and got["NPI:1"]["aliases"] == ["Other A", "Third A"] and got["NPI:3"]["canonical_name"] == "Only other"
    assert got["CCN:010001"]["address"] == "1 Road, Town, AL 36" and got["CCN:010001"]["facility_type"] == "ltach" and got["NPI:1"]["address"] is None
    assert registry.load_registry(built, use_npi=False).count() == 1


def test_facility_cascade(spark):
    known = spark.createDataFrame([("F1", "Good Samaritan Hospital", "11", None, "acute", ["GOOD SAM"], 0), ("F2", "Good Sam", None, "22", "snf", [], 1)], "canonical_id string, canonical_name string, npi string, ccn string, facility_type string, aliases array<string>, ordinal int")
    big = spark.createDataFrame([("NPI:9", "Far Clinic", "9", None, None, [], 0)], known.schema)
    rows = spark.createDataFrame([(1, "good sam", "11", None, None, None), (2, "unknown", "11", "22", None, None), (3, "unknown", None, "22", None, None), (4, "nowhere", " 9 ", None, None, None), (5, "Good Samaritn", None, None, None, None), (6, "Brand New", None, None, None, None), (7, " ", "11", None, None, None), (8, "x", None, None, "F7", "customer_provided")], "n int, facility_raw string, npi string, ccn string, facility_id string, facility_match_type string")
    got = {r["n"]: (r["facility_id"], r["facility_match_type"]) for r in facility.resolve(rows, known, big).collect()}
    assert got[1] == ("F2", "exact") and got[2] == ("F1", "npi") and got[3] == ("F2", "ccn") and got[4] == ("NPI:9", "npi_registry") and got[5] == ("F1", "fuzzy")
    assert got[6][1] == "new" and got[6][0].startswith("FAC_") and got[7] == (None, None) and got[8] == ("F7", "customer_provided")
    assert {r["facility_match_type"] for r in facility.resolve(rows, known, threshold=0).collect()} >= {"new"}


def test_quality_tables(spark):
    scored = spark.createDataFrame([(["MISSING_DISCHARGE"], 0.5), ([], 0.9), ([], 0.6)], "confidence_flags array<string>, confidence double")
    stages = spark.createDataFrame([(100, 4), (0, 1)], "records_in long, errors long")
    judged = quality.statuses(quality.metrics(scored, stages, spark.createDataFrame([(7,)], "n long")))
    got = {r["metric_name"]: (round(r["metric_value"], 4), r["status"]) for r in judged.collect()}
    assert len(got) == 12 and got["missing_discharge_rate"] == (0.3333, "fail") and got["failed_event_rate"] == (0.05, "fail") and got["low_confidence_rate"] == (0.3333, "fail") and got["events_ingested"] == (7, "pass")
    assert quality.blocked(judged).count() == 3 and quality.alerts(judged).count() == 3 and quality.error_halt(stages).first()["halt"]
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "z")], "k int, v string")
    assert quality.not_null(df, "v").count() == 1 and quality.unique(df, "k").count() == 1 and quality.accepted_values(df, "v", ["a"]).count() == 1
    assert quality.relationships(df, "k", df.where("k = 1"), "k").count() == 1
    assert [r[0] for r in spark.createDataFrame([(0.85,), (0.6,), (0.3,), (0.29,)], "x double").select(score.band(F.col("x"))).collect()] == ["high", "medium", "low", "very_low"]


def test_episode_types(spark):
    rows = [("I50.9", "470"), ("I50.9", "abc"), ("o80", None), ("F32", None), ("S72.0", None), ("Z99", None), (None, None), ("X", "885")]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, d string").select(rules.episode_type(F.col("c"), F.col("d"))).collect()]
    assert got == ["surgical", "chronic_exacerbation", "maternity", "behavioral_health", "surgical", "medical", "unclassified", "behavioral_health"]
