"""Rows of a source to canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweave.config import Source
from careweave.functions import rules

DX = "array<struct<code:string,type:string,sequence:int,poa:string>>"
OPTIONAL = ("facility_raw", "facility_id", "npi", "ccn", "patient_class", "payer_id", "drg", "principal_diagnosis", "admitting_diagnosis")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def time(df: DataFrame, name: str) -> Column:
    return rules.parse_ts(F.col(name), df.schema[name].dataType.typeName())


def reason(df: DataFrame, source: Source) -> Column:
    """Why a row is rejected: it has no patient, or its time is missing or can't be read."""
    ts = source.admit[0] if source.admit else source.fields["event_ts"]
    return (
        F.when(blank(F.col(source.fields["patient_key"])), "patient_missing")
        .when(blank(F.col(ts)), "time_missing")
        .when(time(df, ts).isNull(), "time_unreadable")
    )


def error_counts(df: DataFrame, source: Source) -> DataFrame:
    ok = reason(df, source).isNull()
    return df.agg(F.lit(source.name).alias("source"), F.count("*").alias("records_in"), F.count_if(ok).alias("records_out"), F.count_if(~ok).alias("errors"))


def diagnoses(raw: Column) -> Column:
    """JSON array of strings or objects, or a list parted by , ; or |; null if empty."""
    text = F.trim(raw.cast("string"))
    code = lambda x, n: rules.named(code=F.trim(x), type=F.lit("ICD-10-CM"), sequence=n.cast("int"), poa=F.lit(None).cast("string"))
    objects = F.from_json(text, "array<struct<code:string,type:string,sequence:int,poa:string>>")
    objects = F.when(F.exists(objects, lambda x: x["code"].isNotNull()), objects)
    words = F.filter(F.transform(F.from_json(text, "array<string>"), lambda x, i: code(x, i + 1)), lambda x: x["code"] != "")
    parts = F.transform(F.filter(F.split(text, "[,;|]"), lambda x: F.trim(x) != ""), lambda x, i: code(x, i + 1))
    found = F.when(text.startswith("["), F.coalesce(F.when(F.regexp_like(text, F.lit(r"^\[\s*\{")), objects), words, parts)).otherwise(parts)
    return F.when(F.size(found) > 0, found.cast(DX))


def event_id(system: Column, record: Column, event_type: Column) -> Column:
    return F.sha2(F.concat_ws("|", system, record, event_type), 256)


def canonicalize(df: DataFrame, source: Source, batch_id: str = "batch") -> DataFrame:
    """Canonical events of the valid rows of one source."""
    return accounted(df, source, batch_id).where("reject_reason IS NULL").drop("reject_reason", "raw")


def accounted(df: DataFrame, source: Source, batch_id: str = "batch") -> DataFrame:
    """Canonical events, and a line for each rejected row with ``reject_reason`` and ``raw``
    (the row as JSON), so that one pass over the source serves both."""
    bad = F.col("reject_reason").isNotNull()
    rows = df.withColumn("reject_reason", reason(df, source)).withColumn("raw", F.when(bad, F.to_json(F.struct(*df.columns))))
    get = lambda name: F.col(source.fields[name]).cast("string") if name in source.fields else F.lit(None).cast("string")
    base = {name: get(name) for name in OPTIONAL} | {"patient_key": get("patient_key"), "source_record_id": get("source_record_id")}
    base["facility_raw"] = F.coalesce(base["facility_raw"], F.lit(""))
    base |= {"source_system": F.lit(source.name), "source_type": F.lit(source.kind), "ingested_at": time(df, source.incremental_key), "batch_id": F.lit(batch_id), "reject_reason": F.col("reject_reason"), "raw": F.col("raw")}
    none, no_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    if source.kind == "claims":
        # a claim is an admission and, where it has a date, a discharge
        base |= {"npi": none, "ccn": none, "diagnosis_codes": diagnoses(get("diagnosis_codes")) if "diagnosis_codes" in source.fields else F.lit(None).cast(DX)}
        base["raw_class"] = rules.first_match([(rules.class_rule(w), c) for w, c in source.class_rules], base["patient_class"])
        half = lambda ts, kind, side: F.struct(time(df, ts).alias("event_ts"), F.lit(kind).alias("event_type"), F.lit(side).alias("side"), (F.lit(True) if side == 0 else no_flag).alias("admit_flag"), (F.lit(True) if side == 1 else no_flag).alias("discharge_flag"))
        halves = F.explode(F.array(half(*source.admit, 0), half(*source.discharge, 1)))
        out = rows.select(*(c.alias(k) for k, c in base.items()), halves.alias("half")).select("*", "half.*").drop("half").where("CASE WHEN reject_reason IS NULL THEN event_ts IS NOT NULL ELSE side = 0 END")
        out = out.withColumns({"event_id": event_id(F.col("source_system"), F.col("source_record_id"), F.col("event_type")), "auth_flag": no_flag, "auth_status": none})
    else:
        base |= {"admitting_diagnosis": none, "principal_diagnosis": base["principal_diagnosis"], "diagnosis_codes": F.lit(None).cast(DX)}
        code = F.trim(F.col(source.type_field).cast("string"))
        resolved = F.when(code.isNull(), "UNKNOWN").otherwise(rules.first_match([(rules.equalities(w), t) for w, t in source.type_rules], rules.mapped(code, source.type_map, F.lit("UNKNOWN"))))
        base |= {"event_ts": time(df, source.fields["event_ts"]), "event_type": resolved, "side": F.lit(0), "raw_class": base["patient_class"], "has_code": code.isNotNull()}
        status = rules.mapped(F.trim(F.col(source.status_field).cast("string")), source.status_map) if source.status_field else none
        out = rows.select(*(c.alias(k) for k, c in base.items()), status.alias("auth_status"))
        flags = {"admit_flag": source.admit_flag, "discharge_flag": source.discharge_flag}
        out = out.withColumns({k: F.when(F.col("has_code"), rules.type_in(v, F.col("event_type"))) for k, v in flags.items()})
        # the id names the type before an authorization's status changes it
        out = out.withColumn("event_id", event_id(F.col("source_system"), F.col("source_record_id"), F.col("event_type"))).drop("has_code")
        if source.kind == "auth":
            changed = rules.mapped(F.col("auth_status"), {"approved": "AUTH_APPROVED", "denied": "AUTH_DENIED", "pending": "AUTH_REQUESTED"}, F.col("event_type"))
            out = out.withColumns({"event_type": changed, "auth_flag": F.lit(True)})
        else:
            out = out.withColumn("auth_flag", no_flag)
    out = out.withColumn("patient_class", rules.normal_class(F.col("raw_class"), F.col("event_type"))).drop("raw_class")
    return out.withColumn("facility_match_type", F.when(~blank(F.col("facility_id")), "customer_provided"))
