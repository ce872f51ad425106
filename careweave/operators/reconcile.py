"""One truth per encounter from several sources, and what speaks against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweave.config import Settings
from careweave.functions import rules
from careweave.operators.dedup import priority
from careweave.operators.stitch import is_admit, is_discharge, position

FLAGS = ("AUTH_WITHOUT_ADMIT", "TIMESTAMP_MISMATCH", "MISSING_DISCHARGE", "ORPHAN_DISCHARGE", "CLAIMS_ONLY_ENCOUNTER", "ADT_ONLY_ENCOUNTER", "FACILITY_UNRESOLVED")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3_600_000_000


def reconcile(events: DataFrame, stays: DataFrame, as_of, settings: Settings = Settings(), key: str = "encounter_id") -> DataFrame:
    """Stays with reconciled times, classification, diagnoses and ``flags``.

    Duplicates still count here. ``stays`` has a row for each ``encounter_id``."""
    place = position(settings)
    by_time = priority(settings.timestamp_priority)
    by_class = F.coalesce(rules.mapped(F.col("source_type"), {k: str(v) for k, v in settings.class_priority}).cast("int"), F.lit(0))
    rows = events.withColumns({"_place": place, "_time": F.struct((-by_time).alias("p"), "event_ts", "source_type"), "_class": F.struct((-by_class).alias("p"), place.alias("place"))})
    adt, claims, auth = (F.col("source_type") == k for k in ("adt", "claims", "auth"))
    first = lambda column: F.min_by(column, F.when(F.col(column).isNotNull(), F.col("_class")))
    least = lambda condition: F.min(F.when(condition, F.col("event_ts")))
    facts = rows.groupBy(key).agg(
        F.min(F.when(is_admit(), F.col("_time"))).alias("_admit"),
        F.min(F.struct("event_ts", "_place", "source_type")).alias("_first"),
        F.min(F.when(is_discharge(), F.col("_time"))).alias("_discharge"),
        *(first(c).alias(f"r_{c}") for c in ("patient_class", "drg", "payer_id", "principal_diagnosis")),
        F.min_by("principal_diagnosis", F.when(adt & F.col("principal_diagnosis").isNotNull(), F.col("_place"))).alias("admitting_diagnosis"),
        *(F.max(c).alias(n) for c, n in ((adt, "r_adt"), (claims, "r_claims"), (auth, "r_auth"), (is_admit(), "any_admit"), (is_discharge(), "any_discharge"))),
        least(is_admit() & adt).alias("_adt_admit"), least(is_admit() & claims).alias("_claims_admit"),
        least(is_discharge() & adt).alias("_adt_discharge"), least(is_discharge() & claims).alias("_claims_discharge"),
        least(is_admit()).alias("_least_admit"), F.min("event_ts").alias("_least"),
        F.max(adt & is_admit()).alias("adt_admit"), F.max(adt & is_discharge()).alias("adt_discharge"),
        F.size(F.collect_set("patient_class")).alias("n_classes"),
        F.max(F.col("role").eqNullSafe("duplicate") if "role" in events.columns else F.lit(False)).alias("_duplicates"),
        F.max(F.col("facility_match_type").eqNullSafe("new")).alias("_new_facility"),
        F.array_sort(F.collect_list(F.when(F.col("diagnosis_codes").isNotNull(), F.struct("_class", "diagnosis_codes")))).alias("_dx"),
    )
    far = lambda a, b: F.coalesce(F.abs(hours_between(F.col(a), F.col(b))) > settings.mismatch_hours, F.lit(False))
    now = F.lit(as_of).cast("timestamp")
    joined = stays.join(facts, key)
    has = F.col("has_discharge")
    conditions = {
        "AUTH_WITHOUT_ADMIT": F.col("r_auth") & ~F.col("r_adt") & ~F.col("r_claims"),
        "TIMESTAMP_MISMATCH": far("_adt_admit", "_claims_admit") | far("_adt_discharge", "_claims_discharge"),
        "MISSING_DISCHARGE": ~has & F.coalesce(hours_between(now, F.col("_least_admit")) > settings.open_hours, F.lit(False)),
        "ORPHAN_DISCHARGE": F.col("any_discharge") & ~F.col("any_admit"),
        "CLAIMS_ONLY_ENCOUNTER": F.col("r_claims") & ~F.col("r_adt"),
        "ADT_ONLY_ENCOUNTER": F.col("r_adt") & ~F.col("r_claims") & (hours_between(now, F.col("_least")) > 24 * settings.claims_lag_days),
        "FACILITY_UNRESOLVED": F.col("facility_id").isNull() | F.col("_new_facility"),
    }
    if settings.flag_duplicates:
        conditions = {"DUPLICATE_DETECTED": F.col("_duplicates"), **conditions}
    flags = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())))
    codes = F.flatten(F.transform("_dx", lambda x: x["diagnosis_codes"]))
    kept = F.filter(codes, lambda x, i: ~F.exists(F.slice(codes, F.lit(1), i), lambda y: y["code"] == x["code"]))
    kind = F.coalesce("r_patient_class", F.lit("outpatient"))
    return joined.withColumns({
        "reconciled_admit_ts": F.coalesce("_admit.event_ts", "_first.event_ts"),
        "admit_source": F.coalesce("_admit.source_type", "_first.source_type"),
        "reconciled_discharge_ts": F.col("_discharge.event_ts"),
        "discharge_source": F.col("_discharge.source_type"),
        "reconciled_type": F.when(kind == "ed", "ed_only").otherwise(kind),
        "drg": F.col("r_drg"), "payer_id": F.col("r_payer_id"), "principal_diagnosis": F.col("r_principal_diagnosis"),
        "diagnosis_codes": F.when(F.size(kept) > 0, kept),
        "open_since": F.col("_least_admit"),
        "flags": flags,
    }).select(*stays.columns, "reconciled_admit_ts", "admit_source", "reconciled_discharge_ts", "discharge_source", "reconciled_type", "drg", "payer_id", "principal_diagnosis", "admitting_diagnosis", "diagnosis_codes", "open_since", "r_adt", "r_claims", "r_auth", "adt_admit", "adt_discharge", "n_classes", "flags")


def flag_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
