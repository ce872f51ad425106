"""Encounter rows, event roles, detail and audit rows, readmissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careweave.config import Settings
from careweave.operators.stitch import content_id, is_admit, is_discharge, order

DAY = 86_400_000_000


def readmissions(stays: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``is_readmission``, ``readmission_days``, ``prior_encounter_id``.

    ``stays``: patient_key, encounter_id, admit_ts, discharge_ts, facility_type. The
    nearest earlier acute, discharged stay counts whose gap is at most so many whole days. Of
    stays that are admitted together the id by content decides (``content_id``, if there is one)."""
    rows = stays.withColumn("_nth", F.struct("admit_ts", content_id(stays).alias("content")))
    prior = rows.where("facility_type = 'acute' AND discharge_ts IS NOT NULL").select("patient_key", "admit_ts", F.col("_nth").alias("_before"), F.col("discharge_ts").alias("_left"), F.col("encounter_id").alias("_prior"))
    # in time slices of the window's length, so that a patient of many years isn't one group
    reach = (settings.readmission_days + 1) * DAY
    latest = rows.agg(F.max(F.unix_micros("admit_ts"))).first()[0] or 0
    first, last = F.floor(F.unix_micros("admit_ts") / reach), F.floor(F.least(F.unix_micros("_left") + reach - 1, F.lit(latest)) / reach)
    prior = prior.where(last >= first).withColumn("_slice", F.explode(F.sequence(first, last)))
    near = (F.col("_before") < F.col("_nth")) & (F.unix_micros("_left") > F.unix_micros("admit_ts") - reach)
    asked = rows.where("facility_type = 'acute'").select("patient_key", "encounter_id", "_nth", "admit_ts", first.alias("_slice"))
    pairs = asked.join(prior.drop("admit_ts"), ["patient_key", "_slice"]).where(near)
    last = pairs.groupBy("encounter_id").agg(F.max_by(F.struct("_left", "_prior"), "_before").alias("_hit"))
    days = F.floor((F.unix_micros("admit_ts") - F.unix_micros("_hit._left")) / DAY).cast("int")
    return rows.drop("_nth").join(last, "encounter_id", "left").withColumns({"is_readmission": F.col("_hit").isNotNull(), "readmission_days": days, "prior_encounter_id": F.col("_hit._prior")}).drop("_hit")


def roles(events: DataFrame, reconciled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``role_in_encounter``: the first matching events are anchors, duplicates stay
    what they are, the others support."""
    times = reconciled.select("encounter_id", "reconciled_admit_ts", "reconciled_discharge_ts")
    rows = events.join(times, "encounter_id")
    alive = F.col("role").isNull()
    admit = alive & is_admit() & (F.col("event_ts") == F.col("reconciled_admit_ts"))
    leave = alive & is_discharge() & F.coalesce(F.col("event_ts") == F.col("reconciled_discharge_ts"), F.lit(False))
    kind = F.when(admit, "admit_anchor").when(leave, "discharge_anchor")
    # events that can't be anchors are spread, not gathered by encounter
    spread = F.when(F.col("_kind").isNull(), F.xxhash64("event_id"))
    nth = F.row_number().over(Window.partitionBy("encounter_id", "_kind", spread).orderBy(*order(settings)))
    rows = rows.withColumn("_kind", kind).withColumn("_nth", nth)
    role = F.coalesce("role", F.when(F.col("_kind").isNotNull() & (F.col("_nth") == 1), F.col("_kind")), F.lit("supporting"))
    return rows.withColumn("role_in_encounter", role).drop("_kind", "_nth", "reconciled_admit_ts", "reconciled_discharge_ts")


def encounter_rows(scored: DataFrame, as_of, run_id: str, settings: Settings = Settings(), earlier: DataFrame | None = None) -> DataFrame:
    """The published encounter table. The first stay of a patient is no readmission; ``earlier``
    are published stays that later ones may be readmissions of."""
    scored = scored.withColumn("content_id", content_id(scored))
    stays = scored.select("patient_key", "encounter_id", "content_id", "facility_type", F.col("reconciled_admit_ts").alias("admit_ts"), F.col("reconciled_discharge_ts").alias("discharge_ts"))
    if earlier is not None:
        stays = stays.unionByName(earlier.withColumn("content_id", content_id(earlier)).select(*stays.columns))
    scored = scored.join(readmissions(stays, settings).select("encounter_id", "is_readmission", "readmission_days"), "encounter_id")
    los = (F.unix_micros("reconciled_discharge_ts") - F.unix_micros("reconciled_admit_ts")) / 3_600_000_000
    facility = F.coalesce("facility_id", F.lit(""))
    return scored.select(
        "encounter_id", "patient_key", facility.alias("facility_id"), F.coalesce("facility_name", "facility_id", F.lit("")).alias("facility_name"),
        F.col("reconciled_admit_ts").alias("admit_ts"), F.col("reconciled_discharge_ts").alias("discharge_ts"), los.alias("los_hours"),
        F.col("reconciled_type").alias("encounter_type"), "status", (F.col("encounter_type") == "inpatient").alias("is_acute"),
        "drg", "payer_id", "principal_diagnosis", "admitting_diagnosis", "diagnosis_codes", "has_adt", "has_claims", "has_auth", "source_systems", "source_event_ids",
        "admit_source", "discharge_source", "obs_to_ip", "transfer_chain", "facility_type", F.col("confidence").alias("confidence_score"), "confidence_flags",
        "is_readmission", "readmission_days", "has_discharge", "first_event_ts", "last_event_ts", "content_id",
        F.lit(None).cast("string").alias("episode_id"), F.lit(run_id).alias("run_id"), F.lit(as_of).cast("timestamp").alias("created_at"), F.lit(as_of).cast("timestamp").alias("updated_at"),
    )


def detail_rows(events: DataFrame) -> DataFrame:
    return events.select("encounter_id", "event_id", "event_type", "event_ts", "source_system", "role_in_encounter")


def audit_rows(new: DataFrame, old_ids: DataFrame, key: str, kind: str, run_id: str, as_of) -> DataFrame:
    """A line for each created or updated entity."""
    known = old_ids.select(key).distinct().withColumn("_known", F.lit(True))
    action = F.when(F.col("_known"), "updated").otherwise("created")
    rows = new.select(key).join(known, key, "left").select(F.col(key).alias("entity_id"), action.alias("action"))
    return rows.select(F.sha2(F.concat_ws("|", F.lit(run_id), F.lit(kind), "entity_id", "action"), 256).alias("audit_id"), F.lit(run_id).alias("run_id"), F.lit(kind).alias("entity_type"), "entity_id", "action", F.lit(as_of).cast("timestamp").alias("created_at"))


def facility_audit_rows(resolved: DataFrame, run_id: str, as_of) -> DataFrame:
    hits = resolved.where("facility_match_type IN ('new', 'fuzzy')").select("facility_id", "facility_raw", "facility_match_type").distinct()
    return hits.select(F.sha2(F.concat_ws("|", F.lit(run_id), "facility_id", "facility_raw", "facility_match_type"), 256).alias("audit_id"), F.lit(run_id).alias("run_id"), F.lit("facility").alias("entity_type"), F.col("facility_id").alias("entity_id"), F.col("facility_match_type").alias("action"), F.lit(as_of).cast("timestamp").alias("created_at"))
