"""Queries of the reconciliation operators on tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careweave.config import Settings
from careweave.operators import dedup, encounters, episodes, facility, reconcile, score, stitch
from careweave.plans import reconciliation
from careweave.sources import feeds, registry, scan
from careweave.sources.shared import written

EVENT = ("source_system", "source_record_id", "side")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = reconciliation.canonical_events(reconciliation.default_feeds(spark, sf_dir))
    return written(facility.resolve(written(events, "events"), feeds.facilities(spark)), "canonical-events")


def _stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(dedup.mark_duplicates(stitch.stitch(_resolved(spark, sf_dir))), "stitched-events")


def _reconciled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = _stitched(spark, sf_dir)
    return events, written(reconcile.reconcile(events, stitch.encounters(events), feeds.AS_OF), "reconciled")


def _joined(c: str) -> Column:
    return F.concat_ws(",", c).alias(c)


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = reconciliation.canonical_events(reconciliation.default_feeds(spark, sf_dir))
    return events.select(*EVENT, "event_id", "patient_key", _time("event_ts"), "event_type", "patient_class", "admit_flag", "discharge_flag", "auth_status", "payer_id", "drg", "principal_diagnosis", F.concat_ws(",", F.transform("diagnosis_codes", lambda x: F.concat_ws(":", x["code"], x["sequence"].cast("string")))).alias("dx"))


def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, errors = reconciliation.canonical_events(reconciliation.default_feeds(spark, sf_dir))
    return errors


def facility_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select(*EVENT, "facility_id", "facility_match_type")


def new_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facility.new_facilities(_resolved(spark, sf_dir)).select("facility_id", "canonical_name", "n_events")


def stitch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stitched(spark, sf_dir).select(*EVENT, "encounter_no", "encounter_id")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stitched(spark, sf_dir).select(*EVENT, F.coalesce("role", F.lit("kept")).alias("role"))


def encounter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = stitch.encounters(_stitched(spark, sf_dir))
    return stays.select("encounter_id", "patient_key", "encounter_type", "status", "has_discharge", _time("admit_ts"), _time("discharge_ts"), F.round("los_hours", 6).alias("los_hours"), "n_events", _joined("source_systems"), "has_adt", "has_claims", "has_auth", "obs_to_ip")


def transfer_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = stitch.transfers(stitch.encounters(_stitched(spark, sf_dir))).where("transfer_chain IS NOT NULL")
    return chains.select("encounter_id", F.size("transfer_chain").alias("chain_length"), F.col("transfer_chain")[0].alias("chain_start"))


def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.counts(dedup.merge_overlaps(_stitched(spark, sf_dir)))


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _reconciled(spark, sf_dir)
    return rows.select("encounter_id", _time("reconciled_admit_ts"), "admit_source", _time("reconciled_discharge_ts"), "discharge_source", "reconciled_type", "drg", "payer_id", "principal_diagnosis", F.concat_ws(",", "diagnosis_codes.code").alias("dx"), _joined("flags"))


def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.flag_counts(_reconciled(spark, sf_dir)[1])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = facility.facility_types(feeds.facilities(spark))
    return score.score(score.stale(_reconciled(spark, sf_dir)[1], types, feeds.AS_OF))


def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("encounter_id", F.round("confidence", 6).alias("confidence"), _joined("confidence_flags"), "band")


def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.bands(_scored(spark, sf_dir)).select("band", "n", F.round("avg_confidence", 6).alias("avg_confidence"))


def event_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounters.roles(*_reconciled(spark, sf_dir)).select(*EVENT, "role_in_encounter")


def readmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounters.readmissions(feeds.stays(spark, sf_dir)).select("encounter_id", "is_readmission", "readmission_days", "prior_encounter_id")


def episode_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.link(feeds.stays(spark, sf_dir)).select("encounter_id", "link", "episode_no", "episode_id")


def episode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episodes.episodes(episodes.link(feeds.stays(spark, sf_dir)), feeds.AS_OF)
    return rows.select("episode_id", "patient_key", _time("episode_start_ts"), _time("episode_end_ts"), F.round("total_los_days", 6).alias("total_los_days"), _joined("encounter_ids"), "encounter_count", _joined("facility_sequence"), "facility_count", "includes_readmission", "includes_post_acute", "is_acute", "episode_status", "principal_diagnosis", "episode_type", F.round("confidence_score", 6).alias("confidence_score"), F.concat_ws(",", "diagnosis_codes.code").alias("dx"))


def episode_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episodes.episode_quality(episodes.episodes(episodes.link(feeds.stays(spark, sf_dir)), feeds.AS_OF))
    return rows.select("episodes", F.round("readmission_rate", 6).alias("readmission_rate"), F.round("avg_confidence", 6).alias("avg_confidence"))


def facility_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.load_registry(feeds.supplier_registry(spark, sf_dir)).select("canonical_id", "canonical_name", "npi", "ccn", "facility_type", _joined("aliases"), "address")


def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions since a watermark less the look-back, without excluded messages."""
    rows = scan.scan(feeds.adt(spark, sf_dir), feeds.ADT, "2024-01-20 00:00:00", dict(Settings().lookback), "incremental")
    return rows.select("message_control_id", _time("message_ts"), "hl7_event")


def upserted_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of two batches: all, then those of even patients closed by hand."""
    old = feeds.stays(spark, sf_dir).select("encounter_id", "patient_key", "status", F.lit("first").alias("created_at"))
    new = old.where("int(substring(patient_key, 2)) % 2 = 0").withColumns({"status": F.lit("closed"), "created_at": F.lit("second")})
    return scan.upsert(old, new, "encounter_id", keep="created_at")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f.__name__: f for f in (canonical_events, record_errors, facility_resolution, new_facilities, stitch_sessions, near_duplicates, encounter_metadata, transfer_chains, overlap_merge, reconciled, flag_counts, confidence_scores, confidence_bands, event_roles, readmissions, episode_links, episode_rows, episode_quality, facility_registry, incremental_scan, upserted_stays)},
}
