"""The whole way from raw feeds to encounters and episodes, as lazy DataFrames."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from careweave.config import Settings, Source
from careweave.operators import canonical, dedup, encounters, episodes, facility, quality, reconcile, score, stitch
from careweave.sources import feeds, scan
from careweave.sources.shared import dropped, written


EPOCH = datetime(1970, 1, 1)


@dataclass
class Tables:
    canonical: DataFrame
    resolved: DataFrame
    stitched: DataFrame
    stays: DataFrame
    events: DataFrame
    reconciled: DataFrame
    scored: DataFrame
    encounters: DataFrame
    detail: DataFrame
    errors: DataFrame


def default_feeds(spark: SparkSession, sf_dir: str) -> list[tuple[Source, DataFrame]]:
    return [(feeds.ADT, feeds.adt(spark, sf_dir)), (feeds.ADT_Y, feeds.adt_y(spark, sf_dir)), (feeds.CLAIMS, feeds.claims(spark, sf_dir)), (feeds.AUTH, feeds.auth(spark, sf_dir))]


def canonical_events(sources: list[tuple[Source, DataFrame]], batch_id: str = "batch", watermarks: dict | None = None, lookback: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical events of all sources, and counts of rows that were errors."""
    mode = "incremental" if watermarks else "full"
    rows = [(s, scan.scan(df, s, (watermarks or {}).get(s.name), lookback, mode)) for s, df in sources]
    return scan.union_all([canonical.canonicalize(df, s, batch_id) for s, df in rows]), scan.union_all([canonical.error_counts(df, s) for s, df in rows])


def build(sources: list[tuple[Source, DataFrame]], facilities: DataFrame, as_of: str, registry: DataFrame | None = None, settings: Settings = Settings(), run_id: str = "run", history: DataFrame | None = None, watermarks: dict | None = None, prior: DataFrame | None = None) -> Tables:
    """Encounters of all sources. ``history``: earlier canonical events, resolved; ``prior``:
    stays of earlier runs, whose ids are used again where a stay continues one."""
    taken = ingested(sources, run_id, watermarks, dict(settings.lookback))
    resolved = facility.resolve(taken.events, facilities, registry, settings.fuzzy_threshold)
    if history is not None:
        resolved = scan.recent_history(history, resolved, as_of, settings.history_days)
    # the canonical events are a table of their own (the next batch's history), and what
    # follows is planned from it
    return encountered(written(resolved, "canonical-events"), taken, facilities, as_of, settings, run_id, prior)


@dataclass
class Ingested:
    """Canonical events of a batch, its rejected rows, and what was counted on the way."""

    events: DataFrame
    rejected: DataFrame
    accounts: DataFrame
    #: errors among all rows, and the greatest incremental key of each source
    error_rate: float
    seen: dict[str, datetime]
    #: what events and rejected rows are read from
    table: DataFrame


def ingested(sources: list[tuple[Source, DataFrame]], run_id: str = "batch", watermarks: dict | None = None, lookback: dict[str, str] | None = None) -> Ingested:
    """One pass over each source: events and rejected rows go to one table, and rows, errors
    and the greatest key are observed as they pass."""
    parts, told = [], {}
    for source, df in sources:
        mark = (watermarks or {}).get(source.name)
        rows = scan.scan(df, source, None if mark is None else str(mark), lookback, "full" if mark is None else "incremental")
        bad = canonical.reason(rows, source).isNotNull()
        told[source.name] = Observation(f"{run_id}-{source.name}-{uuid.uuid4().hex}")
        key = canonical.time(rows, source.incremental_key)
        rows = rows.observe(told[source.name], F.count(F.lit(1)).alias("records_in"), F.count_if(bad).alias("errors"), F.max(F.unix_micros(key)).alias("last"))
        parts.append(canonical.accounted(rows, source, run_id))
    table = written(scan.union_all(parts), "ingested")
    lines, seen = [], {}
    for name, observation in told.items():
        got = observation.get
        n, errors = got["records_in"], got["errors"]
        lines.append((name, n, n - errors, errors))
        if got["last"] is not None:
            seen[name] = EPOCH + timedelta(microseconds=got["last"])
    accounts = table.sparkSession.createDataFrame(lines, "source string, records_in long, records_out long, errors long")
    total = sum(n for _, n, _, _ in lines)
    rejected = table.where("reject_reason IS NOT NULL").select(F.col("source_system").alias("source"), "source_record_id", "patient_key", "reject_reason", "raw", "batch_id")
    events = table.where("reject_reason IS NULL").drop("reject_reason", "raw")
    return Ingested(events, rejected, accounts, sum(e for *_, e in lines) / total if total else 0.0, seen, table)


def encountered(resolved: DataFrame, taken: Ingested, facilities: DataFrame, as_of: str, settings: Settings = Settings(), run_id: str = "run", prior: DataFrame | None = None, earlier: DataFrame | None = None, lean: bool = False) -> Tables:
    """Encounters of resolved events. ``earlier``: published stays that these don't touch.
    ``lean``: encounters and detail are written, and all tables before them go on the way."""
    past = dropped if lean else lambda *tables: None
    stitched = stitch.stitch(resolved, settings)
    if prior is not None:
        plain = written(stitched, "stitched")
        past(resolved)
        stitched = written(with_stable_ids(plain, prior, as_of, settings), "stitched-events")
        dropped(plain)
    else:
        stitched = written(stitched, "stitched-events")
        past(resolved)
    table = written(dedup.merge_overlaps(dedup.mark_duplicates(stitched, settings), settings), "merged-events")
    past(stitched)
    merged = table.drop("encounter_id").withColumnRenamed("merged_id", "encounter_id")
    plain = written(stitch.encounters(merged, settings), "stays")
    stays = written(stitch.transfers(plain, settings), "chained-stays")
    dropped(plain)
    reconciled = reconcile.reconcile(merged, stays, as_of, settings)
    scored = written(score.score(score.stale(reconciled, facility.facility_types(facilities), as_of, settings)), "scored")
    past(stays)
    rows = encounters.encounter_rows(scored, as_of, run_id, settings, earlier)
    detail = encounters.detail_rows(encounters.roles(merged, scored, settings))
    if lean:
        detail = written(detail, "detail")
        past(table)
        rows = written(rows, "encounters")
        past(scored)
    return Tables(taken.events, resolved, stitched, stays, merged, reconciled, scored, rows, detail, taken.accounts)


def with_stable_ids(events: DataFrame, prior: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:
    """Events of encounters under the ids of the earlier stays that these continue, with the id
    by content in ``content_id`` where that is another."""
    ids = stitch.stable_ids(stitch.encounters(events, settings), prior, as_of, settings)
    own = F.when(F.col("encounter_id") != F.col("stable_id"), F.col("encounter_id"))
    return events.join(ids, "encounter_id").withColumn("content_id", own).drop("encounter_id").withColumnRenamed("stable_id", "encounter_id")


def materialize(tables: Tables, stored: DataFrame | None, stored_detail: DataFrame | None, run_id: str, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(encounters, detail, audit lines) after a run: stored encounters are replaced by id
    and keep their creation time, details are replaced encounter by encounter."""
    fresh = tables.encounters
    if stored is None:
        stored, stored_detail = fresh.limit(0), tables.detail.limit(0)
    audit = encounters.audit_rows(fresh, stored, "encounter_id", "encounter", run_id, as_of)
    return scan.upsert(stored, fresh, "encounter_id", keep="created_at"), scan.replace_children(stored_detail, tables.detail, "encounter_id"), audit


def run_feeds(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> Tables:
    return build(default_feeds(spark, sf_dir), feeds.facilities(spark), feeds.AS_OF, settings=settings)


def with_episodes(tables: Tables, as_of: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(episodes, encounters with their episode) of built tables."""
    return episodes.recompute(tables.encounters, as_of, settings)


def judged(tables: Tables) -> DataFrame:
    """The run's metrics with thresholds and status."""
    ingested = tables.canonical.agg(F.count("*").alias("n"))
    return quality.statuses(quality.metrics(tables.scored, tables.errors, ingested))


def quality_rows(tables: Tables, run_id: str, as_of: str) -> DataFrame:
    return quality.metric_rows(judged(tables), run_id, as_of)
