"""Near-duplicate events, and encounters that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careweave.config import Settings
from careweave.functions import rules
from careweave.operators.slices import Slices
from careweave.operators.stitch import content_id, is_discharge, is_marker, order, position
from careweave.sources.shared import written


def priority(table: tuple[tuple[str, int], ...]) -> Column:
    return F.coalesce(rules.mapped(F.col("source_type"), {k: str(v) for k, v in table}).cast("int"), F.lit(0))


def mark_duplicates(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``role``: ``duplicate`` for all but the best event of each cluster.

    Clusters are chains of events of an encounter that follow each other within the
    tolerance and are equal in the match fields; nulls of a field are equal."""
    keys = ["encounter_id", *settings.match_fields]
    slices, by = Slices.of(events, keys, "event_ts", settings.slice_rows), order(settings)
    rows = slices.running(slices.cut(events, "event_ts"), by, _before=("last", F.col("event_ts")))
    far = F.unix_micros("event_ts") - F.unix_micros("_before") > settings.tolerance_minutes * 60_000_000
    rows = slices.running(rows, by, _cluster=("sum", F.coalesce(far, F.lit(True)).cast("int")))
    merit = F.struct((-priority(settings.timestamp_priority)).alias("p"), F.col("ingested_at").isNull().alias("late"), F.col("ingested_at").alias("came"), position(settings).alias("at"))
    rows = slices.least(rows.withColumn("_merit", merit), [*keys, "_cluster"], _best=F.col("_merit"))
    # of equals one stays
    parts = [] if slices.cells is None else ["_slice"]
    nth = F.row_number().over(Window.partitionBy(*keys, "_cluster", *parts).orderBy("_merit"))
    rows = rows.withColumn("role", F.when((nth > 1) | (F.col("_merit") > F.col("_best")), "duplicate"))
    return slices.done(rows).drop("_before", "_cluster", "_merit", "_best")


def merge_overlaps(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``merged_id``: overlapping stays of a patient at a facility get the first's id (and
    its ``content_id``, where there is one).

    Stays are taken by their start. A group goes on while its latest marker isn't a discharge,
    or the next stay starts no later than the group's last discharge. A group that can end has
    a discharge, which is after all those of earlier groups, so the greatest discharge and the
    latest marker of all stays before are the group's own, unless that marker's stay was
    before the group; then the group has none. So a stay may begin a group if the latest
    marker before it is a discharge and all discharges before it are earlier, and it does so
    if no stay may have since the one of that marker."""
    at = position(settings)
    named = [c for c in events.columns if c == "content_id"]
    stays = events.groupBy("patient_key", "encounter_id").agg(
        *(F.max(c).alias(c) for c in named),
        F.min_by("facility_id", at).alias("facility"),
        F.min("event_ts").alias("start"),
        F.max(F.when(is_discharge(), F.col("event_ts"))).alias("discharge"),
        F.max(F.when(is_marker(), at)).alias("_mark"),
        F.max_by(is_discharge(), F.when(is_marker(), at)).alias("_closed"),
    )
    stays = written(stays.select("patient_key", "encounter_id", *named, "facility", "start", "discharge", F.col("_mark.event_ts").alias("marked"), F.coalesce("_closed", F.lit(False)).alias("closed")), "stays-to-merge")
    slices, by = Slices.of(stays, ["patient_key", "facility"], "start", settings.slice_rows), [F.col("start"), content_id(stays)]
    here = F.struct("start", content_id(stays).alias("content"))
    mark = F.when(F.col("marked").isNotNull(), F.struct("marked", here.alias("at"), "closed"))
    rows = slices.running(slices.cut(stays, "start"), by, _out=("max", F.col("discharge")), _mark=("max", mark), _first=("sum", F.lit(1)))
    may = F.col("_mark.closed") & (F.col("start") > F.col("_out"))
    rows = rows.withColumn("_may", F.coalesce(may, F.lit(False)))
    rows = slices.running(rows, by, _last=("last", F.when(F.col("_may"), here)))
    begins = (F.col("_first") == 1) | (F.col("_may") & F.coalesce(F.col("_last") <= F.col("_mark.at"), F.lit(True)))
    rows = slices.running(rows.withColumn("_begins", begins), by, _merged=("latest", F.when(F.col("_begins"), F.struct("encounter_id", *named))))
    merged = rows.select("patient_key", "encounter_id", F.col("_merged.encounter_id").alias("merged_id"), *(f"_merged.{c}" for c in named))
    return events.drop(*named).join(merged, ["patient_key", "encounter_id"])


def counts(events: DataFrame) -> DataFrame:
    """Events, duplicates and encounters merged away, of events with role and merged_id."""
    return events.agg(F.count("*").alias("events_before"), F.count_if(F.col("role").isNull()).alias("events_after"), F.count_if(F.col("role") == "duplicate").alias("duplicates"), (F.count_distinct("encounter_id") - F.count_distinct("merged_id")).alias("encounters_merged"))
