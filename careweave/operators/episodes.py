"""Encounters to episodes of care."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweave.config import Settings
from careweave.functions import rules
from careweave.operators import groupers
from careweave.operators.slices import Slices
from careweave.operators.stitch import content_id

DAY = 86_400_000_000


def link_kind(prior: Column, settings: Settings) -> Column:
    """First rule that links the current row to its patient's last discharged stay."""
    gap = F.unix_micros("admit_ts") - F.unix_micros(prior["discharge_ts"])
    within = lambda days: gap <= days * DAY
    both = prior["is_acute"] & F.col("is_acute")
    kinds = [
        (both & within(settings.readmission_days), "readmission"),
        (prior["is_acute"] & ~F.col("is_acute") & within(settings.post_acute_days), "post_acute"),
        ((F.col("encounter_type") == "ed_only") & within(settings.ed_return_days), "ed_bounceback"),
        ((prior["facility_id"] == F.col("facility_id")) & within(settings.planned_return_days) & ~(both & within(settings.readmission_days)), "planned_return"),
    ]
    return rules.first_match([(F.coalesce(c, F.lit(False)), name) for c, name in kinds])


def link(stays: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``link`` (the rule, or null), ``episode_no`` and ``episode_id``.

    An episode can only go on while every stay since the last discharge links to it."""
    slices, by = Slices.of(stays, ["patient_key"], "admit_ts", settings.slice_rows), [F.col("admit_ts"), content_id(stays)]
    here = F.struct("admit_ts", content_id(stays).alias("content"))
    left = F.when(F.col("discharge_ts").isNotNull(), F.struct(here.alias("at"), "discharge_ts", "is_acute", "facility_id"))
    rows = slices.running(slices.cut(stays, "admit_ts"), by, _prior=("last", left))
    rows = rows.withColumn("_kind", link_kind(F.col("_prior"), settings))
    # no stay after the last discharged one fails to link to it
    rows = slices.running(rows, by, _failed=("latest", F.when(F.col("_kind").isNull(), here)))
    rows = rows.withColumn("_linked", F.col("_kind").isNotNull() & F.coalesce(F.col("_failed") <= F.col("_prior.at"), F.lit(True)))
    rows = slices.running(rows, by, episode_no=("sum", (~F.col("_linked")).cast("int")), _first=("latest", F.when(~F.col("_linked"), F.col("encounter_id"))))
    rows = rows.withColumns({"link": F.when(F.col("_linked"), F.col("_kind")), "episode_id": F.sha2(F.concat_ws("|", F.lit("episode"), "_first"), 256)})
    return slices.done(rows).drop("_prior", "_kind", "_failed", "_linked", "_first")


def episodes(linked: DataFrame, as_of, grouper: Callable[[Column, Column], Column] = rules.episode_type, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row for each episode of linked stays. ``grouper``: (first code, DRG) to type;
    ``tables``: ranges and prefixes to be used instead (see ``groupers``)."""
    place = F.struct("admit_ts", content_id(linked).alias("content"), "encounter_id")
    rows = linked.withColumn("_place", place)
    hours = F.when(F.col("los_hours") > 0, F.col("los_hours")).otherwise(1.0)
    has = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("_place"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_place", c))), lambda x: x[c])
    grouped = rows.groupBy("patient_key", "episode_id").agg(
        F.min("admit_ts").alias("episode_start_ts"),
        F.when(F.max(F.col("discharge_ts").isNull() & (F.col("status") != "cancelled")), F.lit(None)).otherwise(F.max("discharge_ts")).alias("episode_end_ts"),
        in_order("encounter_id").alias("encounter_ids"),
        F.count("*").alias("encounter_count"),
        F.array_distinct(in_order("facility_id")).alias("facility_sequence"),
        F.coalesce(F.max(F.col("link") == "readmission"), F.lit(False)).alias("includes_readmission"),
        F.coalesce(F.max(F.col("link") == "post_acute"), F.lit(False)).alias("includes_post_acute"),
        F.max("is_acute").alias("is_acute"),
        F.when(F.max(F.col("status") == "open"), "active").otherwise("closed").alias("episode_status"),
        F.min_by("principal_diagnosis", has("principal_diagnosis")).alias("principal_diagnosis"),
        F.min_by("drg", has("drg")).alias("_drg"),
        F.flatten(F.filter(in_order("diagnosis_codes"), lambda x: x.isNotNull())).alias("_dx"),
        (F.sum(F.col("confidence_score") * hours) / F.sum(hours)).alias("confidence_score"),
    )
    codes = F.filter("_dx", lambda x: F.coalesce(x["code"], F.lit("")) != "")
    kept = F.filter(codes, lambda x, i: ~F.exists(F.slice(codes, F.lit(1), i), lambda y: y["code"] == x["code"]))
    los = (F.unix_micros("episode_end_ts") - F.unix_micros("episode_start_ts")) / DAY
    stamp = F.lit(as_of).cast("timestamp")
    grouped = grouped.withColumn("_code", F.try_element_at("_dx", F.lit(1))["code"])
    grouped = grouped.withColumn("episode_type", grouper(F.col("_code"), F.col("_drg"))) if tables is None else groupers.typed(grouped.withColumnRenamed("_code", "_first"), *tables, code="_first", drg="_drg").withColumnRenamed("_first", "_code")
    return grouped.withColumns({"total_los_days": los, "facility_count": F.size("facility_sequence"), "diagnosis_codes": F.when(F.size(kept) > 0, kept), "created_at": stamp, "updated_at": stamp}).drop("_dx", "_drg", "_code")


def back_fill(encounters: DataFrame, episode_table: DataFrame) -> DataFrame:
    """Encounters with the id of the episode that lists them."""
    ids = episode_table.select(F.explode("encounter_ids").alias("encounter_id"), "episode_id")
    return encounters.drop("episode_id").join(ids, "encounter_id", "left")


def episode_quality(episode_table: DataFrame) -> DataFrame:
    return episode_table.agg(F.count("*").alias("episodes"), F.avg(F.col("includes_readmission").cast("int")).alias("readmission_rate"), F.avg("confidence_score").alias("avg_confidence"))


def recompute(encounters: DataFrame, as_of, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Episodes from a stored encounter table, and that table with their ids."""
    table = episodes(link(encounters.drop("episode_id"), settings), as_of)
    return table, back_fill(encounters, table)
