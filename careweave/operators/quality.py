"""Run metrics, thresholds, gates and table assertions. All are small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweave import config

FLAG_METRICS = {
    "DUPLICATE_DETECTED": "duplicate_rate",
    "MISSING_DISCHARGE": "missing_discharge_rate",
    "TIMESTAMP_MISMATCH": "reconciliation_mismatch_rate",
    "FACILITY_UNRESOLVED": "facility_unresolved_rate",
    "AUTH_WITHOUT_ADMIT": "auth_without_admit_rate",
    "CLAIMS_ONLY_ENCOUNTER": "claims_only_rate",
}


def metrics(scored: DataFrame, stages: DataFrame, events_ingested: DataFrame, audit: DataFrame | None = None, low: float = 0.60) -> DataFrame:
    """(metric_name, metric_value) of a run: twelve values.

    ``stages``: (records_in, errors); ``events_ingested``: one row (n); ``audit``: (action)."""
    n = F.count("*")
    rate = lambda condition: F.coalesce(F.count_if(condition) / n, F.lit(0.0))
    wide = scored.agg(*(rate(F.array_contains("confidence_flags", flag)).alias(name) for flag, name in FLAG_METRICS.items()), rate(F.round("confidence", 9) < low).alias("low_confidence_rate"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence_score"))
    failed = stages.agg(F.coalesce(F.try_divide(F.sum("errors"), F.sum("records_in")), F.lit(0.0)).alias("failed_event_rate"))
    made = audit.agg(F.count_if(F.col("action") == "created").cast("double").alias("encounters_created"), F.count_if(F.col("action") == "updated").cast("double").alias("encounters_updated")) if audit is not None else scored.agg(n.cast("double").alias("encounters_created"), F.lit(0.0).alias("encounters_updated"))
    one = wide.crossJoin(failed).crossJoin(events_ingested.select(F.col("n").cast("double").alias("events_ingested"))).crossJoin(made)  # one row each
    return one.unpivot([], one.columns, "metric_name", "metric_value")


def statuses(values: DataFrame, thresholds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    table = config.THRESHOLDS if thresholds is None else thresholds
    limits = values.sparkSession.createDataFrame([(k, *v) for k, v in table.items()], "metric_name string, warn double, fail double")
    joined = values.join(F.broadcast(limits), "metric_name", "left")
    return joined.withColumn("status", F.when(F.col("metric_value") >= F.col("fail"), "fail").when(F.col("metric_value") >= F.col("warn"), "warn").otherwise("pass"))


def metric_rows(judged: DataFrame, run_id: str, as_of) -> DataFrame:
    detail = F.when(F.col("status") != "pass", F.format_string("%s=%.4f is %s", "metric_name", "metric_value", "status"))
    return judged.select(F.sha2(F.concat_ws("|", F.lit(run_id), "metric_name"), 256).alias("metric_id"), F.lit(run_id).alias("run_id"), "metric_name", "metric_value", F.lit(as_of).cast("timestamp").alias("run_ts"), "status", detail.alias("detail"))


def alerts(judged: DataFrame) -> DataFrame:
    return judged.where("status <> 'pass'").select("metric_name", "metric_value", "status", F.when(F.col("status") == "fail", F.col("fail")).otherwise(F.col("warn")).alias("threshold"))


def blocked(judged: DataFrame, block_on: tuple[str, ...] = ("fail",)) -> DataFrame:
    return judged.where(F.col("status").isin(*block_on)).select("metric_name")


def error_halt(stages: DataFrame, limit: float = 0.05) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.sum("errors"), F.sum("records_in")), F.lit(0.0))
    return stages.agg(rate.alias("error_rate")).withColumn("halt", F.col("error_rate") >= limit)


def stage_rows(errors: DataFrame, stage: str, run_id: str, started, ended) -> DataFrame:
    """One line of run metrics from error counts of a stage's sources."""
    sums = errors.agg(F.coalesce(F.sum("records_in"), F.lit(0)).alias("records_in"), F.coalesce(F.sum("records_out"), F.lit(0)).alias("records_out"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
    return sums.select(F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), "*", F.lit(started).cast("timestamp").alias("started_at"), F.lit(ended).cast("timestamp").alias("ended_at"), F.lit("completed").alias("status"))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def accepted_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def relationships(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def assertions(encounters: DataFrame, detail: DataFrame, episode_table: DataFrame) -> DataFrame:
    """(assertion, violations) of the five table assertions."""
    outside = ~F.col("confidence_score").between(0, 1)
    counted = lambda name, df: df.agg(F.lit(name).alias("assertion"), F.count("*").alias("violations"))
    return (
        counted("admit_before_discharge", encounters.where("status = 'closed' AND discharge_ts < admit_ts"))
        .union(counted("closed_has_discharge", encounters.where("status = 'closed' AND discharge_ts IS NULL")))
        .union(counted("encounter_score_range", encounters.where(outside)))
        .union(counted("episode_score_range", episode_table.where(outside)))
        .union(counted("detail_has_encounter", relationships(detail, "encounter_id", encounters, "encounter_id")))
    )


def latest_run(run_metrics: DataFrame) -> DataFrame:
    last = run_metrics.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1).select("run_id")
    return run_metrics.join(F.broadcast(last), "run_id").groupBy("run_id").agg(F.sum("records_in").alias("records_in"), F.sum("records_out").alias("records_out"), F.sum("errors").alias("errors"))


def run_stages(run_metrics: DataFrame, run_id: str) -> DataFrame:
    return run_metrics.where(F.col("run_id") == run_id).orderBy("stage")


def encounter_events(encounters: DataFrame, detail: DataFrame, encounter_id: str) -> DataFrame:
    one = encounters.where(F.col("encounter_id") == encounter_id)
    return one.join(detail.where(F.col("encounter_id") == encounter_id), "encounter_id").orderBy("event_ts", "event_id")


def run_log(audit: DataFrame) -> DataFrame:
    """Audit lines of the last run, in order of time."""
    last = audit.orderBy(F.desc("created_at"), F.desc("run_id")).limit(1).select("run_id")
    return audit.join(F.broadcast(last), "run_id").orderBy("created_at", "audit_id")
