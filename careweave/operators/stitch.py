"""Events to encounters: gaps, facilities, forced splits, transfers, stable ids.

All is running values over one patient's events in one total order (see ``slices``), so a
single exchange on ``patient_key`` serves every step here, and patients of very many events
are dealt out in slices of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from careweave import config
from careweave.config import Settings
from careweave.functions import rules
from careweave.operators.slices import Slices
from careweave.sources.shared import written


def source_rank(tiebreak: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, tiebreak)), F.col("source_type")), F.lit(0)).cast("int")


def order(settings: Settings) -> list[Column]:
    """The total order of events; sources that aren't in the tiebreak come last."""
    rank = source_rank(settings.tiebreak)
    return [F.col("event_ts"), F.when(rank == 0, 99).otherwise(rank), F.col("source_system"), F.col("source_record_id"), F.col("side")]


def position(settings: Settings) -> Column:
    names = ("event_ts", "rank", "source_system", "source_record_id", "side")
    return F.struct(*(c.alias(n) for c, n in zip(order(settings), names, strict=True)))


def is_admit() -> Column:
    return F.col("event_type").isin(*config.ADMIT_TYPES)


def is_discharge() -> Column:
    return F.col("event_type").isin(*config.DISCHARGE_TYPES)


def is_marker() -> Column:
    return is_discharge() | (F.col("event_type") == "CANCEL_DISCHARGE")


def _whole() -> Slices:
    return Slices(["patient_key"])


def sessions(events: DataFrame, settings: Settings = Settings(), slices: Slices | None = None) -> DataFrame:
    """Adds ``begins``: a new session after a long gap or at another facility."""
    rows = (slices or _whole()).running(events, order(settings), _before=("last", F.struct("event_ts", "facility_id")))
    before = F.col("_before")
    begins = before.isNull() | (F.unix_micros("event_ts") - F.unix_micros(before["event_ts"]) > settings.window_hours * 3_600_000_000)
    if settings.facility_must_match:
        begins = begins | F.col("facility_id").isNull() | before["facility_id"].isNull() | (F.col("facility_id") != before["facility_id"])
    return rows.withColumn("begins", F.coalesce(begins, F.lit(True))).drop("_before")


def forced_splits(events: DataFrame, settings: Settings = Settings(), slices: Slices | None = None) -> DataFrame:
    """Adds ``splits``: an admission of some class after a discharge starts a new stay.

    The one rule (inpatient after inpatient) has a closed form: the last marker of the
    session is a discharge, an inpatient event is in it, and no admission has split it since.
    Other rules run a machine of ten states along each patient."""
    slices = slices or _whole()
    if settings.transitions != (("inpatient", "inpatient"),):
        return _machine_splits(events, settings, slices)
    here, inpatient = position(settings), F.col("patient_class").eqNullSafe("inpatient")
    rows = slices.running(
        events, order(settings),
        _mark=("last", F.when(is_marker(), F.struct(here.alias("at"), is_discharge().alias("out")))), _began=("latest", F.when(F.col("begins"), here)), _seen=("last", F.when(inpatient, here)),
    )
    closed = F.col("_mark.out") & (F.col("_mark.at") >= F.col("_began"))
    candidate = is_admit() & inpatient & closed & (F.col("_seen") >= F.col("_began"))
    rows = rows.withColumn("_candidate", F.coalesce(candidate, F.lit(False)))
    rows = slices.running(rows, order(settings), _split=("last", F.when(F.col("_candidate"), here)))
    splits = F.col("_candidate") & F.coalesce(F.col("_split") < F.col("_mark.at"), F.lit(True))
    return rows.withColumn("splits", splits).drop("_mark", "_began", "_seen", "_candidate", "_split")


#: Kinds of events for the machine, and the classes of a session by rank (0: none yet).
_OTHER, _OUT, _REOPENED, _IN = range(4)
_CLASSES = len(config.CLASS_PRIORITY) + 1


def _steps(begins: np.ndarray, kind: np.ndarray, cls: np.ndarray, state: list[int], pairs: set[tuple[int, int]]) -> Iterator[tuple[bool, ...]]:
    """For each event whether it splits, from each of the states (closed * 5 + class), which
    are brought up to date."""
    for new, k, c in zip(begins.tolist(), kind.tolist(), cls.tolist(), strict=True):
        split = []
        for i, s in enumerate(state):
            closed, best = (False, 0) if new else divmod(s, _CLASSES)
            cut = bool(closed) and k == _IN and (best, c) in pairs
            split.append(cut)
            closed = k == _OUT or (closed and k != _REOPENED and not cut)
            best = c if cut or not best else min(best, c) if c else best
            state[i] = closed * _CLASSES + best
        yield tuple(split)


def _machine_splits(events: DataFrame, settings: Settings, slices: Slices) -> DataFrame:
    """Two passes in order: what a slice makes of each state, then the splits themselves."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, config.CLASS_PRIORITY)), F.col("patient_class")), F.lit(0)).cast("int")
    kind = F.when(is_discharge(), _OUT).when(F.col("event_type") == "CANCEL_DISCHARGE", _REOPENED).when(is_admit(), _IN).otherwise(_OTHER)
    pairs = {(config.CLASS_PRIORITY.index(a) + 1, config.CLASS_PRIORITY.index(b) + 1) for a, b in settings.transitions}
    sliced = slices.cells is not None
    rows = events.withColumns({"_kind": kind, "_rank": rank, "_part": F.col("_slice") if sliced else F.lit(0), "_start": F.lit(0)})
    states = 2 * _CLASSES

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("patient_key", "_part").sortWithinPartitions("patient_key", "_part", *order(settings))

    def walk(batches: Iterator[pa.RecordBatch], start: Callable[[pa.RecordBatch, int], list[int]]) -> Iterator[tuple[pa.RecordBatch, list, list]]:
        at, state = None, []
        for b in batches:
            column = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("begins", "_kind", "_rank")}
            place = list(zip(b.column("patient_key").to_pylist(), b.column("_part").to_pylist(), strict=True))
            cuts = [i for i in range(len(place)) if not i or place[i] != place[i - 1]] + [len(place)]
            split, after = [], []
            for i, z in zip(cuts, cuts[1:], strict=False):
                if place[i] != at:
                    at, state = place[i], start(b, i)
                split += _steps(column["begins"][i:z], column["_kind"][i:z], column["_rank"][i:z], state, pairs)
                after.append((at, list(state)))
            yield b, split, after

    if sliced:

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict = {}
            for _, _, after in walk(batches, lambda b, i: list(range(states))):
                kept |= dict(after)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int32()), pa.array(list(kept.values()), pa.list_(pa.int32()))], names=["patient_key", "_slice", "_to"])

        some = rows.where("_cut").select("patient_key", "_part", "begins", "_kind", "_rank", *_order_names(events, settings))
        parts = in_order(some).mapInArrow(summed, "patient_key string, _slice int, _to array<int>")
        # fewer than 2,000 slices: each patient's maps are applied one after the other
        grouped = parts.groupBy("patient_key").agg(F.array_sort(F.collect_list(F.struct("_slice", "_to"))).alias("parts"))
        empty = F.expr("named_struct('state', 0, 'out', cast(array() as array<struct<_slice:int,_carried:int>>))")
        step = lambda s, x: rules.named(state=F.get(x["_to"], s["state"]), out=F.array_append(s["out"], rules.named(_slice=x["_slice"], _carried=s["state"])))
        carry = written(grouped.select("patient_key", F.inline(F.aggregate("parts", empty, step)["out"])), "carry")
        carry = carry.select(F.col("patient_key").alias("_patient"), F.col("_slice").alias("_at"), "_carried")
        rows = rows.join(F.broadcast(carry), (F.col("patient_key") == F.col("_patient")) & (F.col("_slice") == F.col("_at")), "left")
        rows = rows.withColumn("_start", F.coalesce("_carried", F.lit(0))).drop("_patient", "_at", "_carried")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, split, _ in walk(batches, lambda b, i: [b.column("_start")[i].as_py()]):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s[0] for s in split], pa.bool_())], names=[*b.schema.names, "splits"])

    return in_order(rows).mapInArrow(told, StructType([*rows.schema.fields, StructField("splits", BooleanType())])).drop("_kind", "_rank", "_part", "_start")


def _order_names(events: DataFrame, settings: Settings) -> list[str]:
    return ["event_ts", "source_type", "source_system", "source_record_id", "side"]


def encounter_id(patient: Column, facility: Column, record: Column) -> Column:
    return F.sha2(F.concat_ws("|", patient, F.coalesce(facility, F.lit("")), record), 256)


def content_id(df: DataFrame) -> Column:
    """The id that a stay has by its events. It decides between stays that begin together, as a
    stay may be called by the id that it had in an earlier run (see ``with_stable_ids``)."""
    return F.coalesce("content_id", "encounter_id") if "content_id" in df.columns else F.col("encounter_id")


def stitch(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Events with ``encounter_no`` within the patient and ``encounter_id``."""
    slices = Slices.of(events, ["patient_key"], "event_ts", settings.slice_rows)
    split = forced_splits(sessions(slices.cut(events, "event_ts"), settings, slices), settings, slices)
    numbered = slices.running(split, order(settings), encounter_no=("sum", (F.col("begins") | F.col("splits")).cast("int")))
    place = position(settings)
    first = slices.least(numbered, ["patient_key", "encounter_no"], _anchor=F.struct((~is_admit()).alias("other"), place.alias("place")), _first=F.struct(place.alias("place"), "facility_id"))
    named = first.withColumn("encounter_id", encounter_id(F.col("patient_key"), F.col("_first.facility_id"), F.col("_anchor.place.source_record_id")))
    return slices.done(named).drop("begins", "splits", "_anchor", "_first")


def encounters(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each encounter of stitched events: type, status, times, sources."""
    at = position(settings)
    events = events.withColumn("_at", at)
    cls = F.array_position(F.array(*map(F.lit, config.CLASS_PRIORITY)), F.col("patient_class"))
    cancels = F.col("event_type").isin("CANCEL_ADMIT", "CANCEL_DISCHARGE")
    when = lambda condition, value: F.when(condition, value)
    grouped = events.groupBy("patient_key", "encounter_id").agg(
        *(F.max(c).alias(c) for c in events.columns if c == "content_id"),
        F.min_by("facility_id", "_at").alias("facility_id"),
        F.min_by("facility_name", "_at").alias("facility_name"),
        F.min(F.when(cls > 0, cls)).alias("_class"),
        F.max_by(is_discharge(), when(is_marker(), F.col("_at"))).alias("_marked"),
        F.max(is_marker()).alias("_any_marker"),
        F.max_by("event_type", when(cancels, F.col("_at"))).alias("_cancel"),
        F.max(cancels).alias("_any_cancel"),
        F.max(when(is_discharge(), F.col("_at"))).alias("_last_discharge"),
        F.max(when(F.col("event_type") == "CANCEL_DISCHARGE", F.col("_at"))).alias("_last_cancel"),
        F.coalesce(F.min(when(is_admit(), F.col("event_ts"))), F.min("event_ts")).alias("admit_ts"),
        F.max(when(is_discharge(), F.col("event_ts"))).alias("_discharge_ts"),
        F.min("event_ts").alias("first_event_ts"),
        F.max("event_ts").alias("last_event_ts"),
        F.count("*").alias("n_events"),
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "event_id"))), lambda x: x["event_id"]).alias("source_event_ids"),
        F.array_sort(F.collect_set("source_system")).alias("source_systems"),
        F.max(F.col("source_system").startswith("adt")).alias("has_adt"),
        F.max(F.col("source_system").startswith("claims")).alias("has_claims"),
        F.max(F.col("source_system").startswith("auth")).alias("has_auth"),
        F.max(F.col("event_type") == "OBS_TO_IP").alias("obs_to_ip"),
        F.max((F.col("event_type") == "CANCEL_DISCHARGE").cast("int")).alias("_has_cancel"),
    )
    has = F.col("_any_marker") & F.coalesce("_marked", F.lit(False))
    closed = F.col("_last_discharge").isNotNull() & (F.col("_last_cancel").isNull() | (F.col("_last_discharge") > F.col("_last_cancel")))
    status = F.when(F.col("_any_cancel") & (F.col("_cancel") == "CANCEL_ADMIT"), "cancelled").when(closed, "closed").otherwise("open")
    kind = F.element_at(F.array(*map(F.lit, ("inpatient", "observation", "ed_only", "outpatient"))), F.coalesce("_class", F.lit(4)).cast("int"))
    out = grouped.withColumns({"has_discharge": has, "status": status, "encounter_type": kind, "discharge_ts": F.when(has, F.col("_discharge_ts"))})
    los = (F.unix_micros("discharge_ts") - F.unix_micros("admit_ts")) / 3_600_000_000
    return out.withColumn("los_hours", los).drop("_class", "_marked", "_any_marker", "_cancel", "_any_cancel", "_last_discharge", "_last_cancel", "_discharge_ts")


def transfers(stays: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``transfer_chain``: ids of the maximal run of linked stays, null if alone.

    A stay links to the next of its patient at another facility soon after discharge. Of
    stays that begin together the facility decides which is next, then the id by content."""
    slices, by = Slices.of(stays, ["patient_key"], "first_event_ts", settings.slice_rows), [F.col("first_event_ts"), F.col("facility_id"), content_id(stays)]
    rows = slices.running(slices.cut(stays, "first_event_ts"), by, _before=("last", F.struct("discharge_ts", "has_discharge", "facility_id")))
    before = F.col("_before")
    gap = F.unix_micros("first_event_ts") - F.unix_micros(before["discharge_ts"])
    linked = before["has_discharge"] & (before["facility_id"] != F.col("facility_id")) & gap.between(0, settings.window_hours * 3_600_000_000)
    chained = slices.running(rows.withColumn("_begins", ~F.coalesce(linked, F.lit(False))), by, _chain=("sum", F.col("_begins").cast("int")))
    # a chain is put together once
    listed = chained.groupBy("patient_key", "_chain").agg(F.array_sort(F.collect_list(F.struct("first_event_ts", "facility_id", content_id(stays).alias("_content"), "encounter_id"))).alias("_members")).where(F.size("_members") > 1)
    chains = listed.select("patient_key", "_chain", F.transform("_members", lambda x: x["encounter_id"]).alias("transfer_chain"))
    return slices.done(chained.join(chains, ["patient_key", "_chain"], "left")).drop("_chain", "_begins", "_before")


def stitch_counts(events: DataFrame, stays: DataFrame) -> DataFrame:
    """Transfer chains among the stays, cancellations among the events."""
    chains = stays.agg(F.count_distinct("transfer_chain").alias("transfers"))
    return chains.crossJoin(events.agg(F.count_if(F.col("event_type").isin("CANCEL_ADMIT", "CANCEL_DISCHARGE")).alias("cancellations")))  # one row each


#: Microseconds of thirty days.
SLICE = 30 * 86_400_000_000


def stable_ids(new: DataFrame, prior: DataFrame, as_of, settings: Settings = Settings()) -> DataFrame:
    """(encounter_id, stable_id): the id of the nearest earlier stay that a stay overlaps.

    An earlier stay is continued by one stay, the nearest to it; others keep their own ids.
    ``prior``: (encounter_id, patient_key, facility_id, first_event_ts, last_event_ts)."""
    window = settings.window_hours * 3_600_000_000
    old = prior.where(F.col("last_event_ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {settings.history_days} DAYS"))
    old = old.select("patient_key", F.col("encounter_id").alias("stable_id"), F.col("facility_id").alias("_fac"), F.unix_micros("first_event_ts").alias("_first"), F.unix_micros("last_event_ts").alias("_last"))
    begun = new.agg(F.max(F.unix_micros("first_event_ts"))).union(old.agg(F.max("_first"))).agg(F.max("max(unix_micros(first_event_ts))")).first()[0]
    # only what shares a slice of time is compared; intervals that meet do so before the last begins
    size = 2 * window + SLICE
    slices = lambda a, z: F.sequence(F.floor(a / size), F.greatest(F.floor(a / size), F.floor(F.least(z, F.lit((begun or 0) + window)) / size)))
    old = old.withColumn("_slice", F.explode(slices(F.col("_first") - window, F.col("_last") + window)))
    first, last = F.unix_micros("first_event_ts"), F.unix_micros("last_event_ts")
    joined = new.withColumn("_slice", F.explode(slices(first, last))).join(old, ["patient_key", "_slice"])
    near = (first <= F.col("_last") + window) & (F.col("_first") <= last + window)
    if settings.facility_must_match:
        near = near & (F.col("facility_id") == F.col("_fac"))
    pairs = joined.where(near).select("encounter_id", "stable_id", F.abs(first - F.col("_first")).alias("_far"))
    # an id that a stay has by itself is that one's
    own = new.select(F.col("encounter_id").alias("stable_id"), F.lit(True).alias("_own")).distinct()
    pairs = pairs.join(own, "stable_id", "left").where(F.col("_own").isNull() | (F.col("encounter_id") == F.col("stable_id")))
    pairs = pairs.withColumn("_far", F.when(F.col("encounter_id") == F.col("stable_id"), -1).otherwise(F.col("_far")))
    best = pairs.groupBy("encounter_id").agg(F.min(F.struct("_far", "stable_id")).alias("_best")).select("encounter_id", "_best.*")
    won = best.groupBy("stable_id").agg(F.min_by("encounter_id", F.struct("_far", "encounter_id")).alias("encounter_id"))
    return new.select("encounter_id").join(won, "encounter_id", "left").withColumn("stable_id", F.coalesce("stable_id", "encounter_id"))
