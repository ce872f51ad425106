"""Facility resolution: exact names, identifiers, registry, similar names, new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweave.functions import rules, similarity
from careweave.sources import scan
from careweave.sources.shared import written

NEW_FLAG = "FACILITY_NEW_UNREVIEWED"


def new_id(normal: Column) -> Column:
    return F.concat(F.lit("FAC_"), F.substring(F.sha2(normal, 256), 1, 12))


def name_index(facilities: DataFrame, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """(normal, facility_id, place): every alias and name; the last registered one wins."""
    names = facilities.select("canonical_id", "ordinal", F.posexplode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical_name"))).alias("nth", "name"))
    normal = names.withColumn("normal", rules.normal_name(F.col("name"), abbreviations)).where("normal <> ''")
    return normal.groupBy("normal").agg(F.max_by("canonical_id", F.struct("ordinal", "nth")).alias("facility_id"), F.min(F.struct("ordinal", "nth")).alias("place"))


def id_index(facilities: DataFrame, column: str) -> DataFrame:
    """(column, facility_id) of facilities that have this identifier; the last one wins."""
    value = F.trim(column)
    return facilities.where(value != "").groupBy(value.alias(column)).agg(F.max_by("canonical_id", "ordinal").alias("facility_id"))


def similar_names(names: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """(normal, facility_id, score): the best indexed name for each of ``names`` (normal).

    Names meet by keys that similar ones must share (see ``similarity``), so a name is
    compared with few others, however many are indexed."""
    if threshold <= 0:
        return names.limit(0).select("normal", F.lit("").alias("facility_id"), F.lit(0.0).alias("score"))
    kinds = [*similarity.KINDS]
    text = F.replace(F.col("normal"), F.lit(" "), F.lit(""))
    counts = [F.sum(F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))).alias(f"k{i}") for i, k in enumerate(kinds)]
    found = index.agg(*counts, F.sum(F.length(F.translate(text, similarity.KINDS, ""))).alias("other")).first()  # 37 numbers
    weights = tuple(int(x or 0) for x in found)
    lines = index.select(F.col("normal").alias("candidate"), "facility_id", "place").mapInArrow(similarity.keyed(weights, threshold), "candidate string, facility_id string, place struct<ordinal:int,nth:int>, their_bits long, key long")
    asked = names.select("normal").distinct().mapInArrow(similarity.keyed(weights, threshold), "normal string, bits long, key long")
    most = F.floor((1 - threshold) * (F.length("normal") + F.length("candidate")) + 1e-9)
    pairs = asked.join(lines, "key").where(F.bit_count(F.col("bits").bitwiseXOR(F.col("their_bits"))) <= most).select("normal", "candidate", "key", "facility_id", "place")
    near = pairs.mapInArrow(similarity.scored(weights, threshold), "normal string, candidate string, key long, facility_id string, place struct<ordinal:int,nth:int>, score double")
    best = near.groupBy("normal").agg(F.min_by(F.struct("facility_id", "score"), F.struct(-F.col("score"), "place")).alias("best"))
    return best.select("normal", "best.facility_id", "best.score")


def resolve(events: DataFrame, facilities: DataFrame, registry: DataFrame | None = None, threshold: float = 0.85, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """Events with ``facility_id``, ``facility_name``, ``facility_match_type``, ``facility_flags``.

    ``facilities`` and ``registry``: (canonical_id, canonical_name, npi, ccn, facility_type,
    aliases, ordinal). A blank name resolves to null; provided identifiers stay. Where events
    have a ``raw_payload`` (JSON), it gives an npi or ccn that the event lacks.

    Each distinct (name, npi, ccn) is resolved once and joined back."""
    given = F.coalesce(F.col("facility_match_type") == "customer_provided", F.lit(False))
    if "raw_payload" in events.columns:
        events = events.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.get_json_object("raw_payload", f"$.{c}")) for c in ("npi", "ccn")})
    parts = ("facility_raw", "npi", "ccn")
    found = written(_resolve_names(events.where(~given).select(*parts).distinct(), facilities, registry, threshold, abbreviations), "facilities")
    found = found.select(*(F.col(c).alias(f"_{c}") for c in parts), F.col("facility_id").alias("_found"), F.col("match").alias("_match"))
    same = ~given
    for c in parts:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = events.join(found, same, "left").drop(*(f"_{c}" for c in parts))
    joined = joined.withColumns({"facility_id": F.when(given, F.col("facility_id")).otherwise(F.col("_found")), "facility_match_type": F.when(given, "customer_provided").otherwise(F.col("_match"))}).drop("_found", "_match")
    called = [t.select("canonical_id", "canonical_name", "ordinal") for t in (facilities, registry) if t is not None]
    names = (called[0].union(called[1]) if registry is not None else called[0]).groupBy("canonical_id").agg(F.max_by("canonical_name", "ordinal").alias("_name"))
    out = joined.join(names, F.col("facility_id") == F.col("canonical_id"), "left").drop("canonical_id")
    flags = F.when(F.col("facility_match_type") == "new", F.array(F.lit(NEW_FLAG))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"facility_name": F.coalesce("_name", "facility_raw"), "facility_flags": flags}).drop("_name")


def _resolve_names(names: DataFrame, facilities: DataFrame, registry: DataFrame | None, threshold: float, abbreviations: dict[str, str] | None) -> DataFrame:
    """Distinct names and identifiers with ``facility_id`` and ``match``."""
    rows = names.withColumn("normal", F.coalesce(rules.normal_name(F.col("facility_raw"), abbreviations), F.lit("")))
    index = name_index(facilities, abbreviations)
    joined = rows.join(index.select("normal", F.col("facility_id").alias("by_name")), "normal", "left")
    for column in ("npi", "ccn"):
        for name, table in ((column, facilities), (f"{column}_registry", registry)):
            if table is None:
                joined = joined.withColumn(f"by_{name}", F.lit(None).cast("string"))
            else:
                found = id_index(table, column).select(F.col(column).alias("_id"), F.col("facility_id").alias(f"by_{name}"))
                joined = joined.join(found, F.trim(F.col(column)) == F.col("_id"), "left").drop("_id")
    order = ("by_name", "by_npi", "by_npi_registry", "by_ccn", "by_ccn_registry")
    known = F.coalesce(*order)
    open_names = joined.where((F.col("normal") != "") & known.isNull()).select("normal").distinct()
    fuzzy = similar_names(open_names, index, threshold).select("normal", F.col("facility_id").alias("by_fuzzy"), F.col("score").alias("fuzzy_score"))
    joined = joined.join(fuzzy, "normal", "left")
    named = F.col("normal") != ""
    kinds = [(F.col("by_name"), "exact"), (F.col("by_npi"), "npi"), (F.col("by_npi_registry"), "npi_registry"), (F.col("by_ccn"), "ccn"), (F.col("by_ccn_registry"), "ccn_registry"), (F.col("by_fuzzy"), "fuzzy")]
    kind = rules.first_match([(c.isNotNull(), k) for c, k in kinds], F.lit("new"))
    found = F.when(named, F.coalesce(known, "by_fuzzy", new_id(F.col("normal"))))
    return joined.select("facility_raw", "npi", "ccn", found.alias("facility_id"), F.when(named, kind).alias("match"))


def new_facilities(resolved: DataFrame) -> DataFrame:
    """Registry rows of facilities that were made up for unknown names."""
    new = resolved.where("facility_match_type = 'new'")
    return new.groupBy("facility_id").agg(F.min("facility_raw").alias("canonical_name"), F.array_sort(F.collect_set("facility_raw")).alias("aliases"), F.count("*").alias("n_events")).withColumn("flags", F.array(F.lit(NEW_FLAG)))


def facility_types(facilities: DataFrame) -> DataFrame:
    return facilities.where("facility_type IS NOT NULL").groupBy("canonical_id").agg(F.max_by("facility_type", "ordinal").alias("facility_type"))


def lookup(facilities: DataFrame, *, alias: str | None = None, npi: str | None = None, ccn: str | None = None, facility_id: str | None = None, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """Facilities of an identifier; of a name in its normal form, which is that of one."""
    for column, value in (("canonical_id", facility_id), ("npi", npi), ("ccn", ccn)):
        if value is not None:
            facilities = facilities.where(F.trim(column) == value.strip())
    if alias is None:
        return facilities
    found = name_index(facilities, abbreviations).where((F.col("normal") == rules.normal_name(F.lit(alias), abbreviations)) & (F.col("normal") != ""))
    return facilities.join(found.select(F.col("facility_id").alias("canonical_id")), "canonical_id", "left_semi")


class UnknownFacility(LookupError):
    """No facility has this id."""


def add_alias(facilities: DataFrame, facility_id: str, alias: str) -> DataFrame:
    """``facilities`` where one has one more name."""
    known = F.col("canonical_id") == facility_id
    if facilities.where(known).isEmpty():
        raise UnknownFacility(facility_id)
    added = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.lit(alias)))
    return facilities.withColumn("aliases", F.when(known, added).otherwise(F.col("aliases")))


def add_facility(facilities: DataFrame, canonical_name: str, facility_id: str | None = None, npi: str | None = None, ccn: str | None = None, facility_type: str | None = None, aliases: list[str] | None = None, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """``facilities`` and a new one, after all others; its id is that of its name if not given."""
    row = facilities.sparkSession.createDataFrame([(canonical_name, facility_id, npi, ccn, facility_type, aliases or [])], "canonical_name string, given string, npi string, ccn string, facility_type string, aliases array<string>")
    row = row.withColumn("canonical_id", F.coalesce("given", new_id(rules.normal_name(F.col("canonical_name"), abbreviations)))).drop("given")
    return upsert_facilities(facilities, row)


def upsert_facilities(facilities: DataFrame, changes: DataFrame) -> DataFrame:
    """``facilities`` with ``changes`` in place of those of the same id, and the new ones after all
    others, in the order of their ids."""
    last = facilities.agg(F.max("ordinal")).first()[0]
    changes = scan.last_of_each(changes.drop("ordinal"), "canonical_id")
    places = facilities.select("canonical_id", F.col("ordinal").alias("_at"))
    # new facilities of one batch share a place; ids tell them apart where names are equal
    changes = changes.join(places, "canonical_id", "left").withColumn("ordinal", F.coalesce("_at", F.lit((-1 if last is None else last) + 1))).drop("_at")
    return scan.upsert(facilities, changes, "canonical_id")


def unresolved(facilities: DataFrame) -> DataFrame:
    return facilities.where(F.array_contains("flags", NEW_FLAG))


def merge_facility(facilities: DataFrame, encounters: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """The source's names become aliases of the target, its encounters the target's."""
    names = facilities.where(F.col("canonical_id") == source).agg(F.array_distinct(F.flatten(F.collect_list(F.array_append("aliases", F.col("canonical_name"))))).alias("_more"))
    joined = facilities.where(F.col("canonical_id") != source).crossJoin(F.broadcast(names))  # one row
    merged = joined.withColumn("aliases", F.when(F.col("canonical_id") == target, F.array_union("aliases", "_more")).otherwise(F.col("aliases"))).drop("_more")
    moved = F.when(F.col("facility_id") == source, F.lit(target)).otherwise(F.col("facility_id"))
    return merged, encounters.withColumn("facility_id", moved)
