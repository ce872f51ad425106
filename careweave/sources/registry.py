"""Facility registry: public provider files to one table, and that table's scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the combined registry, and hospital subtypes by type.
COLUMNS = ("canonical_id", "canonical_name", "npi", "ccn", "facility_type", "facility_type_raw", "aliases", "source", "address_line1", "address_line2", "city", "state", "zip", "taxonomy_codes", "pos_category_code", "pos_subtype_code", "pos_provider_type_id", "pos_general_facility_type_code")
HOSPITAL_SUBTYPES = {"acute": ("01", "06", "11", "20", "22", "23"), "ltach": ("02", "27"), "psych": ("04", "07", "24", "25"), "rehab": ("05", "26")}
NPPES_NAME, NPPES_OTHER = "Provider Organization Name (Legal Business Name)", "Provider Other Organization Name"


def text(df: DataFrame, name: str) -> Column:
    """Trimmed column, or the empty string where it is null or missing."""
    return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file with a header, as text. Values with line ends need ``multi_line``, which
    makes each file one task."""
    return spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def _row(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(*(values.get(c, F.lit("")).alias(c) for c in COLUMNS))


def _json(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.to_json(names)).otherwise("")


def othernames(df: DataFrame) -> DataFrame:
    rows = df.select(text(df, "NPI").alias("npi"), text(df, NPPES_OTHER).alias("name")).where("npi <> '' AND name <> ''")
    return rows.groupBy("npi").agg(F.collect_set("name").alias("othernames"))


def nppes_orgs(df: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Registry rows of organisations (entity type 2) with a number and a name."""
    other, legal = text(df, NPPES_OTHER), text(df, NPPES_NAME)
    name = F.when(legal != "", legal).otherwise(other)
    codes = F.filter(F.array(*(text(df, f"Healthcare Provider Taxonomy Code_{k}") for k in range(1, 16))), lambda x: x != "")
    place = lambda part: text(df, f"Provider {part}")
    rows = df.where(text(df, "Entity Type Code") == "2").select(
        text(df, "NPI").alias("npi"), name.alias("name"), F.when((other != "") & (other != name), F.array(other)).otherwise(F.array().cast("array<string>")).alias("own"), _json(codes).alias("codes"),
        place("First Line Business Practice Location Address").alias("line1"), place("Second Line Business Practice Location Address").alias("line2"), place("Business Practice Location Address City Name").alias("town"),
        place("Business Practice Location Address State Name").alias("region"), place("Business Practice Location Address Postal Code").alias("post"),
    ).where("npi <> '' AND name <> ''")
    if others is not None:
        rows = rows.join(others, "npi", "left").withColumn("own", F.array_union("own", F.coalesce("othernames", F.array().cast("array<string>"))))
    return _row(rows, canonical_id=F.concat(F.lit("NPI:"), "npi"), canonical_name=F.col("name"), npi=F.col("npi"), aliases=_json(F.array_sort("own")), source=F.lit("nppes"), address_line1=F.col("line1"), address_line2=F.col("line2"), city=F.col("town"), state=F.col("region"), zip=F.col("post"), taxonomy_codes=F.col("codes"))


def hospital_type(category: Column, subtype: Column) -> Column:
    out = F.lit("")
    for name, codes in HOSPITAL_SUBTYPES.items():
        out = F.when((category == "01") & subtype.isin(*codes), name).otherwise(out)
    return out


def _pos(df: DataFrame, names: dict[str, str], **more: Column) -> DataFrame:
    get = {k: text(df, v) for k, v in names.items()}
    alias = F.when((get["alt"] != "") & (get["alt"] != get["name"]), F.to_json(F.array(get["alt"]))).otherwise("")
    return _row(df.where((get["ccn"] != "") & (get["name"] != "")), canonical_id=F.concat(F.lit("CCN:"), get["ccn"]), canonical_name=get["name"], ccn=get["ccn"], aliases=alias, address_line1=get["street"], city=get["city"], state=get["state"], zip=get["zip"], pos_general_facility_type_code=get["general"], **more)


def pos_hospital(df: DataFrame) -> DataFrame:
    category, subtype = text(df, "PRVDR_CTGRY_CD"), text(df, "PRVDR_CTGRY_SBTYP_CD")
    raw = F.when((category != "") | (subtype != ""), F.concat(category, F.lit(":"), subtype)).otherwise("")
    names = {"ccn": "PRVDR_NUM", "name": "FAC_NAME", "alt": "MLT_FAC_ORG_NAME", "street": "ST_ADR", "city": "CITY_NAME", "state": "STATE_CD", "zip": "ZIP_CD", "general": "GNRL_FAC_TYPE_CD"}
    return _pos(df, names, facility_type=hospital_type(category, subtype), facility_type_raw=raw, source=F.lit("pos_hospital"), pos_category_code=category, pos_subtype_code=subtype)


def pos_iqies(df: DataFrame) -> DataFrame:
    names = {"ccn": "prvdr_num", "name": "fac_name", "alt": "mlt_fac_org_name", "street": "st_adr", "city": "city_name", "state": "state_cd", "zip": "zip_cd", "general": "gnrl_fac_type_cd"}
    return _pos(df, names, facility_type_raw=text(df, "gnrl_fac_type_cd"), source=F.lit("pos_iqies"), pos_provider_type_id=text(df, "prvdr_type_id"))


def build_registry(nppes: DataFrame, others: DataFrame | None = None, hospitals: DataFrame | None = None, iqies: DataFrame | None = None) -> DataFrame:
    """All parts in one table of COLUMNS; numbers of the two kinds aren't matched."""
    out = nppes_orgs(nppes, othernames(others) if others is not None else None)
    for part, scan in ((hospitals, pos_hospital), (iqies, pos_iqies)):
        out = out.unionByName(scan(part)) if part is not None else out
    return out


def address(row: DataFrame) -> Column:
    """Lines, then "city, state zip", without blanks; null if nothing is there."""
    part = lambda name: F.nullif(text(row, name), F.lit(""))
    town = F.nullif(F.concat_ws(" ", F.nullif(F.concat_ws(", ", part("city"), part("state")), F.lit("")), part("zip")), F.lit(""))
    return F.nullif(F.concat_ws(", ", part("address_line1"), part("address_line2"), town), F.lit(""))


def load_registry(df: DataFrame, use_npi: bool = True, use_ccn: bool = True, first: int = 0) -> DataFrame:
    """Facilities of a combined registry: (canonical_id, canonical_name, npi, ccn,
    facility_type, aliases, address, ordinal)."""
    raw = text(df, "aliases")
    listed = F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), F.array(raw))
    aliases = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: (x != "") & (x != "<UNAVAIL>"))
    value = lambda name: F.nullif(text(df, name), F.lit(""))
    kept = df.where((text(df, "canonical_id") != "") & (text(df, "canonical_name") != ""))
    for prefix, use in (("NPI:", use_npi), ("CCN:", use_ccn)):
        kept = kept if use else kept.where(~text(df, "canonical_id").startswith(prefix))
    return kept.select(*(value(c).alias(c) for c in ("canonical_id", "canonical_name", "npi", "ccn", "facility_type")), aliases.alias("aliases"), address(df).alias("address"), F.lit(first).alias("ordinal"))
