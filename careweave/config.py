"""Settings of the reconciliation engine, as plain values with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Vocabularies of event types and classes.
ADMIT_TYPES = ("ADMIT", "CLAIM_ADMIT", "ED_ARRIVAL", "OBS_START")
DISCHARGE_TYPES = ("DISCHARGE", "CLAIM_DISCHARGE", "ED_DEPARTURE", "OBS_END")
CLASS_PRIORITY = ("inpatient", "observation", "ed", "outpatient")
CLASS_WORDS = {
    "inpatient": ("i", "ip", "inpatient"),
    "outpatient": ("o", "op", "outpatient"),
    "ed": ("e", "ed", "emergency"),
    "observation": ("obs", "observation"),
}

# Abbreviations of facility names.
ABBREVIATIONS = {
    "MED CTR": "MEDICAL CENTER",
    "MED": "MEDICAL",
    "CTR": "CENTER",
    "HOSP": "HOSPITAL",
    "HSP": "HOSPITAL",
    "HLTH": "HEALTH",
    "SYS": "SYSTEM",
    "REHAB": "REHABILITATION",
    "PSYCH": "PSYCHIATRIC",
    "COMM": "COMMUNITY",
    "GENL": "GENERAL",
    "GEN": "GENERAL",
    "REGL": "REGIONAL",
    "REG": "REGIONAL",
    "UNIV": "UNIVERSITY",
    "ST": "SAINT",
    "MT": "MOUNT",
}

# Generic endings of facility names, and words that may follow them.
GENERIC_SUFFIXES = ("MEDICAL CENTER", "HEALTH SYSTEM", "HEALTH CENTER", "HOSPITAL", "HEALTH", "CLINIC", "CENTER")
PRESERVED_WORDS = ("EAST", "WEST", "NORTH", "SOUTH", "MAIN", "DOWNTOWN", "CAMPUS", "MIDTOWN", "UPTOWN")

# Confidence weights, penalties, days until an open stay is stale.
SIGNAL_WEIGHTS = {
    "HAS_CLAIMS": 30,
    "HAS_ADT_ADMIT": 20,
    "HAS_ADT_DISCHARGE": 10,
    "HAS_AUTH": 10,
    "FACILITY_RESOLVED": 5,
    "TIMESTAMPS_CONSISTENT": 15,
    "PATIENT_CLASS_CONSISTENT": 10,
}
PENALTIES = {
    "MISSING_DISCHARGE": -0.15,
    "ORPHAN_DISCHARGE": -0.20,
    "TIMESTAMP_MISMATCH": -0.10,
    "CLAIMS_ONLY_ENCOUNTER": -0.10,
    "STALE_OPEN_ENCOUNTER": -0.20,
    "DUPLICATE_DETECTED": -0.05,
    "FACILITY_UNRESOLVED": -0.10,
    "AUTH_WITHOUT_ADMIT": -0.05,
    "CANCELLED_AND_REOPENED": -0.05,
}
STALE_DAYS = {"acute": 30, "ed_standalone": 3, "ltach": 90, "snf": 120, "rehab": 60, "psych": 90}

# Limits at which a quality metric warns or fails.
THRESHOLDS = {
    "duplicate_rate": (0.05, 0.15),
    "missing_discharge_rate": (0.10, 0.25),
    "reconciliation_mismatch_rate": (0.10, 0.25),
    "low_confidence_rate": (0.15, 0.30),
    "facility_unresolved_rate": (0.05, 0.15),
    "failed_event_rate": (0.02, 0.05),
}

# DRG ranges and diagnosis prefixes of episode types.
DRG_RANGES = {
    "surgical": ((1, 42), (113, 117), (129, 139), (163, 168), (215, 245), (246, 267), (326, 358), (405, 425), (453, 520), (570, 585), (614, 630), (652, 675), (707, 718), (734, 750), (799, 804), (820, 830), (901, 909), (955, 959), (969, 970)),
    "maternity": ((765, 768), (774, 775), (796, 798)),
    "behavioral_health": ((876, 887), (894, 897)),
}
DIAGNOSIS_PREFIXES = {
    "chronic_exacerbation": ("I50", "J44", "J45", "J96", "E10", "E11", "E13", "N17", "N18", "I48", "J47", "J84", "K70", "K74"),
    "maternity": ("O", "Z37"),
    "behavioral_health": ("F",),
    "surgical": ("S72", "S82", "S42", "T84", "M17", "M16"),
    "medical": ("A", "B", "C", "D0", "D1", "D2", "D3", "D4", "D5", "D6", "D7", "D8", "D9", "E", "G", "H", "I", "J", "K", "L", "M", "N", "R", "S", "T", "Z"),
}


@dataclass(frozen=True)
class Source:
    """How one source's columns become canonical events."""

    name: str
    kind: str  # adt, claims or auth
    fields: dict[str, str]
    incremental_key: str
    type_field: str | None = None
    type_map: dict[str, str] = field(default_factory=dict)
    type_rules: tuple[tuple[str, str], ...] = ()
    admit_flag: str | None = None
    discharge_flag: str | None = None
    admit: tuple[str, str] | None = None  # (timestamp column, event type) of a paired event
    discharge: tuple[str, str] | None = None
    class_rules: tuple[tuple[str, str], ...] = ()
    status_field: str | None = None
    status_map: dict[str, str] = field(default_factory=dict)
    exclude: str | None = None


@dataclass(frozen=True)
class Settings:
    window_hours: int = 48
    facility_must_match: bool = True
    transitions: tuple[tuple[str, str], ...] = (("inpatient", "inpatient"),)  # (from, to) that start a new stay
    tiebreak: tuple[str, ...] = ("claims", "adt", "auth")
    history_days: int = 90
    pass_bytes: int = 128 << 20  # larger tables of a batch are worked on in several passes, a part of the patients in each
    slice_rows: int = 50_000  # keys of more rows (and of a 500th of all) are cut into slices of time
    match_fields: tuple[str, ...] = ("patient_key", "event_type", "facility_id")
    tolerance_minutes: int = 30
    timestamp_priority: tuple[tuple[str, int], ...] = (("adt", 100), ("claims", 80), ("auth", 40))
    class_priority: tuple[tuple[str, int], ...] = (("claims", 100), ("adt", 80), ("auth", 40))
    mismatch_hours: int = 24
    open_hours: int = 48
    claims_lag_days: int = 45
    stale_default_days: int = 30
    readmission_days: int = 30
    post_acute_days: int = 14
    planned_return_days: int = 90
    ed_return_days: int = 7
    fuzzy_threshold: float = 0.85
    low_confidence: float = 0.60
    flag_duplicates: bool = False
    follow_moves: bool = True  # a record sent again may have changed its patient: ids are sought in all buckets
    lookback: tuple[tuple[str, str], ...] = (("default", "24h"), ("adt", "24h"), ("claims", "72h"), ("auth", "24h"))
