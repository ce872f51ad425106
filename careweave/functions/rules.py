"""Small condition languages, compiled to columns. Unknown syntax is false."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from careweave import config


#: Date, or date and time, of ISO 8601, with separators or without; no reduced dates.
ISO = r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:\D(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def parse_ts(value: Column, kind: str = "string") -> Column:
    """ISO text, date or timestamp to a timestamp in the session's zone (UTC); else null.

    ``kind`` is the column's type: dates and timestamps need no reading. Text that isn't a
    whole date (a year, a time of day) is null, whatever else could be made of it."""
    if kind in ("timestamp", "date", "timestamp_ntz"):
        return value.cast("timestamp")
    text = F.trim(value.cast("string"))
    part = F.split(F.regexp_replace(text, ISO, "$1,$3,$4,$5,$7,$8,$9,$10"), ",")
    two = lambda i: F.when(part[i] == "", "00").otherwise(part[i])
    zone = F.regexp_replace(part[7], r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    zone = F.when(F.length(zone) == 4, F.concat(zone, F.lit("00"))).otherwise(zone)
    whole = F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit(" "), two(3), F.lit(":"), two(4), F.lit(":"), two(5), F.lit("."), two(6), zone)
    return F.when(F.regexp_like(text, F.lit(ISO)), F.try_to_timestamp(whole))


def named(**fields: Column) -> Column:
    """A struct whose names hold inside lambda functions too."""
    return F.named_struct(*(x for name, c in fields.items() for x in (F.lit(name), c)))


def equalities(text: str) -> Column:
    """``f == 'v' AND g == 'w'``: literal comparison after trimming; null is false."""
    parts = []
    for part in re.split(r"\s+AND\s+", text.strip()):
        m = re.fullmatch(r"\s*(\w+)\s*==\s*'([^']*)'\s*", part)
        if not m:
            return F.lit(False)
        parts.append(F.coalesce(F.trim(F.col(m[1]).cast("string")) == m[2], F.lit(False)))
    return reduce(Column.__and__, parts)


_TOKEN = re.compile(r"\s*(?:(\w+)|'([^']*)'|\"([^\"]*)\"|(==|[=(),]))")


def _condition(text: str) -> tuple[str, str, list[str]] | None:
    """(column, operator, values) of ``f = 'v'``, ``f LIKE 'v'`` or ``f IN (v, 'w')``."""
    words, at = [], 0
    while m := _TOKEN.match(text, at):
        words.append((m.lastindex in (2, 3), m[m.lastindex]))
        at = m.end()
    if text[at:].strip() or len(words) < 3 or words[0][0]:
        return None
    (_, column), (_, operator), *rest = words
    operator = operator.upper()
    if operator in ("=", "LIKE"):
        return (column, operator, [rest[0][1]]) if len(rest) == 1 and rest[0][0] else None
    marks = [v for quoted, v in rest if not quoted and v in "(),"]
    if operator == "IN" and len(rest) > 2 and len(rest) % 2 and marks == ["(", *[","] * (len(rest) // 2 - 1), ")"] and rest[0][1] == "(" and rest[-1][1] == ")":
        return column, operator, [v for _, v in rest[1::2]]
    return None


def type_in(text: str | None, event_type: Column) -> Column:
    """``event_type IN ('A', 'B')``."""
    found = _condition(text or "")
    return F.coalesce(event_type.isin(*found[2]), F.lit(False)) if found and found[:2] == ("event_type", "IN") else F.lit(False)


def class_rule(text: str) -> Column:
    """``f LIKE 'x%'`` (percent signs at the ends only), ``f IN (...)``, ``f = 'v'``."""
    found = _condition(text)
    if not found:
        return F.lit(False)
    column, operator, values = found
    value = F.col(column).cast("string")
    if operator == "LIKE":
        core = values[0].strip("%")
        tests = {(True, True): value.contains, (True, False): value.endswith, (False, True): value.startswith, (False, False): value.__eq__}
        met = tests[values[0].startswith("%"), values[0].endswith("%")](core)
    else:
        met = value.isin(*values)
    return F.coalesce(met, F.lit(False))


def first_match(rules: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for condition, value in reversed(rules):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def mapped(code: Column, values: dict[str, str], otherwise: Column | None = None) -> Column:
    return first_match([(code == k, v) for k, v in values.items()], otherwise)


def normal_class(patient_class: Column, event_type: Column) -> Column:
    """OBS_* and ED_* events decide; else the known words; else null."""
    word = F.lower(F.trim(patient_class))
    known = [(word.isin(*words), name) for name, words in config.CLASS_WORDS.items()]
    return first_match([(event_type.startswith("OBS_"), "observation"), (event_type.startswith("ED_"), "ed"), *known])


def normal_name(name: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """Comparable form of a facility name; the empty string for a blank one."""
    out = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[.'`,]", "")
    out = F.trim(F.regexp_replace(F.replace(out, F.lit("-"), F.lit(" ")), r"\s+", " "))
    out = _spelt_out(out, config.ABBREVIATIONS if abbreviations is None else abbreviations)
    after = "|".join(config.PRESERVED_WORDS)
    kept_words = rf"(?:^| )((?:{after})(?: (?:{after}))*)$"
    return let(out, lambda x: F.trim(F.concat_ws(" ", let(F.trim(F.regexp_replace(x, kept_words, "")), _without_suffix), F.regexp_extract(x, kept_words, 1))))


def _spelt_out(text: Column, table: dict[str, str]) -> Column:
    """Abbreviations in full: phrases where they stand, then all words at once by a map."""
    words = {k: v for k, v in table.items() if " " not in k}
    for phrase in sorted(table.keys() - words.keys(), key=len, reverse=True):
        text = F.regexp_replace(text, rf"\b{re.escape(phrase)}\b", table[phrase])
    if not words:
        return text
    full = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.array_join(F.transform(F.split(text, r"\b"), lambda w: F.coalesce(full[w], w)), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not copied into each place."""
    return F.transform(F.array(value), use)[0]


def _without_suffix(core: Column) -> Column:
    short = core
    for ending in reversed(config.GENERIC_SUFFIXES):
        cut = F.trim(F.substring(core, F.lit(1), F.length(core) - len(ending)))
        short = F.when(core.endswith(ending) & (cut != ""), cut).otherwise(short)
    return short


def episode_type(first_code: Column, drg: Column) -> Column:
    """DRG ranges first, then prefixes of the first diagnosis code."""
    number = drg.try_cast("int")
    by_drg = [(reduce(Column.__or__, [number.between(a, b) for a, b in ranges]), name) for name, ranges in config.DRG_RANGES.items()]
    code = F.replace(F.upper(first_code), F.lit("."), F.lit(""))
    by_code = [(reduce(Column.__or__, [code.startswith(p) for p in prefixes]), name) for name, prefixes in config.DIAGNOSIS_PREFIXES.items()]
    return first_match([*by_drg, *by_code], F.lit("unclassified"))
