"""Vocabulary normalization: ordered lookups as native CASE expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions.regex import contains_any, strip


def _first_needle(col: Column, needles, default: str) -> Column:
    low = F.lower(F.coalesce(col, F.lit("")))
    case = F
    for needle, value in needles:
        case = case.when(low.contains(needle), value)
    return case.otherwise(default)


def _exact(col: Column, table: dict, default: str) -> Column:
    case = F
    names_by_value: dict[str, list[str]] = {}
    for name, value in table.items():
        names_by_value.setdefault(value, []).append(name)
    for value, names in names_by_value.items():
        case = case.when(col.isin(names), value)
    return case.otherwise(default)


def map_severity(col: Column) -> Column:
    return _first_needle(col, V.SEVERITY_NEEDLES, "unknown")


def map_status(col: Column) -> Column:
    return _first_needle(col, V.STATUS_NEEDLES, "unknown")


def map_resolution(col: Column) -> Column:
    """Blank and unmatched both mean unresolved."""
    return _first_needle(col, V.RESOLUTION_NEEDLES, "unresolved")


def map_priority(col: Column) -> Column:
    return _exact(F.lower(strip(col)), V.PRIORITY_NAMES, "unknown")


def map_jira_severity(col: Column) -> Column:
    return _exact(F.lower(col), V.JIRA_SEVERITY_NAMES, "unknown")


def guess_severity(text: Column) -> Column:
    """First group with a cue anywhere in the text; cues also match inside words."""
    low = F.lower(text)
    case = F
    for severity, cues in V.SEVERITY_CUES:
        case = case.when(contains_any(low, cues), severity)
    return case.otherwise("unknown")


def is_resolved_fixed(resolution: Column) -> Column:
    return F.coalesce(resolution.isin(*V.FIXED_RESOLUTIONS), F.lit(False))
