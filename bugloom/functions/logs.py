"""Log lines: level, timestamp, logger and message."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions.regex import bind, contains_any, extract, java_regex, lstrip, matches, strip

ENTRY_TYPE = "struct<raw:string,timestamp:string,level:string,logger:string,message:string>"


# The first dotted name of a line always starts where a run of word characters does; saying
# so keeps the search linear on long runs.
_LOGGER = V.LOGGER.replace("(?:", r"(?<![\w$])(?:", 1)


def is_log_line(line: Column) -> Column:
    """A level word, and either a timestamp or a leading bracket."""
    return (
        contains_any(line, V.LOG_LEVELS)
        & matches(line, V.LOG_LEVEL)
        & (matches(line, V.TIMESTAMP) | lstrip(line).startswith("["))
    )


def _level(line: Column) -> Column:
    def full_name(word: Column) -> Column:
        case = F
        for short, full in V.LOG_LEVEL_ALIASES.items():
            case = case.when(word == short, full)
        return case.otherwise(word)

    return bind(extract(line, V.LOG_LEVEL, 1), full_name)


def _message(line: Column) -> Column:
    up_to_level = java_regex(r"^.*?" + V.LOG_LEVEL)
    rest = F.regexp_replace(line, up_to_level, "")
    return strip(F.ltrim(rest, F.lit(V.MESSAGE_LEAD)))


def log_entry(line: Column) -> Column:
    """struct of one line that ``is_log_line`` accepts."""
    return F.struct(
        strip(line).alias("raw"),
        F.nullif(extract(line, V.TIMESTAMP, 1), F.lit("")).alias("timestamp"),
        _level(line).alias("level"),
        F.nullif(extract(line, _LOGGER, 1), F.lit("")).alias("logger"),
        _message(line).alias("message"),
    )


def log_entries(lines: Column) -> Column:
    return F.transform(F.filter(lines, is_log_line), log_entry)


def level_counts(entries: Column) -> Column:
    """map<level, count> of an array of entries."""
    levels = F.transform(entries, lambda e: e["level"])
    distinct = F.array_distinct(levels)
    return F.map_from_arrays(
        distinct,
        F.transform(
            distinct, lambda v: F.size(F.filter(entries, lambda e: e["level"] == v))
        ),
    )


def total_log_lines(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0), lambda total, n: total + n)
