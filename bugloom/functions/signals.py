"""Artifact type, retrieval signals and the text used for retrieval."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions.regex import at_most, bind, first_items, java_regex, strip
from bugloom.functions.traces import looks_like_trace, summary
from bugloom.functions.reports import has_prose


def artifact_type(text: Column, lines: Column, log_lines: Column) -> Column:
    """Type of a submission, given its number of log lines."""
    full = F.size(F.filter(lines, lambda line: strip(line) != ""))
    marks = F.struct(
        looks_like_trace(text).alias("trace"),
        has_prose(text, lines).alias("prose"),
        (full == 0).alias("blank"),
        ((log_lines >= 3) & (log_lines / F.greatest(full, F.lit(1)) >= 0.25)).alias("log"),
    )
    return bind(
        marks,
        lambda m: F.when(m["blank"], "unknown")
        .when(m["prose"] & m["trace"], "mixed")
        .when(m["log"], "error_log")
        .when(m["trace"], "stack_trace")
        .when(m["prose"], "bug_report")
        .otherwise("unknown"),
    )


# A file name can only start at the first word character of a run of name characters: what
# follows in the run is part of the same, longest name. Saying so keeps the search linear.
_FILE_NAME = V.FILE_NAME.replace(
    r"\b[\w./-]+\.", r"(?<![\w./-])[./-]*+(\w[\w./-]*\.", 1
) + ")"


# A code starts with one of these, each a word character: elsewhere no boundary is looked for.
_ERROR_CODE = r"(?=[OSEHes0])" + V.ERROR_CODE


def _all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java_regex(pattern)), F.lit(group))


def _exception_signals(exception: Column, most_frames: int | None) -> Column:
    frames = first_items(exception["frames"], most_frames)
    places = F.transform(
        frames,
        lambda f: F.concat_ws(
            ".", F.nullif(f["module"], F.lit("")), F.nullif(f["function"], F.lit(""))
        ),
    )
    return F.concat(F.array(exception["exception_type"]), places)


def key_signals(text: Column, exceptions: Column, caps: V.Caps = V.NO_CAPS) -> Column:
    """Exception types and their frames, error codes, file names: first spelling of each."""
    found = F.concat(
        F.flatten(F.transform(exceptions, lambda e: _exception_signals(e, caps.signal_frames))),
        _all_matches(text, _ERROR_CODE),
        first_items(_all_matches(text, _FILE_NAME, 1), caps.signal_files),
    )
    clean = F.filter(F.transform(found, strip), lambda s: s != "")

    def first_spellings(signals: Column) -> Column:
        return bind(
            F.transform(signals, F.lower),
            lambda low: F.transform(
                first_items(F.array_distinct(low), caps.signals),
                lambda key: F.get(signals, F.array_position(low, key).cast("int") - 1),
            ),
        )

    return bind(clean, first_spellings)


def title(
    fields: Column, exceptions: Column, lines_title: Column, max_chars: int | None = None
) -> Column:
    """Summary field, else the first exception, else the first line."""
    first = F.get(exceptions, F.lit(0))
    return F.coalesce(
        F.nullif(fields["summary"], F.lit("")),
        F.nullif(at_most(summary(first), max_chars), F.lit("")),
        lines_title,
    )


def normalized_text(
    title_col: Column,
    exceptions: Column,
    fields: Column,
    signals: Column,
    text: Column,
    caps: V.Caps = V.NO_CAPS,
) -> Column:
    """The focused text used for retrieval."""

    def exception_lines(exception: Column) -> Column:
        top = F.array_compact(
            F.transform(
                first_items(exception["frames"], caps.signal_frames),
                lambda f: F.nullif(f["function"], F.lit("")),
            )
        )
        path = F.when(F.size(top) > 0, F.concat(F.lit("in "), F.array_join(top, " -> ")))
        return F.array_compact(F.array(summary(exception), path))

    sections = [
        F.concat(F.lit(name.replace("_", " ") + ": "), F.nullif(fields[name], F.lit("")))
        for name in V.NORMALIZED_FIELDS
    ]
    parts = F.array_compact(
        F.concat(
            F.array(F.nullif(title_col, F.lit(""))),
            F.flatten(F.transform(exceptions, exception_lines)),
            F.array(
                *sections,
                F.when(
                    F.size(signals) > 0,
                    F.concat(F.lit("signals: "), F.array_join(signals, ", ")),
                ),
            ),
        )
    )
    body = bind(
        parts,
        lambda p: F.when(F.size(p) > 0, F.array_join(p, "\n")).otherwise(
            at_most(text, caps.fallback_text_chars)
        ),
    )
    return at_most(body, caps.normalized_chars)
