"""Submissions table to parsed submissions: one narrow stage, no shuffle.

Input: ``(submission_id, source_filename, raw_text)``. Every step is a native expression over
the row's own text, so the stage scales with the number of input splits and cannot skew on a
key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions import logs, reports, signals, text, traces
from bugloom.functions.language import detect_language
from bugloom.functions.regex import split_lines, unify_newlines
from bugloom.functions.vocab_maps import guess_severity
from bugloom.schema import to_records
from bugloom.session import unnest


def with_lines(submissions: DataFrame) -> DataFrame:
    """Unified newlines, line array and language."""
    return submissions.withColumn(
        "raw_text", unify_newlines(F.coalesce("raw_text", F.lit("")))
    ).withColumns(
        {"lines": split_lines(F.col("raw_text")), "language": detect_language(F.col("raw_text"))}
    )


def with_exceptions(lined: DataFrame, caps: V.Caps = V.NO_CAPS) -> DataFrame:
    return lined.withColumn(
        "exceptions",
        traces.exception_chain(
            F.col("raw_text"), F.col("lines"), F.col("language"), caps.generic_exceptions
        ),
    )


def with_log_entries(lined: DataFrame) -> DataFrame:
    return lined.withColumn("log_entries", logs.log_entries(F.col("lines")))


def with_artifact_type(logged: DataFrame) -> DataFrame:
    return logged.withColumn(
        "artifact_type",
        signals.artifact_type(F.col("raw_text"), F.col("lines"), F.size("log_entries")),
    )


def with_fields(typed: DataFrame, caps: V.Caps = V.NO_CAPS) -> DataFrame:
    """Section fields, looked for only in written reports."""
    none = F.create_map().cast("map<string,string>")
    written = F.col("artifact_type").isin("bug_report", "mixed")
    found = reports.report_fields(
        F.col("raw_text"), F.col("lines"), caps.fallback_title_chars
    )
    return typed.withColumn("bug_fields", F.when(written, found).otherwise(none))


def parse_submissions(submissions: DataFrame, caps: V.Caps = V.NO_CAPS) -> DataFrame:
    """One wide row per submission: type, language, chains, logs, fields, signals, texts.

    Nothing is cut, unless ``caps`` says so.
    """
    staged = with_lines(submissions)
    logged = with_log_entries(with_exceptions(staged, caps))
    staged = with_fields(with_artifact_type(logged), caps)
    first = reports.first_line(F.col("lines"), caps.fallback_title_chars)
    staged = staged.withColumns(
        {
            "key_signals": signals.key_signals(F.col("raw_text"), F.col("exceptions"), caps),
            "title": signals.title(
                F.col("bug_fields"), F.col("exceptions"), first, caps.fallback_title_chars
            ),
        }
    )
    return staged.select(
        "submission_id",
        "source_filename",
        "raw_text",
        "artifact_type",
        "language",
        "exceptions",
        "log_entries",
        logs.level_counts(F.col("log_entries")).alias("log_level_counts"),
        "bug_fields",
        "key_signals",
        "title",
        signals.normalized_text(
            F.col("title"),
            F.col("exceptions"),
            F.col("bug_fields"),
            F.col("key_signals"),
            F.col("raw_text"),
            caps,
        ).alias("normalized_text"),
        text.char_count(F.col("raw_text")).alias("char_count"),
        text.line_count(F.col("raw_text")).alias("line_count"),
        traces.root_cause(F.col("exceptions")).alias("root_cause"),
    )


def submission_records(parsed: DataFrame) -> DataFrame:
    """Parsed submissions as defect records."""
    return to_records(
        parsed.select(
            F.concat(F.lit("submission-"), F.col("submission_id").cast("string")).alias(
                "defect_id"
            ),
            F.lit("user_submission").alias("source"),
            "title",
            F.col("normalized_text").alias("description"),
            guess_severity(F.col("raw_text")).alias("severity"),
            (F.size("exceptions") > 0).alias("has_stack_trace"),
            "language",
            F.col("key_signals").alias("keywords"),
        )
    )


def exceptions_table(parsed: DataFrame) -> DataFrame:
    """One row per exception of a chain."""
    return unnest(parsed, "exceptions", "chain_index", "exception", "submission_id").select(
        "submission_id",
        "chain_index",
        "exception.exception_type",
        "exception.message",
        "exception.is_cause",
        "exception.frames",
        traces.summary(F.col("exception")).alias("summary"),
    )


def frames_table(parsed: DataFrame) -> DataFrame:
    """One row per stack frame."""
    keys = ("submission_id", "chain_index", "exception_type")
    exceptions = exceptions_table(parsed)
    return unnest(exceptions, "frames", "frame_index", "frame", *keys).select(
        *keys, "frame_index", "frame.*"
    )


def log_entries_table(parsed: DataFrame) -> DataFrame:
    return unnest(parsed, "log_entries", "entry_index", "entry", "submission_id").select(
        "submission_id", "entry_index", "entry.*"
    )


def fields_table(parsed: DataFrame) -> DataFrame:
    entries = F.map_entries("bug_fields")
    return unnest(parsed, entries, "at", "entry", "submission_id").select(
        "submission_id", F.col("entry.key").alias("field"), "entry.value"
    )


def log_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Entries of a table of single lines, such as a splittable scan of large log files."""
    kept = lines.filter(logs.is_log_line(F.col(line_col)))
    return kept.withColumn("entry", logs.log_entry(F.col(line_col))).select(
        *[c for c in lines.columns if c != line_col], "entry.*"
    )


def level_histogram(entries: DataFrame, keys: tuple[str, ...] = ("submission_id",)) -> DataFrame:
    """Entries per key and level; partial counts keep a hot key from skewing the shuffle."""
    return entries.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("n"))
