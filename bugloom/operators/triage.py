"""Findings derived from parsed submissions and their retrieved defects."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions import traces
from bugloom.functions.logs import total_log_lines
from bugloom.functions.regex import is_blank
from bugloom.functions.vocab_maps import guess_severity
from bugloom.operators.search import search_submissions


def actionable(parsed: DataFrame) -> DataFrame:
    """Gate: blank and unrecognized submissions are not worth an analysis."""
    usable = ~is_blank(F.col("raw_text")) & (F.col("artifact_type") != "unknown")
    return parsed.withColumns(
        {"is_actionable": usable, "severity": guess_severity(F.col("raw_text"))}
    )


def log_findings(parsed: DataFrame) -> DataFrame:
    """What failed: root exception, salient log entries and levels of each submission."""
    salient = F.filter(
        F.coalesce("log_entries", F.array()), lambda e: e["level"].isin(*V.SALIENT_LEVELS)
    )
    return parsed.select(
        "submission_id",
        "artifact_type",
        F.size("exceptions").alias("n_exceptions"),
        F.col("root_cause.exception_type").alias("root_exception"),
        F.when(F.col("root_cause").isNotNull(), traces.summary(F.col("root_cause"))).alias(
            "root_summary"
        ),
        F.transform(salient, lambda e: e["message"]).alias("salient_errors"),
        F.transform(
            salient, lambda e: F.struct(e["timestamp"], e["level"], e["message"])
        ).alias("error_timeline"),
        total_log_lines(F.col("log_level_counts")).alias("n_log_lines"),
        F.col("log_level_counts").alias("level_counts"),
    )


def best_hits(hits: DataFrame, threshold: float = V.DUPLICATE_THRESHOLD) -> DataFrame:
    """Per query: the best hit, and the number of likely duplicates."""
    top = F.max_by(
        F.struct("defect_id", "score", "resolution", "duplicate_of"), F.struct(-F.col("rank"))
    )
    return hits.groupBy("submission_id").agg(
        top.alias("best"),
        F.count_if(F.col("score") >= threshold).alias("n_duplicates"),
    )


def route(
    triaged: DataFrame, hits: DataFrame, threshold: float = V.DUPLICATE_THRESHOLD
) -> DataFrame:
    """Routing of each submission: reject, report as duplicate, or find the root cause.

    A duplicate names the canonical defect: the one its best hit duplicates, if any.
    """
    joined = triaged.join(best_hits(hits, threshold), "submission_id", "left")
    is_duplicate = F.col("is_actionable") & F.coalesce(F.col("n_duplicates") > 0, F.lit(False))
    canonical = F.coalesce(
        F.nullif(F.col("best.duplicate_of"), F.lit("")), F.col("best.defect_id")
    )
    return joined.select(
        "submission_id",
        "artifact_type",
        "severity",
        "is_actionable",
        F.coalesce("n_duplicates", F.lit(0)).alias("n_duplicates"),
        is_duplicate.alias("is_duplicate"),
        F.when(is_duplicate, canonical).alias("canonical_defect"),
        F.col("best.score").alias("best_score"),
        F.when(~F.col("is_actionable"), "reject")
        .when(is_duplicate, "report")
        .otherwise("root_cause")
        .alias("route"),
    )


def fix_notes(
    parsed: DataFrame, kb: DataFrame, k: int = V.TOP_K, embedder=None
) -> DataFrame:
    """Notes of the nearest fixed defects of each submission. The filter precedes ranking."""
    fixed = kb.filter(F.col("resolution").isin(*V.FIXED_RESOLUTIONS))
    hits = search_submissions(
        parsed, fixed, k, embedder=embedder, extra=("resolution_note",)
    )
    return hits.select(
        "submission_id", "rank", "defect_id", "score", "resolution", "resolution_note"
    )
