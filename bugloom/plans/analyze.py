"""Analyze a table of submissions against the knowledge base."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.operators.codes import Codebook
from bugloom.operators.embed import Embedder
from bugloom.operators.parse import parse_submissions
from bugloom.operators.search import flag_duplicates, search_submissions
from bugloom.operators.triage import actionable, fix_notes, log_findings, route


@dataclass
class Analysis:
    """The tables of one analysis."""

    parsed: DataFrame
    hits: DataFrame
    findings: DataFrame
    routing: DataFrame
    notes: DataFrame


def analyze(
    submissions: DataFrame,
    kb: DataFrame,
    out_path: str,
    k: int = V.TOP_K,
    threshold: float = V.DUPLICATE_THRESHOLD,
    embedder: Embedder | None = None,
    book: Codebook | None = None,
) -> Analysis:
    """Parse, gate, retrieve, flag duplicates, and look for fixes of what is new.

    Rejected submissions skip retrieval; duplicates skip the search for fixes. Every step is
    written below ``out_path`` and read by the next ones, so that nothing is computed twice
    and a lost executor costs no more than its own tasks. With ``book`` the similar defects are
    found by the stored codes of the chunks.
    """
    spark = submissions.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out_path}/{name}")

    parsed = stored(actionable(parse_submissions(submissions)), "parsed")
    kept = parsed.filter("is_actionable")
    found = search_submissions(kept, kb, k, embedder=embedder, book=book)
    hits = stored(flag_duplicates(found, threshold), "hits")
    routing = stored(route(parsed, hits, threshold), "routing")
    new = routing.filter(F.col("route") == "root_cause").select("submission_id")
    fresh = kept.join(new, "submission_id", "left_semi")
    notes = stored(fix_notes(fresh, kb, k, embedder), "notes")
    return Analysis(parsed, hits, log_findings(parsed), routing, notes)
