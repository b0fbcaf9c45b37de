"""Build the knowledge base from tracker exports."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.operators.embed import Embedder
from bugloom.operators.search import search
from bugloom.operators.stats import kb_breakdown, kb_totals, load_totals
from bugloom.sources.knowledge_base import append_records, read_kb, reset_kb
from bugloom.sources.load import load_all


@dataclass
class BuildResult:
    """The table after the build, and lazily computed counts over it."""

    kb: DataFrame
    loaded: DataFrame
    totals: DataFrame
    breakdown: DataFrame
    answers: DataFrame | None = None


def build_kb(
    spark: SparkSession,
    paths: dict[str, str],
    kb_path: str,
    limit: int | None = None,
    reset: bool = False,
    embedder: Embedder | None = None,
    size: int = V.CHUNK_SIZE,
    overlap: int = V.CHUNK_OVERLAP,
    skip_missing: bool = False,
    query: str | None = None,
) -> BuildResult:
    """Load, chunk, embed and append; with ``query``, also search the result once.

    Everything between the scan and the write is lazy, and the number of records in flight is
    not bounded by the driver. Rerunning after a failure completes the table.
    """
    if reset:
        reset_kb(spark, kb_path)
    records = load_all(spark, paths, limit, skip_missing)
    append_records(records, kb_path, embedder, size, overlap)
    kb = read_kb(spark, kb_path)
    answers = None
    if query:
        asked = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("text"))
        answers = search(asked, kb, embedder=embedder)
    return BuildResult(kb, load_totals(kb), kb_totals(kb), kb_breakdown(kb), answers)


def build_real_kb(
    spark: SparkSession,
    paths: dict[str, str],
    kb_path: str,
    limit: int | None = None,
    reset: bool = False,
    embedder: Embedder | None = None,
) -> BuildResult:
    """The same over full exports: absent ones are skipped, each source whole by default."""
    return build_kb(spark, paths, kb_path, limit, reset, embedder, skip_missing=True)
