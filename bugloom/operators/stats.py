"""Counts over the knowledge base."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kb_totals(chunks: DataFrame) -> DataFrame:
    """One row: chunks, unique defects, chunks with a stack trace."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_distinct("defect_id").alias("unique_defects"),
        F.count_if(F.coalesce("has_stack_trace", F.lit(False))).alias("with_stack_trace"),
    )


def kb_breakdown(
    chunks: DataFrame, columns=("source", "severity", "resolution"), per: str = "chunk"
) -> DataFrame:
    """``(dimension, value, n)`` of every column at once; absent values count as '?'.

    ``per='defect'`` counts each defect once instead of once per chunk.
    """
    known = chunks.select(
        "defect_id",
        *[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in columns],
    )
    n = F.count(F.lit(1)) if per == "chunk" else F.count_distinct("defect_id")
    grouped = known.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns])
    dimension = F
    for c in columns:
        dimension = dimension.when(F.col(c).isNotNull(), c)
    return grouped.agg(n.alias("n")).select(
        dimension.alias("dimension"), F.coalesce(*columns).alias("value"), "n"
    )


def load_totals(chunks: DataFrame) -> DataFrame:
    """Records and chunks per source."""
    return chunks.groupBy("source").agg(
        F.count_distinct("defect_id").alias("records"), F.count(F.lit(1)).alias("chunks")
    )
