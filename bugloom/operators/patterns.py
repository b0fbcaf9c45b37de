"""Patterns across many defects."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def defect_cube(records: DataFrame) -> DataFrame:
    """Defects by source, component and month of creation, with all subtotals.

    Subtotal rows have NULL in the columns they sum over; ``level`` tells which.
    """
    known = records.select(
        F.coalesce(F.nullif("source", F.lit("")), F.lit("?")).alias("source"),
        F.coalesce(F.nullif("component", F.lit("")), F.lit("?")).alias("component"),
        F.coalesce(F.nullif(F.substring("created_at", 1, 7), F.lit("")), F.lit("?")).alias(
            "month"
        ),
        "has_stack_trace",
    )
    return known.cube("source", "component", "month").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("defects"),
        F.count_if("has_stack_trace").alias("with_stack_trace"),
    )


def exception_patterns(exceptions: DataFrame) -> DataFrame:
    """Submissions and occurrences per exception type, of ``exceptions_table``."""
    return exceptions.groupBy("exception_type").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_distinct("submission_id").alias("submissions"),
        F.count_if("is_cause").alias("as_cause"),
    )


def duplicate_families(records: DataFrame) -> DataFrame:
    """Size of each family of duplicates: the linked-to defect and those that link to it.

    ``known`` tells whether the linked-to defect is itself in the table. Links are counted
    before the join, so that a defect with very many duplicates is one row there.
    """
    links = (
        records.filter("duplicate_of is not null and duplicate_of <> ''")
        .select("defect_id", F.col("duplicate_of").alias("canonical"))
        .groupBy("canonical")
        .agg(F.count_distinct("defect_id").alias("duplicates"))
    )
    originals = (
        records.join(
            links.select(F.col("canonical").alias("defect_id")), "defect_id", "left_semi"
        )
        .groupBy(F.col("defect_id").alias("canonical"))
        .agg(F.max("title").alias("title"))
    )
    return links.join(originals, "canonical", "left").select(
        "canonical",
        F.coalesce("title", F.lit("")).alias("title"),
        "duplicates",
        F.col("title").isNotNull().alias("known"),
    )
