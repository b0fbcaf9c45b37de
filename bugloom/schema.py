"""Record schemas and the projections that every stage agrees on."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugloom.functions.regex import strip

RECORD_COLUMNS = (
    "defect_id", "source", "project", "component", "title", "description", "severity",
    "priority", "status", "resolution", "duplicate_of", "resolution_note", "has_stack_trace",
    "language", "keywords", "reporter", "assignee", "created_at", "resolved_at", "url",
)
_OTHER_TYPES = {
    "has_stack_trace": T.BooleanType(), "keywords": T.ArrayType(T.StringType()),
}
RECORD_SCHEMA = T.StructType(
    [T.StructField(c, _OTHER_TYPES.get(c, T.StringType())) for c in RECORD_COLUMNS]
)
METADATA_COLUMNS = (
    "defect_id", "source", "project", "component", "title", "severity", "priority", "status",
    "resolution", "duplicate_of", "has_stack_trace", "language", "keywords", "url",
)
CHUNK_COLUMNS = (
    "chunk_id", "text", *METADATA_COLUMNS, "resolution_note", "created_at", "chunk_index",
    "n_chunks",
)
ENUMERATIONS = ("severity", "priority", "status", "resolution")


def to_records(df: DataFrame) -> DataFrame:
    """Complete a partial record table: absent columns get the model's defaults."""

    def column(field: T.StructField) -> Column:
        name = field.name
        if name in df.columns:
            return F.col(name).cast(field.dataType).alias(name)
        if name in ENUMERATIONS:
            value = F.lit("unknown")
        elif name == "has_stack_trace":
            value = F.lit(False)
        elif name == "keywords":
            value = F.array()
        elif name in ("duplicate_of", "language"):
            value = F.lit(None)
        else:
            value = F.lit("")
        return value.cast(field.dataType).alias(name)

    return df.select(*[column(f) for f in RECORD_SCHEMA.fields])


def combined_text() -> Column:
    """Text of a record that gets embedded; the title appears twice to weigh more."""
    title, source = F.coalesce(F.col("title"), F.lit("")), F.col("source")

    def unless_blank(value: Column, line: Column) -> Column:
        return F.when(value != "", line)

    lines = [
        F.concat(F.lit("["), source, F.lit("] "), title),
        title,
        F.coalesce(F.col("description"), F.lit("")),
        unless_blank(
            F.col("resolution_note"), F.concat(F.lit("Resolution: "), F.col("resolution_note"))
        ),
        unless_blank(F.col("component"), F.concat(F.lit("Component: "), F.col("component"))),
    ]
    return F.concat_ws("\n", *[F.when(strip(line) != "", line) for line in lines])


def metadata_columns() -> list[Column]:
    """The scalar projection of a record: blank text becomes NULL, keywords one string."""

    def column(name: str) -> Column:
        if name == "has_stack_trace":
            return F.col(name)
        value = F.array_join("keywords", ", ") if name == "keywords" else F.col(name)
        return F.nullif(value, F.lit("")).alias(name)

    return [column(name) for name in METADATA_COLUMNS]


def to_metadata(records: DataFrame) -> DataFrame:
    return records.select(*metadata_columns())
