"""XML tracker exports: one folder per product, one file per report attribute, compressed or not."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions.regex import strip
from bugloom.sources.tracker_csv import POSITION, position

_REPORT = "_id string, opening_time string, reporter string"
_UPDATES = "_id string, update array<struct<what:array<string>>>"
# Endings of files: plain, and those of Hadoop's codecs.
ENDINGS = "{.xml,.xml.gz,.xml.bz2,.xml.zst,.xml.lz4,.xml.snappy,.xml.deflate}"


def _scan(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of ``<product>/<name>.xml`` in all products, not of files beside the folders.

    Compressed files have the ending of their codec after that.
    """
    root = root.rstrip("/")
    # File paths come URL-encoded, but for plus signs.
    folders = F.split(F.replace(F.col(f"{POSITION}.file"), F.lit("+"), F.lit("%2B")), "/")
    return (
        spark.read.format("xml")
        .options(rowTag="report", pathGlobFilter=f"{name}{ENDINGS}")
        .schema(schema)
        .load(f"{root}/*")
        .withColumn(POSITION, position())
        .withColumn("product", F.url_decode(F.element_at(folders, -2)))
        .filter(F.url_decode(F.element_at(folders, -3)) == root.split("/")[-1])
        .filter(F.col("_id") != "")
    )


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """``(product, id, opening_time, reporter)``; absent values are ''."""
    return _scan(spark, root, "reports", _REPORT).select(
        "product",
        F.col("_id").alias("id"),
        F.coalesce("opening_time", F.lit("")).alias("opening_time"),
        F.coalesce("reporter", F.lit("")).alias("reporter"),
        POSITION,
    )


def read_attribute(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``(product, id, value)``: the last update of each report, stripped."""
    whats = F.flatten(
        F.transform(
            "update",
            lambda u: F.coalesce(
                F.transform(u["what"], lambda w: F.coalesce(w, F.lit(""))),
                F.array().cast("array<string>"),
            ),
        )
    )
    return (
        _scan(spark, root, name, _UPDATES)
        .select(
            "product",
            F.col("_id").alias("id"),
            strip(F.try_element_at(whats, F.lit(-1))).alias("value"),
            POSITION,
        )
        .filter(F.col("value").isNotNull())
    )


def read_defects(
    spark: SparkSession, root: str, attributes: tuple[str, ...] = V.XML_ATTRIBUTES
) -> DataFrame:
    """Reports with their attributes: one row per (product, id), last value wins.

    Instead of one join per attribute, all files are stacked and folded by a single
    aggregation, whose partial step collapses repeated ids before the shuffle.
    """
    reports = read_reports(spark, root).select(
        "product",
        "id",
        F.lit("reports").alias("kind"),
        F.struct("opening_time", "reporter").alias("report"),
        F.lit(None).cast("string").alias("value"),
        POSITION,
    )
    stacked = reports
    for name in attributes:
        stacked = stacked.unionByName(
            read_attribute(spark, root, name).withColumn("kind", F.lit(name)),
            allowMissingColumns=True,
        )

    def last(column: str, kind: str) -> F.Column:
        of_kind = F.col("kind") == kind
        return F.max_by(F.when(of_kind, F.col(column)), F.when(of_kind, F.col(POSITION)))

    folded = stacked.groupBy("product", "id").agg(
        last("report", "reports").alias("report"),
        F.min(F.when(F.col("kind") == "reports", F.col(POSITION))).alias(POSITION),
        *[F.coalesce(last("value", name), F.lit("")).alias(name) for name in attributes],
    )
    return folded.filter(F.col("report").isNotNull()).select(
        "product", "id", "report.*", *attributes, POSITION
    )
