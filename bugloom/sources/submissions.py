"""Submission texts: uploaded files as a batch or as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugloom import vocabulary as V

_GLOB = "*.{" + ",".join(V.UPLOAD_EXTENSIONS) + "}"
_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _as_submissions(files: DataFrame) -> DataFrame:
    """The file's path identifies it; bytes that are not UTF-8 become replacement marks."""
    return files.select(
        F.col("path").alias("submission_id"),
        F.element_at(F.split("path", "/"), -1).alias("source_filename"),
        F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8")
        .alias("raw_text"),
    )


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return _as_submissions(
        spark.read.format("binaryFile").option("pathGlobFilter", _GLOB).load(path)
    )


def stream_submissions(spark: SparkSession, path: str) -> DataFrame:
    return _as_submissions(
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("pathGlobFilter", _GLOB)
        .load(path)
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Large log files line by line; unlike whole files these scans split."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("submission_id"), F.col("value").alias("line")
    )
