"""Labelled rows for fitting: held-out folds and a bounded sample."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugloom.llm.common import crc32_remainder, written

FIT_ROWS = 40_000


def sampled_labels(labels: DataFrame, label: str, modulus: int, held: int, most: int = FIT_ROWS):
    """doc_id and label of at most about ``most`` rows outside the held-out fold, written.

    An id with several labels has the largest; rows without id or label are left out. The sample
    is taken by a hash of the id, so it is the same in every run.
    """
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).alias("label"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    own = own.filter(crc32_remainder(F.col("doc_id"), modulus) != held)
    own = written(own.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")), "labels")
    rows = own.count()
    if rows <= most:
        return own
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1_000_000))
    return written(own.filter(share < int(most / rows * 1_000_000)), "label-sample")


def labelled_documents(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, label of the sampled rows: the sample is bounded, so it is broadcast."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.join(F.broadcast(sample), "doc_id")
