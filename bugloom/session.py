"""Sessions for tests and the bench, and the shared folder of a running session."""

import tempfile

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "8", checkpoint_dir: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bugloom")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    folder = tempfile.mkdtemp(prefix="bugloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The rows written once to the shared folder, for steps that read them repeatedly.

    Later steps then neither recompute them nor depend on the executors that did.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder; they stay, as they are read later on."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unnest(df: DataFrame, array: str | Column, index: str, item: str, *keep) -> DataFrame:
    """One row per array element with its position.

    The outer form on purpose: for the inner one the optimizer adds a filter on the array
    below, and so computes the array twice.
    """
    exploded = df.select(*keep, F.posexplode_outer(array).alias(index, item))
    return exploded.filter(F.col(index).isNotNull())


def spread(scan: DataFrame, pieces: int = 1) -> DataFrame:
    """Use all cores for a scan with fewer splits than cores; larger scans stay as they are.

    With ``pieces``, every split is dealt to so many tasks, for narrow rows that cost much: a
    task is then no longer for more splits.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions() * pieces
    return scan.repartition(max(splits, cores)) if splits < cores or pieces > 1 else scan
