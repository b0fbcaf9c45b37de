"""Load one or several sources as defect records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.operators import normalize as N
from bugloom.schema import RECORD_COLUMNS, to_records
from bugloom.session import spread
from bugloom.sources.tracker_csv import read_export
from bugloom.sources.tracker_xml import ENDINGS, read_defects


def path_kind(spark: SparkSession, path: str) -> str | None:
    """'dir', 'file' or None, through the file system that the path names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    return "dir" if fs.getFileStatus(target).isDirectory() else "file"


def load_source(
    spark: SparkSession,
    source: str,
    path: str,
    limit: int | None = None,
    keep_only_bugs: bool = True,
    caps: V.Caps = V.NO_CAPS,
) -> DataFrame:
    """Records of one source: a CSV export, or a folder of XML products.

    A folder is told by what it holds: products with ``reports.xml``, or CSV files, which are
    read as one export; either compressed or not. A folder with neither is an error.
    """
    kind = path_kind(spark, path)
    if kind is None:
        raise FileNotFoundError(f"no export of {source} at {path}")
    if kind == "dir" and _holds(spark, path, f"*/reports{ENDINGS}"):
        defects = N.in_product_order(read_defects(spark, path))
        kept = N.first_rows(defects, limit, F.col("short_desc") != "")
        return to_records(N.normalize_xml_defects(kept, source, caps))
    if kind == "dir" and not _holds(spark, path, "*.csv*"):
        raise ValueError(f"neither CSV files nor products with reports.xml at {path}")
    # A multi-line file is one split: spread its rows before the costly steps.
    rows = spread(read_export(spark, path))
    if source == "apache":
        rows = N.keep_defect_types(rows) if keep_only_bugs else rows
        rows = N.first_rows(rows, limit, N.has_id(rows, V.JIRA_ALIASES))
        return to_records(N.normalize_jira(rows, source, caps))
    rows = N.first_rows(rows, limit, N.has_id(rows, V.BUGZILLA_ALIASES))
    return to_records(N.normalize_bugzilla(rows, source, caps))


def _holds(spark: SparkSession, path: str, pattern: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path, pattern)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def load_all(
    spark: SparkSession,
    paths: dict[str, str],
    limit_per_source: int | None = None,
    skip_missing: bool = False,
) -> DataFrame:
    """Union of sources, each with its own path and limit."""
    loaded = [
        load_source(spark, source, path, limit_per_source)
        for source, path in paths.items()
        if not (skip_missing and path_kind(spark, path) is None)
    ]
    if not loaded:
        return to_records(spark.createDataFrame([], "defect_id string, source string"))
    union = loaded[0]
    for more in loaded[1:]:
        union = union.unionByName(more)
    return union.select(*RECORD_COLUMNS)


def sample_paths(base_dir: str, sources=tuple(V.SAMPLE_FILES)) -> dict[str, str]:
    """Default file names below one folder."""
    return {source: f"{base_dir}/{V.SAMPLE_FILES[source]}" for source in sources}
