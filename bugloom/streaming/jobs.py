"""Streaming forms of submission matching, knowledge-base upkeep and log counts."""

from collections.abc import Callable
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bugloom import vocabulary as V
from bugloom.operators.codes import Codebook
from bugloom.operators.embed import Embedder
from bugloom.operators.parse import log_lines, parse_submissions
from bugloom.operators.search import flag_duplicates, search_submissions
from bugloom.session import spread, staged
from bugloom.sources.knowledge_base import append_records, read_kb
from bugloom.sources.load import _holds, path_kind


def _run(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _batch_folder(out_path: str, checkpoint: str, batch_id: int) -> str:
    """A folder for one micro-batch of one checkpoint; another checkpoint has others."""
    run = sha1(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    return f"{out_path}/run={run}/batch={batch_id}"


def once_per_id(
    stream: DataFrame, key: str, time_col: str | None = None, within: str | None = None
) -> DataFrame:
    """The first row of each id, by keyed state in the stream's checkpoint.

    Without ``within`` all ids are kept; with it, those of rows up to that long behind the latest
    ``time_col``, so that the state is bounded by the rows of that span.
    """
    if within is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark([key])


def match_submissions(
    stream: DataFrame,
    kb_path: str,
    out_path: str,
    checkpoint: str,
    k: int = V.TOP_K,
    threshold: float = V.DUPLICATE_THRESHOLD,
    embedder: Embedder | None = None,
    once: bool = False,
    book: Codebook | None = None,
    time_col: str | None = None,
    within: str | None = None,
) -> StreamingQuery:
    """Rank similar defects for every arriving submission, once per submission id.

    Seen ids are state of the stream (``once_per_id``), also those without any hit; earlier
    findings of the same checkpoint are not read. Each micro-batch overwrites its own folder,
    named by checkpoint and number, so a batch repeated after a failure leaves its findings once,
    and a new checkpoint on the same output replaces nothing. Submissions with findings of another
    checkpoint are not matched again. The knowledge base is read anew per batch, by its codes if
    ``book`` is given.
    """
    run = _batch_folder(out_path, checkpoint, 0).rpartition("/")[0]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch
        others = [p for p in _run_folders(spark, out_path) if p.rpartition("/")[2] != run.rpartition("/")[2]]
        if others:
            done = spark.read.parquet(*[f"{p}/batch=*" for p in others])
            ids = done.select("submission_id").distinct()
            fresh = fresh.join(ids, "submission_id", "left_anti")
        with staged(parse_submissions(spread(fresh)), "arrived") as parsed:
            hits = search_submissions(parsed, read_kb(spark, kb_path), k, embedder=embedder, book=book)
            flag_duplicates(hits, threshold).write.mode("overwrite").parquet(
                _batch_folder(out_path, checkpoint, batch_id)
            )

    return _run(once_per_id(stream, "submission_id", time_col, within), step, checkpoint, once)


def _run_folders(spark: SparkSession, out_path: str) -> list[str]:
    """Folders of the checkpoints that have stored a batch below an output."""
    target = spark._jvm.org.apache.hadoop.fs.Path(out_path, "run=*/batch=*/_SUCCESS")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or []
    return sorted({s.getPath().getParent().getParent().toString() for s in found})


def read_matches(spark: SparkSession, out_path: str) -> DataFrame | None:
    """Findings of all micro-batches; None before the first one with any."""
    if not _holds(spark, out_path, "run=*/batch=*/_SUCCESS"):
        return None
    return spark.read.parquet(f"{out_path}/run=*/batch=*")


def maintain_kb(
    stream: DataFrame,
    kb_path: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    size: int = V.CHUNK_SIZE,
    overlap: int = V.CHUNK_OVERLAP,
    once: bool = False,
) -> StreamingQuery:
    """Insert arriving records whose defect is absent; a repeated batch finds its ids present."""

    def step(batch: DataFrame, _: int) -> None:
        append_records(spread(batch), kb_path, embedder, size, overlap)

    return _run(stream, step, checkpoint, once)


def level_counts_by_window(
    lines: DataFrame, time_col: str, width: str = "1 hour", late: str | None = None
) -> DataFrame:
    """Log entries per time window and level, for a table or a stream of log lines.

    A stream needs ``late``, the time after which an entry no longer counts. The time column
    must be a timestamp with time zone.
    """
    if lines.isStreaming and late is None:
        raise ValueError("a stream of log lines needs the time after which entries are late")
    timed = lines.withWatermark(time_col, late) if lines.isStreaming else lines
    entries = log_lines(timed)
    return (
        entries.groupBy(F.window(time_col, width).alias("w"), "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "level", "n",
        )
    )


def keep_level_counts(
    counts: DataFrame, out_path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Store a stream's counts as they change, open windows included.

    Every micro-batch overwrites its own folder with the windows it changed; the largest count
    of a window and level is the latest, as counts only grow.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_folder(out_path, checkpoint, batch_id))

    writer = counts.writeStream.foreachBatch(step).outputMode("update")
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_level_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """The count of every window and level: the latest of each checkpoint, and their sum.

    Checkpoints are runs over different lines, such as those of different hosts.
    """
    stored = spark.read.option("basePath", out_path).parquet(f"{out_path}/run=*/batch=*")
    window = ["window_start", "window_end", "level"]
    latest = stored.groupBy("run", *window).agg(F.max("n").alias("n"))
    return latest.groupBy(*window).agg(F.sum("n").alias("n"))
