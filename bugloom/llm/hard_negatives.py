"""Hard negatives: rows of another label that score almost as high as an anchor's positives.

Candidates are dealt to cover trees of bounded size by the nearest of a few pivots, so that a tree
holds rows that lie together; a pivot with many rows has as many trees as it needs, dealt by a
hash of the id. Trees are built once and written. Anchors come in blocks, and every block meets
every group of trees in a task of its own; a task returns the best rows per query, which are
ranked in one shuffle of those few. The positives are searched first, then the windows of scores
that they open. Nothing is broadcast or collected but the pivots and the counts of their cells.
"""


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugloom.llm.common import written
from bugloom.llm.cover_tree import Search, Tree, build

POSITIVES, NEGATIVES = 5, 10
# A negative's share of its positive's score, in hundredths.
LEAST_SHARE, MOST_SHARE = 30, 90
PIVOTS, PIVOT_SAMPLE = 64, 2048
TREE_ROWS = 2048
# Trees that a task searches one after another for one block of anchors.
FEWEST_TREES, MOST_TREES = 4, 64
BLOCK_ANCHORS = 16_384
TREE_FIELDS = {
    "vectors": "<f4", "ids": "<i8", "labels": "<i8", "centers": "<i8", "radii": "<f8",
    "parents": "<i8", "levels": "<i8", "first": "<i8", "last": "<i8", "leaf": "|b1",
}


def candidates(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vec_id, label, vector of integers, for the rows that take part.

    Left out are rows with a null id, label or vector and those with a component that is null or
    not finite. Of rows that share an id, the one with the least label and vector counts.
    """
    as_double = F.transform(embedding, lambda x: x.cast("double"))
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        as_double.alias("vector"),
    ).filter("vec_id is not null and label is not null and vector is not null")
    broken = F.exists(
        "vector",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    # What ``exists`` says of nulls depends on a setting; a null counts as broken here.
    whole = rows.filter(~F.coalesce(broken, F.lit(True)))
    scaled = F.transform("vector", lambda x: F.floor(x * 256).cast("bigint"))
    one = whole.select("vec_id", F.struct("label", scaled.alias("vector")).alias("own"))
    return one.groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.*")


def relabelled(rows: DataFrame) -> DataFrame:
    """Labels of ids divisible by 7 move on by one, of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.withColumn("label", moved)


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows as doubles; shorter vectors end in zeros, which add nothing to a product."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def _pivots(rows: DataFrame, width: int) -> np.ndarray:
    """Pivots picked farthest first from a sample of bounded size."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("vector")
    points = _matrix([r["vector"] for r in sample.collect()], width)
    chosen, nearest = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _cell(pivots: np.ndarray, width: int) -> Column:
    """The number of the nearest pivot."""

    @F.pandas_udf(T.IntegerType())
    def nearest(vectors: pd.Series) -> pd.Series:
        points = _matrix(vectors.tolist(), width)
        away = (pivots**2).sum(1)[None] - 2 * points @ pivots.T
        return pd.Series(away.argmin(1).astype(np.int32))

    return nearest("vector")


def _pack(tree: Tree) -> list[bytes]:
    # Components beyond 2^24 don't fit single precision; they are stored wide.
    return [np.ascontiguousarray(getattr(tree, f)).astype(t).tobytes() for f, t in TREE_FIELDS.items()]


def _unpack(row: dict, width: int) -> Tree:
    parts = {f: np.frombuffer(row[f], t) for f, t in TREE_FIELDS.items()}
    parts["vectors"] = parts["vectors"].reshape(-1, width).astype(float)
    return Tree(**parts)


def trees(rows: DataFrame, width: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """A row per tree: ``tree`` (0, 1, ...) and its arrays."""
    placed = written(rows.withColumn("cell", _cell(_pivots(rows, width), width)), "tree-input")
    counts = placed.groupBy("cell").count().collect()  # at most PIVOTS rows
    number, spans = 0, []
    for r in sorted(counts):
        parts = -(-r["count"] // tree_rows)
        spans.append((r["cell"], number, parts))
        number += parts
    cells = F.create_map(*[F.lit(x) for c, n, p in spans for x in (c, (n << 32) | p)])
    span = cells[F.col("cell")]
    mixed = F.pmod(F.xxhash64("vec_id"), span.bitwiseAND((1 << 32) - 1))
    schema = "tree bigint, " + ", ".join(f"{f} binary" for f in TREE_FIELDS)
    names = ["tree", *TREE_FIELDS]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        vectors = _matrix(table.column("vector").to_pylist(), width)
        if np.abs(vectors).max(initial=0.0) > 1 << 24:
            raise ValueError("components beyond 2^16 can't be scored exactly")
        tree = build(vectors, table.column("vec_id").to_numpy(), table.column("label").to_numpy())
        row = [pa.array([table.column("tree")[0].as_py()], pa.int64())]
        row += [pa.array([b], pa.binary()) for b in _pack(tree)]
        return pa.Table.from_arrays(row, names=names)

    dealt = placed.withColumn("tree", F.shiftright(span, 32) + mixed)
    grouped = dealt.select("tree", "vec_id", "label", "vector").groupBy("tree")
    return written(grouped.applyInArrow(run, schema), "cover-trees")


QUERY = "anchor_id bigint, positive_id bigint, found_id bigint, score bigint"
_QUERY_NAMES = ["anchor_id", "positive_id", "found_id", "score"]


def _query_arrays(table: pa.Table, width: int):
    """Anchors of a block (ids, labels, vectors) and queries: anchor's index, positive, window."""
    ids, labels = (table.column(c).to_numpy() for c in ("anchor_id", "label"))
    vectors = _matrix(table.column("vector").to_pylist(), width)
    of, positive, low, high = [], [], [], []
    for k, windows in enumerate(table.column("windows").to_pylist()):
        for w in windows:
            of.append(k)
            positive.append(w["positive_id"])
            low.append(-np.inf if w["low"] is None else w["low"])
            high.append(np.inf if w["high"] is None else w["high"])
    return ids, labels, vectors, np.array(of, np.int64), positive, np.array(low), np.array(high)


def _searched(queries: DataFrame, grown: DataFrame, width: int, k: int, same: bool,
              block_anchors: int) -> DataFrame:
    """The best ``k`` rows of every query in every group of trees.

    ``queries`` are anchor_id, label, vector and windows (positive_id, low, high), a row per anchor.
    """
    spark = queries.sparkSession
    n_trees, n_anchors = grown.count(), queries.count()
    per_group = min(max(n_trees // (8 * spark.sparkContext.defaultParallelism), FEWEST_TREES), MOST_TREES)
    groups, blocks = max(1, -(-n_trees // per_group)), max(1, -(-n_anchors // block_anchors))
    cell = ["_block", "_group"]
    asked = queries.withColumns({
        "_block": F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"),
        "_group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))),
    })
    there = grown.withColumns({
        "_group": F.pmod("tree", F.lit(groups)).cast("int"),
        "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
    })
    empty = pa.table({n: pa.array([], pa.int64()) for n in _QUERY_NAMES})

    def run(block: pa.Table, group: pa.Table) -> pa.Table:
        if block.num_rows == 0 or group.num_rows == 0:
            return empty
        ids, labels, vectors, of, positive, low, high = _query_arrays(block, width)
        if not len(of):
            return empty
        own = [_unpack(row, width) for row in group.to_pylist()]
        found = Search(own, vectors, ids, labels, of, low, high, k, same).run()
        at, rows, scores = found.results()
        return pa.table({
            "anchor_id": pa.array(ids[of[at]]),
            "positive_id": pa.array([positive[q] for q in at], pa.int64()),
            "found_id": pa.array(rows), "score": pa.array(scores),
        })

    return asked.groupBy(*cell).cogroup(there.groupBy(*cell)).applyInArrow(run, QUERY)


def _best(found: DataFrame, k: int, *query: str) -> DataFrame:
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mined(rows: DataFrame, anchor: Column, k_positives: int = POSITIVES, k: int = NEGATIVES,
          tree_rows: int = TREE_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` are vec_id (unique), label and vector (integers); ``anchor`` picks the anchors among
    them. Of each anchor its first ``k_positives`` other rows of its label are positives; of each
    positive the first ``k`` rows of other labels with 30 to 90 hundredths of its score are
    negatives. Higher scores come first, ties by the smaller id. Vectors of unequal lengths are
    compared as if the shorter ended in zeros.
    """
    rows = written(rows, "candidates")
    width = rows.select(F.max(F.size("vector"))).first()[0]
    if width is None:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
            "positive_score bigint, negative_score bigint")
    width = max(1, width)
    grown = trees(rows, width, tree_rows)
    anchors = rows.filter(anchor).select(F.col("vec_id").alias("anchor_id"), "label", "vector")
    no_number = F.lit(None).cast("bigint")
    whole = F.struct(
        no_number.alias("positive_id"), no_number.alias("low"), no_number.alias("high")
    )
    first = anchors.withColumn("windows", F.array(whole))
    found = _searched(first, grown, width, k_positives, True, block_anchors).drop("positive_id")
    positives = written(_best(found, k_positives, "anchor_id").select(
        "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")
    ), "positives")
    # Whole scores between the shares; a negative score opens no window.
    score = F.col("positive_score")
    window = F.struct(
        "positive_id",
        F.ceil(score * LEAST_SHARE / F.lit(100)).cast("bigint").alias("low"),
        F.floor(score * MOST_SHARE / F.lit(100)).cast("bigint").alias("high"),
    )
    asked = positives.filter(score >= 0).groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(window)).alias("windows")  # at most k_positives of them
    )
    second = anchors.join(asked, "anchor_id")
    hits = _searched(second, grown, width, k, False, block_anchors)
    return _best(hits, k, "anchor_id", "positive_id").join(
        positives, ["anchor_id", "positive_id"]
    ).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


