"""An approximate index: product-quantised codes stored with every chunk.

A codebook is learnt on a bounded sample: coarse cells, and per group of ``PART`` components up to
256 values of what a vector differs by from its cell's center. A chunk's code, two bytes for
the cell and one per part, is a fifteenth of its vector in bytes and stands for it in the scan: all
codes are read, none skipped. The best of a query by codes, its shortlist, are scored by their
vectors. Chunks without a code (stored before there was a codebook) are scored by theirs.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 16_384
CELLS, PART, VALUES = 64, 4, 256
ROUNDS = 12
# Chunks rescored per neighbour asked for.
SHORTLIST = 20


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 8192):
        part = rows[at:at + 8192]
        out[at:at + 8192] = ((centers**2).sum(1)[None] - 2 * part @ centers.T).argmin(1)
    return out


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """At most ``k`` centers; those without rows are dropped."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= k:
        return distinct
    centers = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = _nearest(rows, centers)
        counts = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        centers = sums[counts > 0] / counts[counts > 0, None]
    return centers


@dataclass
class Codebook:
    """Coarse centers, and a table of values for each part of the rest."""

    centers: np.ndarray
    parts: list[np.ndarray]

    @property
    def dim(self) -> int:
        return self.centers.shape[1]

    @property
    def code_bytes(self) -> int:
        return 2 + len(self.parts)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """Codes as a matrix of bytes."""
        cells = _nearest(rows, self.centers)
        rest = rows - self.centers[cells]
        columns = [cells & 255, cells >> 8]
        at = 0
        for values in self.parts:
            columns.append(_nearest(rest[:, at:at + values.shape[1]], values))
            at += values.shape[1]
        return np.stack(columns, 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        cells = codes[:, 0].astype(np.int64) | codes[:, 1].astype(np.int64) << 8
        rest = [values[codes[:, 2 + k]] for k, values in enumerate(self.parts)]
        return (self.centers[cells] + np.concatenate(rest, 1)).astype("float32")

    def vectors(self, column: pa.Array) -> np.ndarray:
        """What a column of codes stands for."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        data = b"".join(column.to_pylist())
        return self.decode(np.frombuffer(data, np.uint8).reshape(len(column), self.code_bytes))


def learn(kb: DataFrame, vector_col: str = "embedding", cells: int = CELLS, part: int = PART,
          most: int = SAMPLE) -> Codebook | None:
    """A codebook from at most ``most`` vectors, the first by a hash of the chunk's id.

    None without a vector. Vectors are of one length.
    """
    known = kb.filter(F.col(vector_col).isNotNull())
    order = F.xxhash64("chunk_id")
    sample = known.select(order.alias("_order"), "chunk_id", vector_col).orderBy(
        "_order", "chunk_id"
    ).limit(most)
    rows = np.array([r[vector_col] for r in sample.collect()], "float64")
    if not rows.size:
        return None
    centers = k_means(rows, cells)
    rest = rows - centers[_nearest(rows, centers)]
    cuts = range(0, rows.shape[1], part)
    return Codebook(centers, [k_means(rest[:, c:c + part], VALUES) for c in cuts])


def with_codes(kb: DataFrame, book: Codebook, vector_col: str = "embedding") -> DataFrame:
    """The chunks with ``code``; a chunk without a vector has none."""
    context = kb.sparkSession.sparkContext
    shared = context.broadcast(book)  # of fixed size: some hundred kilobytes

    @F.pandas_udf(T.BinaryType())
    def code(vectors: pd.Series) -> pd.Series:
        there = vectors.notna().to_numpy()
        out = pd.Series([None] * len(vectors), dtype=object)
        if there.any():
            codes = shared.value.encode(np.stack(vectors[there].to_numpy()).astype("float64"))
            out[np.flatnonzero(there)] = [c.tobytes() for c in codes]
        return out

    return kb.withColumn("code", code(F.col(vector_col)))


def write_book(spark: SparkSession, book: Codebook, path: str) -> None:
    """The codebook as a small table: table 0 holds the centers, the others the parts."""
    rows = [
        (n, k, [float(x) for x in v])
        for n, values in enumerate([book.centers, *book.parts]) for k, v in enumerate(values)
    ]
    spark.createDataFrame(rows, "part int, entry int, value array<double>").coalesce(1).write.mode(
        "overwrite"
    ).parquet(path)


def read_book(spark: SparkSession, path: str) -> Codebook:
    tables: dict[int, list] = {}
    # At most 64 centers, and 256 values for each part.
    for r in spark.read.parquet(path).orderBy("part", "entry").collect():
        tables.setdefault(r["part"], []).append(r["value"])
    arrays = [np.array(tables[n]) for n in sorted(tables)]
    return Codebook(arrays[0], arrays[1:])


def bytes_share(book: Codebook, rows: int, shortlist: int) -> float:
    """What a query reads of the chunks, codes and vectors of its shortlist, over all vectors."""
    if rows == 0:
        return 0.0
    whole = 4 * book.dim
    return (rows * book.code_bytes + min(rows, shortlist) * whole) / (rows * whole)
