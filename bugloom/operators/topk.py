"""Exact top-k of a query block against batches of stored vectors.

The kernel of the similarity join. It runs inside a Spark task on the Arrow batches of one
partition, keeps at most ``k`` groups per query, and never materializes scored pairs beyond
one slice.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

# Scores of one tile held at once (rows times queries), and its queries.
SLICE_SCORES = 2_000_000
TILE_QUERIES = 512
# Scanned rows remembered before those that no query needs are dropped.
MOST_ROWS = 200_000
# Pairs scored in double precision at once.
RESCORE_PAIRS = 65_536
# Ranking uses scores rounded to DIGITS. Single precision and rounding move a score by less
# than MARGIN, so a pair that far below the k-th best cannot be among the k best.
DIGITS = 4
MARGIN = 2.5e-4


@dataclass
class QueryBlock:
    """Queries of one pass: ids, unit vectors, and optionally a group to leave out and the
    buckets to look into."""

    ids: pa.Array
    vectors: np.ndarray
    exclude: np.ndarray | None = None
    probes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ids)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; all lists must be equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 1), dtype="float32")
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) % len(column):
        raise ValueError("vectors of different lengths")
    return values.reshape(len(column), -1).astype("float32", copy=False)


def _drop_copies(frame: pd.DataFrame, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that can matter: of equal vectors, only the ``k`` first ids of distinct groups."""
    rows = np.ascontiguousarray(vectors)
    key = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, vector_code = np.unique(key, return_inverse=True)
    if vector_code.max(initial=-1) + 1 == len(frame):
        return np.arange(len(frame))
    coded = frame.assign(vector=vector_code, row=np.arange(len(frame))).sort_values("id")
    coded = coded.drop_duplicates(["vector", "group"])
    first = coded.groupby("vector").cumcount() < k
    return np.sort(coded.loc[first, "row"].to_numpy())


class TopK:
    """Running best ``k`` groups per query.

    Pairs are scored in tiles of queries by rows. Only those above a query's k-th best so far
    are scored exactly; they wait in numbers of the order of the result and are then ranked
    together, so that ranking costs little beside scoring.
    """

    def __init__(self, block: QueryBlock, k: int, least: float | None = None):
        """Of scores below ``least``, if given, some may be missing."""
        self.block, self.k = block, k
        self.floor = np.full(len(block), -np.inf if least is None else least)
        # The best so far and what waits: parallel arrays of queries, places in ``rows``, scores.
        self.found = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))]
        self.rows: list[pd.DataFrame] = []
        self.n_rows = self.waiting = 0

    def add(self, ids, groups, payload, vectors: np.ndarray, buckets=None) -> None:
        frame = pd.DataFrame({"id": ids, "group": groups, "payload": payload}, dtype=object)
        if buckets is None:
            self._add_rows(frame, vectors, np.arange(len(self.block)))
        else:
            for bucket in np.unique(buckets):
                rows = np.flatnonzero(buckets == bucket)
                asking = np.flatnonzero((self.block.probes == bucket).any(axis=1))
                if len(asking):
                    self._add_rows(frame.iloc[rows].reset_index(drop=True), vectors[rows], asking)

    def _add_rows(self, frame: pd.DataFrame, vectors: np.ndarray, asking: np.ndarray) -> None:
        keep = _drop_copies(frame, vectors, self.k + 1)
        frame, vectors = frame.iloc[keep], vectors[keep]
        # Null is a group like others. Rows of a group lie side by side.
        left_out = [] if self.block.exclude is None else self.block.exclude[asking]
        both = np.concatenate([frame["group"].to_numpy(), np.asarray(left_out, dtype=object)])
        codes = pd.factorize(both, use_na_sentinel=False)[0]
        groups, left_out = codes[:len(frame)], codes[len(frame):]
        order = np.argsort(groups, kind="stable")
        frame, vectors, groups = frame.iloc[order], vectors[order], groups[order]
        step = max(1, SLICE_SCORES // min(len(asking), TILE_QUERIES))
        for at in range(0, len(frame), step):
            part = slice(at, at + step)
            self.rows.append(frame.iloc[part])
            for first in range(0, len(asking), TILE_QUERIES):
                tile = slice(first, first + TILE_QUERIES)
                self._add_tile(vectors[part], groups[part], asking[tile], left_out[tile])
            self.n_rows += len(groups[part])
            if self.waiting > max(len(self.block) * self.k // 2, RESCORE_PAIRS):
                self._merge()
        if self.n_rows > MOST_ROWS:
            self._merge()

    def _add_tile(self, vectors, groups, asking, left_out) -> None:
        scores = self.block.vectors[asking] @ vectors.T
        if len(left_out):
            low, high = (np.searchsorted(groups, left_out, side) for side in ("left", "right"))
            sizes = high - low
            ends = np.cumsum(sizes)
            rows = np.arange(sizes.sum()) + np.repeat(low - ends + sizes, sizes)
            scores[np.repeat(np.arange(len(asking)), sizes), rows] = -np.inf
        starts = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1))
        own = np.cumsum(np.diff(groups, prepend=groups[0]) != 0)
        single = len(starts) == len(groups)
        per_group = scores if single else np.maximum.reduceat(scores, starts, axis=1)
        lowest = np.finfo("float32").min
        wanted = scores >= np.maximum(self.floor[asking] - MARGIN, lowest)[:, None].astype("float32")
        if np.count_nonzero(wanted) > 2 * self.k * len(asking):
            if len(starts) > self.k:
                self._raise_floor(per_group, asking)
                cut = np.maximum(self.floor[asking] - MARGIN, lowest)[:, None].astype("float32")
                wanted = scores >= cut
            if not single:
                wanted &= scores >= (per_group - MARGIN)[:, own]
        queries, rows = np.divmod(np.flatnonzero(wanted), scores.shape[1])
        kept = np.isfinite(scores[queries, rows])
        if not single:
            kept &= scores[queries, rows] >= per_group[queries, own[rows]] - MARGIN
        queries, rows = queries[kept], rows[kept]
        exact = np.empty(len(rows))
        for at in range(0, len(rows), RESCORE_PAIRS):
            part = slice(at, at + RESCORE_PAIRS)
            exact[part] = np.einsum(
                "ij,ij->i",
                vectors[rows[part]].astype("float64"),
                self.block.vectors[asking[queries[part]]].astype("float64"),
            )
        self.found.append((asking[queries], self.n_rows + rows, np.round(exact, DIGITS)))
        self.waiting += len(rows)

    def _raise_floor(self, per_group: np.ndarray, asking: np.ndarray) -> None:
        """A query's k-th best is no worse than the k-th best of one tile."""
        place = per_group.shape[1] - self.k
        kth = np.partition(per_group, place, axis=1)[:, place]
        if not np.isfinite(kth).all():
            known = np.where(np.isfinite(per_group), per_group, -np.inf)
            kth = np.partition(known, place, axis=1)[:, place]
        self.floor[asking] = np.maximum(self.floor[asking], kth)

    def _merge(self) -> None:
        """The best ``k`` groups of every query among all found: score down, then id."""
        queries, rows, scores = (np.concatenate(part) for part in zip(*self.found))
        used, rows = np.unique(rows, return_inverse=True)
        pool = pd.concat(self.rows, ignore_index=True).iloc[used] if self.rows else pd.DataFrame(
            {"id": [], "group": [], "payload": []}, dtype=object
        )
        ids = pd.factorize(pool["id"], sort=True)[0]
        ids[ids < 0] = len(pool)
        groups = pd.factorize(pool["group"], use_na_sentinel=False)[0]
        order = np.lexsort((ids[rows], -scores, queries))
        pairs = queries[order] * (len(pool) + 1) + groups[rows[order]]
        order = order[np.sort(np.unique(pairs, return_index=True)[1])]
        at = np.searchsorted(queries[order], queries[order])
        order = order[np.arange(len(order)) - at < self.k]
        queries, rows, scores = queries[order], rows[order], scores[order]
        last = np.flatnonzero(np.bincount(queries, minlength=len(self.block)) == self.k)
        ends = np.searchsorted(queries, last, "right") - 1
        self.floor[last] = np.maximum(self.floor[last], scores[ends])
        self.found, self.rows = [(queries, rows, scores)], [pool]
        self.n_rows, self.waiting = len(pool), 0

    def result(self, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        """(query, id, payload, score) with the given names and types."""
        self._merge()
        queries, rows, scores = self.found[0]
        best = self.rows[0].iloc[rows]
        columns = [
            self.block.ids.take(pa.array(queries)).cast(types[0]),
            pa.array(best["id"].tolist(), types[1]),
            pa.array(best["payload"].tolist(), types[2]),
            pa.array(scores, types[3]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)


def scan(
    block: QueryBlock, batches: Iterable, k: int, group: str,
    vectors_of: Callable[[pa.Array], np.ndarray] = matrix, least: float | None = None,
) -> TopK:
    """Best ``k`` groups of every query over batches with columns id, defect, vector and,
    with probes, bucket. ``vectors_of`` tells what the vector column's entries stand for."""
    state = TopK(block, k, least)
    for batch in batches:
        batch = batch.filter(batch.column("vector").is_valid())
        if batch.num_rows == 0 or len(block) == 0:
            continue
        columns = {
            name: np.asarray(batch.column(name).to_pylist(), dtype=object)
            for name in ("id", "defect")
        }
        buckets = None
        if block.probes is not None:
            buckets = batch.column("bucket").to_numpy()
        state.add(
            columns["id"], columns[group], columns["defect"], vectors_of(batch.column("vector")),
            buckets,
        )
    return state
