"""Quality by a generalised additive model with pairwise interactions.

Numbers that describe a text are binned at quantiles. Cyclic boosting visits one feature after
the other, fits a shallow tree to the log-loss gradients summed by bin, and adds its shrunk steps
to the feature's lookup table; afterwards the pairs of features whose cells leave most gradient
get tables of their own, by trees of one split on each axis. A score is the sum of table entries
at a document's bins. The tables are all there is to the model, and can be read.
"""

import re
from collections import Counter
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugloom.llm.common import crc32_remainder, in_runs
from bugloom.llm.labelled import FIT_ROWS, labelled_documents, sampled_labels

THRESHOLD = 0.3
MODULUS, HELD = 5, 0
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 60, 30, 6
RATE, RIDGE, MIN_ROWS = 0.2, 2.0, 5

NAMES = (
    "words", "word_length", "long_words", "upper", "digits", "symbols", "exclamations", "bars",
    "punctuation", "distinct_words", "top_word", "next_to_itself", "repeated_windows",
    "repeated_lines", "line_words", "ended_lines",
)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_SYMBOL = re.compile(r"[#*$%&<>{}\[\]\\^~=+@]")
_MARK = re.compile(r"[.,;:?!]")


def describe(text: str | None) -> list[float]:
    """The features of a text, in the order of ``NAMES``; a null text is an empty one."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = sum(map(len, words))
    counts = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:]))
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    return [
        log(1 + n), chars / n, sum(len(w) > 12 for w in words) / n,
        len(_UPPER.findall(text)) / chars, len(_DIGIT.findall(text)) / chars,
        len(_SYMBOL.findall(text)) / chars, text.count("!") / n, text.count("|") / n,
        len(_MARK.findall(text)) / n, len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(c for c in windows.values() if c > 1) / n,
        1 - len(set(lines)) / len(lines), log(1 + n / len(lines)),
        sum(s[-1] in ".!?…\"'" for s in lines) / len(lines),
    ]


@dataclass
class Model:
    """Bin edges and lookup tables; an interaction has coarser bins."""

    constant: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features, by adding up table entries."""
        z = np.full(len(x), self.constant)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, k], side="right")]
        if self.pairs:
            coarse = {
                k: np.searchsorted(self.pair_edges[k], x[:, k], side="right")
                for k in {k for pair in self.pairs for k in pair}
            }
            for (i, j), table in zip(self.pairs, self.pair_tables):
                z += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def edges_of(values: np.ndarray, bins: int) -> np.ndarray:
    shares = np.linspace(0, 1, bins + 1)[1:-1]
    return np.unique(np.quantile(values, shares)) if values.size else np.empty(0)


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, splits: int = 3) -> np.ndarray:
    """Steps per bin of a tree with at most ``splits`` splits, the best one first."""
    leaves, out = [(0, g.size)], np.zeros(g.size)
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (g, h, n)]

    def value(a, b):
        return (sums[0][b] - sums[0][a]) ** 2 / (sums[1][b] - sums[1][a] + RIDGE)

    for _ in range(splits):
        best = (1e-9, None)
        for leaf in leaves:
            a, b = leaf
            for m in range(a + 1, b):
                if min(sums[2][m] - sums[2][a], sums[2][b] - sums[2][m]) < MIN_ROWS:
                    continue
                gain = value(a, m) + value(m, b) - value(a, b)
                if gain > best[0]:
                    best = (gain, (leaf, m))
        if best[1] is None:
            break
        (a, b), m = best[1]
        leaves.remove((a, b))
        leaves += [(a, m), (m, b)]
    for a, b in leaves:
        out[a:b] = (sums[0][b] - sums[0][a]) / (sums[1][b] - sums[1][a] + RIDGE)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree with one split on each axis of a table of cells."""
    sums = [np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h)]
    rows, columns = g.shape
    best = (0.0, np.zeros(g.shape))
    for i in range(1, rows):
        for j in range(1, columns):
            cells = ((0, i, 0, j), (0, i, j, columns), (i, rows, 0, j), (i, rows, j, columns))
            parts = [[s[b, d] - s[a, d] - s[b, c] + s[a, c] for s in sums] for a, b, c, d in cells]
            gain = sum(u * u / (v + RIDGE) for u, v in parts)
            if gain > best[0]:
                steps = np.zeros(g.shape)
                for (a, b, c, d), (u, v) in zip(cells, parts):
                    steps[a:b, c:d] = u / (v + RIDGE)
                best = (gain, steps)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Tables for rows of features and labels 0 or 1; one kind of label gives a constant."""
    rows, n_features = x.shape
    base = (y.sum() + 0.5) / (rows + 1)
    edges = [edges_of(x[:, k], BINS) for k in range(n_features)]
    model = Model(log(base / (1 - base)), edges, [np.zeros(e.size + 1) for e in edges])
    if rows == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    sizes = [np.bincount(b, minlength=t.size) for b, t in zip(bins, model.tables)]
    z = np.full(rows, model.constant)

    def gradients():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, (b, table) in enumerate(zip(bins, model.tables)):
            g, h = (np.bincount(b, v, table.size) for v in gradients())
            step = RATE * shallow_tree(g, h, sizes[k])
            table += step
            z += step[b]
    model.pair_edges = [edges_of(x[:, k], PAIR_BINS) for k in range(n_features)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    widths = [e.size + 1 for e in model.pair_edges]

    def cells(i, j):
        at = coarse[i] * widths[j] + coarse[j]
        return at, [
            np.bincount(at, v, widths[i] * widths[j]).reshape(widths[i], widths[j])
            for v in gradients()
        ]

    gains = [
        (cross_tree(*cells(i, j)[1])[0], i, j)
        for i in range(n_features) for j in range(i) if min(widths[i], widths[j]) > 1
    ]
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((widths[i], widths[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            at, (g, h) = cells(i, j)
            step = RATE * cross_tree(g, h)[1]
            table += step
            z += step.ravel()[at]
    return model


def fitted(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """The model of a bounded sample of labelled documents."""
    sample = labelled_documents(docs, sampled_labels(labels, "quality", MODULUS, HELD, most))

    def run(batches):
        for batch in (part for whole in batches for part in in_runs(whole)):
            found = [describe(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array(found, pa.list_(pa.float64()))]
            columns += [batch.column("doc_id"), batch.column("label")]
            yield pa.RecordBatch.from_arrays(columns, ["x", "doc_id", "label"])

    rows = sample.mapInArrow(run, "x array<double>, doc_id bigint, label int").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")  # sums do not depend on the tasks' order
    x = np.array(rows["x"].tolist()).reshape(-1, len(NAMES))
    return fit(x, (rows["label"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """All columns of the documents, with score, held_out and predicted.

    A null text counts as empty and has the score of a text without words. Without labels every
    score is one half. Columns with the names of new ones are replaced.
    """
    told = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most))
    new = ("score", "held_out", "predicted")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    schema = kept.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for batch in (part for whole in batches for part in in_runs(whole)):
            x = np.array([describe(t) for t in batch.column("text").to_pylist()])
            scores = told.value.score(x.reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=schema.names)

    return kept.mapInArrow(run, schema).withColumns({
        "held_out": crc32_remainder(F.col("doc_id"), MODULUS) == HELD,
        "predicted": (F.col("score") >= THRESHOLD).cast("int"),
    })
