"""Toxicity of texts restored by a noisy-channel decoder.

A character trigram model is counted over the words of all documents. A token that may be
disguised (digits or marks among letters, runs of a letter, letters apart) becomes a lattice:
each place offers the letters that a sign may stand for, one or two of a repeated letter, and
nothing or a gap for a separator. Viterbi search takes the path that is likeliest under the model
and the costs of the disguises. Letters of a single word that stand apart in the text are put
together first, and the lattice may keep their gaps.

Restored words are scored by the labels of a bounded sample: hashed runs of five letters get the
share of toxic documents among those that hold them, shrunk to the base rate. A document's
strongest words, by a small logistic model fitted across two folds, give its score.
"""

import re
import zlib
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugloom.llm.common import crc32_remainder, in_runs, worker_memory, written
from bugloom.llm.labelled import FIT_ROWS, labelled_documents, sampled_labels

THRESHOLD = 0.3
MODULUS, HELD = 4, 2
SIGNS = 64  # letters of the model: a word's edge, 26 letters, other letters, anything else
BUCKETS = 1 << 18
RUN = 5
PRIOR = 5.0
KNOWN_WORDS = 200_000
# What a sign may stand for, and separators inside a disguised word.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "¡": "i", "£": "l", "(": "c",
}
SEPARATORS = ".-_*~'`^·"
EDGES = ".,;:!?\"'()[]{}*%&#<>|-_~…“”«»"
# Costs of the channel, as logarithms.
SUBSTITUTED, STRETCHED, SHORTENED, SEPARATED = -1.5, -0.5, -4.0, -1.0
# Places of the lattice after which it is seen whether all readings begin alike by now.
SETTLE = 128

_PLAIN = re.compile(r"[^\W\d_]+\Z")
_STRETCH = re.compile(r"(.)\1\1")
_TWICE = re.compile(r"(.)\1")
# Three or more single signs with white space between them, in quotes or before punctuation.
_APART = re.compile(
    r"(?<!\S)[\"'(\[{“«]*(?P<signs>(?:[^\s,;:]\s++){2,}[^\s,;:])(?=[.,;:!?\"')\]}*~…”»]*+(?!\S))"
)
_RUNS = re.compile(r"(.)\1*", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")


def sign(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % (SIGNS - 28) if c.isalpha() else SIGNS - 1


def _sign_table() -> np.ndarray:
    """Signs of the first 2^16 code points; those above share the last."""
    return np.array(
        [0 if chr(k).isspace() else sign(chr(k)) for k in range(1 << 16)], np.int64
    )


def trigram_counts(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Counts of sign triples in lower-cased words, edges included; a text is a run of words."""
    whole = ("  " + "  ".join((t or "").lower() for t in texts) + "  ")
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = np.where(points < 1 << 16, table[np.minimum(points, (1 << 16) - 1)], SIGNS - 1)
    triples = (signs[:-2] * SIGNS + signs[1:-1]) * SIGNS + signs[2:]
    return np.bincount(triples, minlength=SIGNS**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Logarithms P(c | a, b) from counts over all documents: partial sums, then one per triple."""

    def run(batches):
        worker_memory()
        table, total = _sign_table(), np.zeros(SIGNS**3, np.int64)
        for batch in (part for whole in batches for part in in_runs(whole)):
            total += trigram_counts(batch.column("text").to_pylist(), table)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["g", "n"])

    rows = docs.select("text").mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n"))
    counts = np.zeros(SIGNS**3)
    for g, n in rows.collect():  # at most SIGNS^3 rows
        counts[g] = n
    return smoothed(counts)


def smoothed(counts: np.ndarray) -> np.ndarray:
    three = counts.reshape(SIGNS, SIGNS, SIGNS).astype(float)
    one = three.sum((0, 1)) + 0.01
    one /= one.sum()
    two = three.sum(0) + 5 * one
    two /= two.sum(1, keepdims=True)
    three = three + 5 * two[None]
    return np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """Options at each place of a lower-cased token: letters (or nothing, or a gap) and costs."""
    for found in _RUNS.finditer(token):
        c, n = found[1], found.end() - found.start()
        if c.isalpha():
            if n == 1:
                options = [(c, 0.0)]
            elif n == 2:
                options = [(c * 2, 0.0), (c, SHORTENED)]
            else:
                options = [(c, STRETCHED), (c * 2, STRETCHED + SHORTENED / 2)]
        elif c == " ":
            options = [("", 0.0), (" ", 0.0)]
        else:
            options = [(c * n, 0.0)]
            for letter in LEET.get(c, ""):
                options.append((letter, SUBSTITUTED if n == 1 else SUBSTITUTED + STRETCHED))
                if n >= 2:
                    options.append((letter * 2, SUBSTITUTED))
            if c in SEPARATORS:
                options += [("", SEPARATED), (" ", 0.0)]
        yield options


def _settled(states: dict) -> str:
    """What all readings begin with, cut off from them; nothing while they still differ.

    A reading is a chain of [reading before, letters], one link per place, so chains are walked
    back in step; ``4 * SETTLE`` links at most, as those that differ longer are kept as they are.
    """
    nodes = {id(n): n for _, n in states.values()}
    for _ in range(4 * SETTLE):
        if len(nodes) == 1:
            break
        nodes = {id(n[0]): n[0] for n in nodes.values() if n[0] is not None}
        if not nodes:
            return ""
    if len(nodes) != 1:
        return ""
    trunk = next(iter(nodes.values()))
    head = _letters(trunk)
    trunk[0], trunk[1] = None, ""
    return head


def _letters(node: list | None) -> str:
    parts = []
    while node is not None:
        parts.append(node[1])
        node = node[0]
    return "".join(reversed(parts))


def decode(token: str, model: list) -> str:
    """The likeliest reading of a token of any length; gaps in it separate words.

    ``model`` is nested lists of logarithms. What all readings share is cut off as they meet, so
    work and memory grow with the token's length.
    """
    states, done = {(0, 0): (0.0, None)}, []
    for at, options in enumerate(lattice(token), 1):
        after: dict = {}
        for (a, b), (score, before) in states.items():
            for letters, cost in options:
                x, y, s = a, b, score + cost
                for c in letters:
                    if c == " ":
                        s += model[x][y][0]
                        x, y = 0, 0
                    else:
                        z = sign(c)
                        s += model[x][y][z]
                        x, y = y, z
                found = after.get((x, y))
                if found is None or found[0] < s:
                    after[x, y] = (s, [before, letters])
        states = after
        if at % SETTLE == 0:
            done.append(_settled(states))
    best = max(((s + model[a][b][0], n) for (a, b), (s, n) in states.items()), key=lambda x: x[0])
    return "".join(done) + _letters(best[1])


def single_or_twice(word: str, model: list) -> str:
    """The likeliest reading of a word of letters none of which comes more than twice in a row.

    The lattice of such a word offers one or two of a doubled letter. After the next letter both
    readings end in the same two, so each doubled letter is decided by itself: the signs before it
    and the next one tell.
    """
    signs = [0, 0, *map(sign, word), 0]
    out, at, n = [], 0, len(word)
    while at < n:
        c = word[at]
        if at + 1 < n and word[at + 1] == c:
            before, own, after = signs[at + 1], signs[at + 2], signs[at + 4]
            twice = model[before][own][own] + model[own][own][after]
            if twice < model[before][own][after] + SHORTENED:
                out.append(c)
            else:
                out.append(c + c)
            at += 2
        else:
            out.append(c)
            at += 1
    return "".join(out)


def tokens(text: str | None) -> list[str]:
    """Lower-cased tokens; letters that stand apart become one token with gaps."""
    text = (text or "").lower()
    if _APART.search(text) is None:
        return text.split()
    out, at = [], 0
    for found in _APART.finditer(text):
        out += text[at:found.start()].split()
        out.append(" ".join(found["signs"].split()))
        at = found.end()
    return out + text[at:].split()


class Restorer:
    """Restored words of tokens."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def words(self, token: str) -> list[str]:
        plain = token.strip(EDGES)
        if _PLAIN.match(plain) and not _STRETCH.search(plain):
            return [single_or_twice(plain, self.model) if _TWICE.search(plain) else plain]
        if not any(map(str.isalnum, token)):
            return []
        # At the ends these signs are punctuation; a first "!" or "(" may be a letter.
        kept = token.lstrip(".,;:?\"')[]{}*%&#<>~").rstrip(".,;:?!\"'()[]{}*%&#<>~")
        return _LETTERS.findall(decode(kept, self.model))

    def restore(self, text: str | None) -> str:
        return " ".join(w for t in tokens(text) for w in self.words(t))


def buckets(word: str) -> list[int]:
    """Hashed runs of ``RUN`` letters, edges included."""
    own = f"^{word}$"
    return [
        zlib.crc32(own[k:k + RUN].encode()) % BUCKETS for k in range(max(1, len(own) - RUN + 1))
    ]


def bucket_counts(labelled: DataFrame, model) -> np.ndarray:
    """Documents that hold a bucket, by fold and label: [fold, label, bucket]; last: of all."""

    def run(batches):
        worker_memory()
        restorer, total = Restorer(model.value), np.zeros((2, 2, BUCKETS + 1), np.int64)
        known: dict = {}
        columns = ("doc_id", "text", "label")
        for batch in (part for whole in batches for part in in_runs(whole)):
            for doc_id, text, label in zip(*(batch.column(c).to_pylist() for c in columns)):
                own = set()
                for t in set(tokens(text)):
                    got = known.get(t)
                    if got is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        got = known[t] = [b for w in restorer.words(t) for b in buckets(w)]
                    own.update(got)
                fold = fold_of(doc_id)
                total[fold, int(label > 0), list(own)] += 1
                total[fold, int(label > 0), BUCKETS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["g", "n"])

    rows = labelled.mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    counts = np.zeros(4 * (BUCKETS + 1))
    found = rows.toPandas()  # at most 4 * (BUCKETS + 1) rows
    counts[found["g"].to_numpy(np.int64)] = found["n"].to_numpy()
    return counts.reshape(2, 2, BUCKETS + 1)


def fold_of(doc_id: int) -> int:
    return zlib.crc32(f"fold {doc_id}".encode()) & 1


def evidence(counts: np.ndarray) -> np.ndarray:
    """How far a bucket moves the odds of toxicity, in logarithms; counts by [label, bucket]."""
    clean, toxic = counts[0], counts[1]
    base = (toxic[-1] + 0.5) / (toxic[-1] + clean[-1] + 1)
    share = (toxic + PRIOR * base) / (toxic + clean + PRIOR)
    return (np.log(share / (1 - share)) - log(base / (1 - base)))[:-1].astype(np.float32)


N_FEATURES = 6


def features(values: list[float], n_words: int) -> list[float]:
    """A document's strongest words, how many are strong, and its length."""
    top = sorted(values, reverse=True)[:10] + [0.0] * 10
    strong = sum(v > 2.0 for v in values)
    return [
        top[0], top[1], sum(top[:10]) / 10, log(1 + strong), strong / (1 + n_words) ** 0.5,
        log(1 + n_words) / 5,
    ]


class Scorer:
    """Evidence of tokens by one table, with a bounded memory."""

    def __init__(self, model: np.ndarray, table: np.ndarray):
        self.restorer, self.table, self.known = Restorer(model), table, {}

    def _value(self, token: str) -> float:
        values = [max(self.table[b] for b in buckets(w)) for w in self.restorer.words(token)]
        return float(max(values, default=0.0))

    def features(self, text: str | None) -> list[float]:
        own, known, values = tokens(text), self.known, []
        for t in set(own):
            v = known.get(t)
            if v is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                v = known[t] = self._value(t)
            values.append(v)
        return features(values, len(own))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS):
    """The language model over all documents, and evidence and weights from sampled labels.

    Without labels of both kinds the weights are none, and every score is 0.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(language_model(docs))
    sample = labelled_documents(docs, sampled_labels(labels, "toxic", MODULUS, HELD, most))
    sample = written(sample, "labelled")  # about ``most`` rows
    counts = bucket_counts(sample, model)
    if not counts[:, :, BUCKETS].sum(0).all():
        return model, np.zeros(BUCKETS, np.float32), None
    # Each fold's documents are described by what the other fold's labels tell.
    other = spark.sparkContext.broadcast([evidence(counts[1]), evidence(counts[0])])

    def run(batches):
        worker_memory()
        scorers = [Scorer(model.value, t) for t in other.value]
        for batch in (part for whole in batches for part in in_runs(whole)):
            rows = [
                scorers[fold_of(i)].features(t)
                for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            ]
            x = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), x, batch.column("label")], ["doc_id", "x", "label"]
            )

    # About ``most`` rows, in one order whatever tasks made them.
    rows = sample.mapInArrow(run, "doc_id bigint, x array<double>, label int").toPandas()
    rows = rows.assign(order=rows["x"].map(tuple)).sort_values(["doc_id", "order", "label"])
    x = np.array(rows["x"].tolist()).reshape(-1, N_FEATURES)
    weights = fit_logistic(x, (rows["label"].to_numpy() > 0).astype(float))
    return model, evidence(counts.sum(0)), weights


def scored(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """All columns of the documents, with score, held_out and predicted.

    A null text counts as empty and has the score of a text without words. Columns with the
    names of new ones are replaced.
    """
    model, table, weights = fit(docs, labels, most)
    told = docs.sparkSession.sparkContext.broadcast((table, weights))
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "held_out", "predicted")])
    schema = kept.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        worker_memory()
        table, weights = told.value
        scorer = Scorer(model.value, table)
        for batch in (part for whole in batches for part in in_runs(whole)):
            texts = batch.column("text").to_pylist()
            scores = [0.0] * len(texts)
            if weights is not None:
                for k, t in enumerate(texts):
                    z = float(np.dot(scorer.features(t), weights[:-1]) + weights[-1])
                    scores[k] = 1 / (1 + exp(-max(-30.0, min(30.0, z))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=schema.names
            )

    return kept.mapInArrow(run, schema).withColumns({
        "held_out": crc32_remainder(F.col("doc_id"), MODULUS) == HELD,
        "predicted": (F.col("score") >= THRESHOLD).cast("int"),
    })
