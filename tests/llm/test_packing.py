"""Fills against an exhaustive search, and packed tables token by token."""

import itertools
import random
import struct
import zlib
from collections import defaultdict

import pytest

from bugloom.llm import packing
from bugloom.llm.tokens import Encoder


def best_sum(counts, capacity):
    found = {0}
    for length, n in counts.items():
        found = {s + k * length for s in found for k in range(n + 1)}
    return max(s for s in found if s <= capacity)


def test_fill_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 5))}
        capacity = rng.randint(0, 60)
        best, used = packing.fill(counts, capacity)
        assert best == best_sum(counts, capacity) == sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    window = 64
    counts = {k: rng.choice([0, 1, 2, 50]) for k in range(1, window) if seed or k == 40}
    places, first_rest, sequences = packing.plan(counts, window)
    for length, n in counts.items():
        ranks = [r for p in places if p.length == length for r in range(p.first, p.after)]
        assert sorted(ranks) == list(range(n))
    filled = defaultdict(int)
    for p in (p for p in places if not p.rest):
        for r in range(p.after - p.first):
            filled[p.sequence + r // p.per] += p.length
    assert set(filled.values()) <= {window} and sorted(filled) == list(range(first_rest))
    total = sum(k * n for k, n in counts.items())
    assert sequences == -(-total // window)


def check(rows, got, window):
    encoder = Encoder()
    docs, pieces = defaultdict(list), defaultdict(list)
    for i, t in rows:
        docs[i].append(encoder.direct([t or ""])[0] + struct.pack("<I", 1))
    sequences = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, own in docs.items():
        n = sum(len(x) // 4 for x in own)
        assert sum(r["length"] for r in pieces[i]) == n
        for r in pieces[i]:
            spans = [x[4 * r["start"]:4 * (r["start"] + r["length"])] for x in own
                     if len(x) // 4 == r["doc_tokens"]]
            assert r["ids_crc32"] in map(zlib.crc32, spans)
    lengths = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        lengths.append(at)
    assert sum(n < window for n in lengths) <= 1 and max(lengths, default=0) <= window


@pytest.mark.parametrize("window", [16, 64])
def test_table(spark, window):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices("one two three four, five.".split(), k=rng.randint(0, 90))))
            for k in range(150)]
    rows += [(200, None), (201, ""), (None, "null id"), (7, rows[7][1])]
    rows += [(300 + k, "copy of the same text again and again") for k in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, uid string")
    check(rows, packing.packed(df, window).collect(), window)


def test_equal_lengths_are_cut(spark):
    rows = [(k, "just these five words here") for k in range(50)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    check(rows, got, 8)
    assert any(a["doc_id"] == b["doc_id"] for a, b in itertools.combinations(got, 2))


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
