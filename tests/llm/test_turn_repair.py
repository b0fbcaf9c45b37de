"""Audits against a plain shortest-path search over the grammar's places."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from bugloom.llm import turn_repair as tr

# Place -> letter -> next place; the grammar (s?(ua)+)? as an automaton, written out.
STEPS = {
    0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2},
}
ACCEPT = {0, 3}


def plain_audit(turns):
    """Least (cost, audit) by search from the front; ties by audit."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, place = heapq.heappop(heap)
        if i == len(turns) and place in ACCEPT:
            return cost, audit
        if (i, place) in seen:
            continue
        seen.add((i, place))
        for c in "ua":
            if c in STEPS[place]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, STEPS[place][c]))
        if i < len(turns):
            initial, goes, cut = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, place))
            if not goes:
                for c, after in STEPS[place].items():
                    if c == initial:
                        heapq.heappush(heap, (cost + cut, audit + "K", i + 1, after))
                    elif c != "s":
                        heapq.heappush(heap, (cost + cut + 2, audit + "R", i + 1, after))


def random_turns(rng, n):
    return [
        (rng.choice("suuaaat" if rng.random() < 0.5 else "ua") if rng.random() < 0.9 else "",
         int(rng.random() < 0.2), 0) for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(6))
def test_audit_like_plain(seed):
    rng, aligner = random.Random(seed), tr.Aligner()
    for _ in range(120):
        turns = random_turns(rng, rng.randrange(10))
        turns = [(i, g, int(not g and rng.random() < 0.3)) for i, g, _ in turns]
        assert aligner.align(turns) == plain_audit(turns), turns


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_do_not_matter(monkeypatch, block):
    monkeypatch.setattr(tr, "BLOCK_TURNS", block)
    rng, aligner = random.Random(block), tr.Aligner()
    for _ in range(120):
        turns = random_turns(rng, rng.randrange(14))
        assert aligner.align(turns) == plain_audit(turns), turns


def test_long_conversations():
    rng, aligner = random.Random(5), tr.Aligner()
    turns = random_turns(rng, 400)
    assert aligner.align(turns) == plain_audit(turns)
    cost, audit = aligner.align(turns * 50)
    assert len(audit) >= 20_000 and cost > 0


def plain_repairs(rows):
    """The whole query in plain Python."""
    def name(x):
        return " " if x is None else str(x)

    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        own = conversations[conv]
        role, text = name(role), name(text)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in conversations.items():
        own.sort(key=lambda r: (
            r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults, seen, turns = [0, 0, 0], set(), []
        for _, role, text in own:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                faults[fault] += 1
            turns.append((role[:1], int(fault < 2), int(fault == 2)))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = plain_audit(turns)
        kept, lines, rest = sum(c != "D" for c in audit), [], iter(own)
        for c in audit:
            at = len(lines) - kept % 2
            wanted = "user" if at % 2 == 0 else "assistant"
            if c == "I":
                lines.append(f"{wanted}:")
                continue
            _, role, text = next(rest)
            if c != "D":
                lines.append(f"{role if c == 'K' else wanted}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *faults, illegal, cost, audit, sha)
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, _kind string"


def test_query_like_plain(spark):
    rng, rows = random.Random(1), []
    texts = ["Yes.", "No!", "Why?", "so", "a b\n", "", " \t", None, "end. \n", "é. x.", "x" * 100_000 + "."]
    for conv in [None, *range(150)]:
        for turn in range(rng.randrange(1, 9)):
            number = None if rng.random() < 0.05 else turn + (turn > 3)
            role = rng.choice(["user", "assistant", "system", "", None, "tool"]) if (
                rng.random() < 0.3) else ("user", "assistant")[turn % 2]
            rows.append((conv, number, role, rng.choice(texts)))
    rows += rows[:40]
    rows += [(999, k, "user", f"w{k}.") for k in range(300)]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in tr.repairs(tr.damaged(df)).collect()}
    assert got == plain_repairs(rows)


def test_dropped_and_empty(spark):
    dropped = next(k for k in range(999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.", "", "")], SCHEMA)
    got = tr.repairs(tr.damaged(df)).collect()
    assert [tuple(r) for r in got] == [
        (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ]
    assert tr.repairs(tr.damaged(df.limit(0))).count() == 0


def test_repaired_turns_alternate(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "Q2?"), (2, 0, "assistant", "A.")]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = [tuple(r) for r in tr.repaired(df).orderBy("conv_id", "turn").collect()]
    assert got == [
        (1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "assistant", "Q2?"),
        (2, 0, "user", ""), (2, 1, "assistant", "A."),
    ]
