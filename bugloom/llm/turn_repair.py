"""Conversations repaired to alternating turns by the cheapest edits, with an audit of them.

The turns of a conversation are aligned to strings of the grammar ``(s?(ua)+)?``: a Wagner-Fischer
table for every feasible length of the target, its cells bounded by Ukkonen's band (a cell whose
insertions and deletions alone cost more than the best alignment so far is left out). The
tables run from the end, so the audit is read off from the front, least letter first: D delete,
I insert, K keep, R give another role. Of the lengths with the least cost, the least audit wins.

Long conversations are aligned in blocks of ``BLOCK_TURNS``. What a block must know of the others
is in which of four places of the grammar it begins, and what the rest costs from each place;
so blocks are aligned from the last to the first, for each place once, and then read in order.
Work grows with the number of turns. While it is aligned, a conversation takes about a hundred
bytes per turn, whatever its texts; those are only streamed, in order, through a running hash.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bugloom.llm.common import in_runs, written

# Costs of the edits, and the white space of blank turns.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"

BLOCK_TURNS = 32
KNOWN_BLOCKS = 10_000
INF = 1 << 40
NAMES = {"u": "user", "a": "assistant"}
# Places of the grammar: nothing yet, after the system turn, after a user turn, after an answer.
START, SYSTEM, ASKED, ANSWERED = range(4)
ACCEPTED = (0, INF, INF, 0)


# ---------------------------------------------------------------------------
# Alignment
# ---------------------------------------------------------------------------
def targets(place: int, length: int) -> Iterator[tuple[str, int]]:
    """The grammar's strings of a length from a place on, and the places they lead to."""
    first = "a" if place == ASKED else "u"
    other = "u" if first == "a" else "a"
    string = (first + other) * (length // 2) + first * (length % 2)
    yield string, (ASKED if string[-1:] == "u" else ANSWERED) if string else place
    if place == START and length:
        rest = "ua" * ((length - 1) // 2) + "u" * ((length - 1) % 2)
        yield "s" + rest, (ASKED if rest[-1:] == "u" else ANSWERED) if rest else SYSTEM


def wagner_fischer(turns: tuple, target: str, most: int, last: bool) -> tuple[int, str] | None:
    """Cost and least audit of turns aligned to a target, or none if it costs over ``most``.

    ``turns`` are (role's initial, must go, truncated). Only the last block may insert after its
    last turn: elsewhere such an insertion belongs to the next block.
    """
    n, m = len(turns), len(target)
    inserts = [INSERT if c != "s" else INF for c in target]
    # A diagonal k = j - i costs its insertions or deletions before it and those after it.
    gap = m - n

    def drift(k: int) -> int:
        return INSERT * k if k > 0 else -DELETE * k

    band = [k for k in range(min(gap, 0) - most // DELETE, max(gap, 0) + most // INSERT + 1)
            if drift(k) + drift(gap - k) <= most]
    if not band:
        return None
    low, high = band[0], band[-1]
    width = high - low + 1
    rows = [[INF] * (width + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = rows[i], rows[i + 1] if i < n else None
        if i < n:
            initial, goes, cut = turns[i]
            keep, change = cut * TRUNCATED, cut * TRUNCATED + REROLE
        for at in range(width - 1, -1, -1):
            j = i + low + at
            if j < 0 or j > m:
                continue
            if i == n:
                best = 0 if j == m else INF
                if last and j < m:
                    best = row[at + 1] + inserts[j]
            else:
                best = below[at - 1] + DELETE if at else INF
                if j < m:
                    best = min(best, row[at + 1] + inserts[j])
                    if not goes:
                        c = target[j]
                        step = keep if c == initial else change if c != "s" else INF
                        best = min(best, below[at] + step)
            row[at] = best
    if low > 0 or high < 0 or rows[0][-low] > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        at, now = j - i - low, rows[i][j - i - low]
        if i < n and at and rows[i + 1][at - 1] + DELETE == now:
            audit.append("D")
            i += 1
        elif j < m and rows[i][at + 1] + inserts[j] == now:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if target[j] == turns[i][0] else "R")
            i, j = i + 1, j + 1
    return rows[0][-low], "".join(audit)


def best_alignment(turns: tuple, place: int, rest: tuple, last: bool) -> tuple[int, str, int]:
    """Least cost with the rest's, least audit and the place reached, over all feasible lengths.

    Lengths are tried from the number of turns that may stay outwards, so that the first
    alignments already bound the others.
    """
    forced = sum(t[1] for t in turns)
    stay, open_cost = len(turns) - forced, min(rest)
    best: tuple = (INF, "", -1)
    for sign in (-1, 1):
        away = 0 if sign < 0 else 1
        while stay + sign * away >= 0:
            least = forced * DELETE + away * (DELETE if sign < 0 else INSERT)
            if least + open_cost > best[0]:
                break
            for target, reached in targets(place, stay + sign * away):
                if rest[reached] >= INF:
                    continue
                # Without an alignment yet, every turn may go and every letter be inserted.
                most = min(best[0], DELETE * len(turns) + INSERT * len(target) + rest[reached]
                           + TRUNCATED * len(turns))
                found = wagner_fischer(turns, target, most - rest[reached], last)
                if found:
                    best = min(best, (found[0] + rest[reached], found[1], reached))
            away += 1
            if best[0] >= INF and away > 2 * len(turns) + 2:
                break
    return best


class Aligner:
    """Costs and audits of whole conversations, with a bounded memory of blocks."""

    def __init__(self):
        self.known: dict = {}

    def block(self, turns: tuple, place: int, rest: tuple, last: bool) -> tuple[int, str, int]:
        floor = min(rest)
        if floor >= INF:
            return INF, "", -1
        key = turns, place, tuple(min(r - floor, INF) for r in rest), last
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= KNOWN_BLOCKS:
                self.known.clear()
            found = self.known[key] = best_alignment(*key)
        return min(found[0] + floor, INF), found[1], found[2]

    def align(self, turns: list[tuple[str, int, int]]) -> tuple[int, str]:
        """Cost and audit of a conversation's turns (role's initial, must go, truncated)."""
        blocks = [tuple(turns[k:k + BLOCK_TURNS]) for k in range(0, len(turns), BLOCK_TURNS)]
        rest, plans = ACCEPTED, []
        for k in range(len(blocks) - 1, -1, -1):
            places = range(4) if k else (START,)
            plan = {p: self.block(blocks[k], p, rest, k == len(blocks) - 1) for p in places}
            rest = tuple(plan[p][0] if p in plan else INF for p in range(4))
            plans.append(plan)
        place, audit = START, []
        for plan in reversed(plans):
            _, part, place = plan[place]
            audit.append(part)
        return (rest[START] if blocks else 0), "".join(audit)


def repaired_lines(audit: str) -> Iterator[tuple[bool, str | None]]:
    """Per letter of an audit: does it take a turn, and the role it writes.

    None drops the turn; an empty role keeps the turn's own.
    """
    length = sum(c != "D" for c in audit)
    place = -(length % 2)  # the place after a system turn counts from 0
    for c in audit:
        if c == "D":
            yield True, None
            continue
        role = NAMES["ua"[place % 2]] if place >= 0 else ""
        yield c != "I", "" if c == "K" else role
        place += 1


# ---------------------------------------------------------------------------
# Turns
# ---------------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after seeded damage; ``_rows`` counts a turn's rows (0 to 2).

    A null role or text becomes one blank; so does a null id or turn in the damage's key.
    """
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("_kind"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("_kind") == 1, "").when(
            F.col("_kind") == 2, F.regexp_replace(text, r"[.!?]", "")
        ).otherwise(text).alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("_rows"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns for conversations as they are."""
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("_rows"),
    )


# Order of a conversation's turns: by number, nulls first; ties by role and digest of the text.
_ORDER = ["conv_id", "_kind", "turn", "role", "_digest", "_copy"]


def _rows(turns: DataFrame, *more: Column) -> DataFrame:
    """A row per turn; a conversation whose turns were all dropped keeps a row of kind 0."""
    own = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        "role", "text",
        F.explode(F.sequence(F.least(F.col("_rows"), F.lit(1)), F.col("_rows"))).alias("_copy"),
    )
    there = F.col("_copy") > 0
    digest = F.when(there, F.unhex(F.sha2(F.col("text"), 256)))
    return own.select(
        "conv_id", there.cast("int").alias("_kind"), F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.col("role")).alias("role"), digest.alias("_digest"), "_copy", *more,
    )


def _sorted(rows: DataFrame) -> DataFrame:
    """A conversation's rows in one task, one after another; sorting spills."""
    return rows.repartition("conv_id").sortWithinPartitions(*_ORDER)


def _groups(batches, names: list[str]):
    """(conv_id, rows) with the rows of one batch each; a conversation may come in several."""
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        ids, at = columns[0], 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            yield ids[at], zip(*(c[at:end] for c in columns[1:]))
            at = end


AUDIT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint, audit string"
)
_LEGAL = {"su", "ua", "au"}


class _Turns:
    """What alignment needs of one conversation: a few bytes per turn."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.states = conv_id, [], {}
        self.low = self.high = self.before = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.role = None

    def add(self, turn, role: str, blank: bool, repeated: bool, cut: bool) -> None:
        if turn is not None:
            self.distinct += turn != self.before
            self.low = turn if self.low is None else self.low
            self.high = self.before = turn
        initial = role[:1]
        if self.role is not None:
            self.illegal += self.role + initial not in _LEGAL
        self.role = initial
        self.blank += blank
        self.duplicate += repeated and not blank
        cut = cut and not blank and not repeated
        self.truncated += cut
        turn_state = (initial, int(blank or repeated), int(cut))
        self.turns.append(self.states.setdefault(turn_state, turn_state))

    def result(self, aligner: Aligner) -> tuple:
        cost, audit = aligner.align(self.turns)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost,
            audit,
        )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema
    )


_AUDIT_TYPES = pa.schema(
    [("conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)


def audits(turns: DataFrame) -> DataFrame:
    """Counts of faults, cost and audit per conversation, from narrow columns alone."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = _rows(
        turns, (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(*ENDS)).alias("cut"),
    )

    def run(batches):
        aligner, now, seen, out = Aligner(), None, set(), []
        names = ["conv_id", "_kind", "turn", "role", "_digest", "blank", "cut"]
        for conv_id, group in _groups(batches, names):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.result(aligner))
                now, seen = _Turns(conv_id), set()
            for kind, turn, role, digest, blank, cut in group:
                if kind:
                    key = hashlib.blake2b(role.encode() + b"\0" + digest, digest_size=16).digest()
                    now.add(turn, role, blank, key in seen, cut)
                    seen.add(key)
            if len(out) >= 1000:
                yield _batch(out, _AUDIT_TYPES)
                out = []
        if now is not None:
            out.append(now.result(aligner))
        yield _batch(out, _AUDIT_TYPES)

    return _sorted(rows).mapInArrow(run, AUDIT)


_REPAIRED_TYPES = _AUDIT_TYPES.append(pa.field("repaired_sha256", pa.string()))
_KEPT = [f.name for f in _AUDIT_TYPES][1:]


def _audit_rows(found: DataFrame) -> DataFrame:
    """Audits as first rows of their conversations, beside the turns."""
    null = F.lit(None)
    return found.select(
        "conv_id", F.lit(-1).alias("_kind"), null.cast("bigint").alias("turn"),
        null.cast("string").alias("role"), null.cast("binary").alias("_digest"),
        F.lit(0).alias("_copy"), F.struct(*_KEPT).alias("_audit"),
        null.cast("string").alias("text"),
    )


def _turn_rows(turns: DataFrame, found: DataFrame) -> DataFrame:
    rows = _rows(turns, F.lit(None).cast(found.schema["_audit"].dataType).alias("_audit"), "text")
    return rows.filter("_kind = 1")


def _with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    first = _audit_rows(found)
    return _sorted(first.unionByName(_turn_rows(turns, first)))


def _edits(batches):
    """Per conversation: its audit's row, then (role, text) of each repaired turn in order."""
    names = ["conv_id", "_kind", "role", "text", "_audit"]
    plan = None
    for conv_id, group in _groups((part for b in batches for part in in_runs(b)), names):
        for kind, role, text, audit in group:
            if kind < 0:
                if plan is not None:
                    yield from _inserted(plan)
                plan = repaired_lines(audit["audit"])
                yield conv_id, audit, None, None
                continue
            for takes, name in plan:
                if not takes:
                    yield conv_id, None, name, ""
                    continue
                if name is not None:
                    yield conv_id, None, name or role, text
                break
    if plan is not None:
        yield from _inserted(plan)


def _inserted(plan):
    """Turns inserted after the last one."""
    for _, name in plan:
        yield None, None, name, ""


def repairs(turns: DataFrame) -> DataFrame:
    """The audits with ``repaired_sha256``, of the repaired turns as ``role:text`` lines.

    ``turns`` are those of ``damaged`` or ``undamaged``: nulls, empty texts, repeated rows and
    equal turn numbers may occur; turns with one number are ordered by role and text. A null id
    is a conversation. Without turns all counts are 0 and the audit is empty.
    """
    found = written(audits(turns), "audits")

    def run(batches):
        out, head, sha, lines = [], None, None, 0
        for conv_id, audit, role, text in _edits(batches):
            if audit is not None:
                if head is not None:
                    out.append((*head, sha.hexdigest()))
                    if len(out) >= 1000:
                        yield _batch(out, _REPAIRED_TYPES)
                        out = []
                head = (conv_id, *(audit[n] for n in _KEPT))
                sha, lines = hashlib.sha256(), 0
                continue
            sha.update(("\n" * bool(lines) + f"{role}:{text}").encode())
            lines += 1
        if head is not None:
            out.append((*head, sha.hexdigest()))
        yield _batch(out, _REPAIRED_TYPES)

    return _with_audits(turns, found).mapInArrow(run, f"{AUDIT}, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the repaired conversations, turns numbered from 0."""
    turns = undamaged(conversations)
    found = written(audits(turns), "audits")
    types = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())
    ])

    def run(batches):
        out, now, number, size = [], None, 0, 0
        for conv_id, audit, role, text in _edits(batches):
            if audit is not None:
                now, number = conv_id, 0
                continue
            out.append((now, number, role, text))
            number, size = number + 1, size + len(text)
            if size > 4_000_000 or len(out) >= 10_000:
                yield _batch(out, types)
                out, size = [], 0
        yield _batch(out, types)

    return _with_audits(turns, found).mapInArrow(
        run, "conv_id bigint, turn bigint, role string, text string"
    )
