"""Line-first cleaning: drop failing lines, then documents that lose too much text.

A line with words fails on
- punctuation: at least ``MIN_MARKS`` marks of ``[#*$%&|<>!]`` and more than ``MARKS_PER_WORD``
  times its words, or fewer letters and digits than half of its characters;
- navigation: at least ``MENU_ITEMS`` items between menu separators, of at most ``ITEM_WORDS``
  words each on average;
- boilerplate: one of the fixed phrases, in a line of at most ``PHRASE_WORDS`` words.
Lines without words are neither kept nor lost. A document goes if it fails the base rules, or if
the failing lines hold more than ``MAX_LOST_PERCENT`` of the characters in its words.
"""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bugloom.llm.common import in_runs

MIN_WORDS = 50
MAX_REPEATED = 0.5
MARKS_PER_WORD = 0.5
MENU_ITEMS = 4
ITEM_WORDS = 3
PHRASE_WORDS = 20
MAX_LOST_PERCENT = 30
MIN_MARKS = 3
# The base rules' symbols, menu separators, phrases of notices and page furniture.
SYMBOLS = "#*$%&|<>"
MENU_SEPARATORS = "|»›·•"
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "terms of service",
    "terms of use", "privacy policy", "cookie policy", "we use cookies", "accept cookies",
    "subscribe to our newsletter", "sign up for our", "click here", "share this",
    "skip to content", "javascript is disabled", "enable javascript", "log in to comment",
    "back to top", "powered by",
)

_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[#*$%&|<>!]")
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_SEPARATOR = re.compile(f"[{re.escape(MENU_SEPARATORS)}]")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))
_NOT_TEXT = re.compile(r"[\W_]+")

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, lost_chars bigint, n_failed_lines bigint, base_failed boolean, "
    "kept boolean, clean_text string"
)


def line_fails(line: str, found: list[str]) -> str | None:
    """The first rule a line of these words breaks."""
    n = len(found)
    marks = len(_MARK.findall(line))
    if marks >= MIN_MARKS and marks > MARKS_PER_WORD * n:
        return "punctuation"
    size = sum(map(len, found))
    if size - sum(map(len, _NOT_TEXT.findall("".join(found)))) < 0.5 * size:
        return "punctuation"
    items = len(_SEPARATOR.findall(line)) + 1
    if items >= MENU_ITEMS and n <= ITEM_WORDS * items:
        return "navigation"
    if n <= PHRASE_WORDS and _PHRASE.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(found: list[str]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    windows = list(zip(found, found[1:], found[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n, covered = 0, 0
    for k, w in enumerate(windows):
        if counts[w] > 1:
            n += k + 3 - max(covered, k)
            covered = k + 3
    return n


def judge(text: str | None) -> tuple:
    text = text or ""
    found = WORD.findall(text)
    n, chars = len(found), sum(map(len, found))
    seen, dups, lost, failed, lines = set(), 0, 0, 0, []
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own:
            dups += line in seen
            seen.add(line)
            if line_fails(line, own):
                lost += sum(map(len, own))
                failed += 1
                continue
        lines.append(line)
    repeats = repeated_words(found)
    base = n < MIN_WORDS or repeats > MAX_REPEATED * n
    kept = not base and 100 * lost <= MAX_LOST_PERCENT * chars
    clean = "\n".join(lines) if failed else text
    return n, chars, len(_SYMBOL.findall(text)), dups, repeats, lost, failed, base, kept, clean


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents with their counts, verdict and the text without failing lines.

    A null text counts as empty and fails the base rules. All input columns stay, but for those
    with the name of a new one. One pass; each row is judged on its own, whatever its length.
    """
    added = StructType.fromDDL(FIELDS)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added.names])
    schema = StructType([*kept.schema.fields, *added.fields])
    types = [_ARROW[f.dataType.simpleString()] for f in added.fields]

    def run(batches):
        for batch in (part for whole in batches for part in in_runs(whole)):
            found = [judge(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return kept.mapInArrow(run, schema)
