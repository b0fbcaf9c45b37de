import random

import pytest
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions import vocab_maps as M
from bugloom.functions.chunks import split_text
from bugloom.functions.language import detect_language
from bugloom.functions.regex import split_lines
from bugloom.functions.text import clean_text, has_trace

PIECES = [
    "a", "word", "  ", "\t", "\n", "\n\n\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0",
    "<b>", "<", ">", "List<String>", "&amp;", "&amp;lt;i&amp;gt;", "&copy", "&#39;", "&#x41;",
    "&notit;", "&", "é", "漢字", "\U0001f600", "http://x.y/z?a=1", "me@mail.example.org,",
    "x.y+z@a-b.co", "@", ".", "-", "²a@b.cd",
]


def _texts(n, seed, longest=60):
    rng = random.Random(seed)
    return [""] + ["".join(rng.choices(PIECES, k=rng.randint(1, longest))) for _ in range(n)]


def _column(spark, texts, *columns):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "i int, t string").repartition(4)
    return [r[1:] for r in sorted(df.select("i", *columns).collect())]


CLEANED = [
    ("a &amp; b", "a & b"), ("&lt;b&gt;x", "x"), ("one<br>two", "one two"), (" \t a \t b ", "a b"),
    ("a\r\nb\rc", "a\nb\nc"), ("a\n\n\n\nb", "a\n\nb"), ("a  \nb", "a\nb"), ("\xa0x\u2003", "x"),
    ("&copy 5 &#39;&#x41;", "© 5 'A"), ("&notit; &nosuch;", "¬it; &nosuch;"), ("List<String>", "List"),
    ("a < b", "a < b"), ("é\x0b漢\x0c字", "é 漢 字"), (None, ""), ("", ""),
    ("see http://x.y/z?a=1 now", "see http://x.y/z?a=1 now"),
]


def test_clean_text(spark):
    got = _column(spark, [t for t, _ in CLEANED], clean_text(F.col("t")))
    assert [r[0] for r in got] == [want for _, want in CLEANED]


def test_redaction(spark):
    texts = ["see http://x.y/z?a=1 now", "mail me@mail.example.org, or x.y+z@a-b.co", "a@b no", "@."]
    got = [r[0] for r in _column(spark, texts, clean_text(F.col("t"), redact=True))]
    assert got == ["see <url> now", "mail <email>, or <email>", "a@b no", "@."]


def test_cleaned_texts_are_clean_and_whole(spark):
    texts = _texts(500, 1) + ["word " * 30_000]
    got = _column(spark, texts, clean_text(F.col("t")), clean_text(F.col("t"), max_chars=9))
    for text, (clean, short) in zip(texts, got):
        assert clean == clean.strip() and short == clean[:9]
        assert "\r" not in clean and "\n\n\n" not in clean and "  " not in clean and "\t" not in clean
        assert clean.count("漢字") == text.count("漢字") or "<" in text
    assert len(got[-1][0]) == 5 * 30_000 - 1


def test_cleaning_twice_resolves_doubled_entities(spark):
    twice = clean_text(clean_text(F.col("t")))
    assert _column(spark, ["&amp;lt;b&amp;gt;x", None], twice) == [("x",), ("",)]


@pytest.mark.parametrize("size,overlap", [(12, 11), (5, 9), (6, 5)])
def test_pieces_with_wide_overlaps(spark, size, overlap):
    texts = [t.replace("\t", " ") for t in _texts(150, size, 80)] + ["x" * 333, "a b " * 90]
    got = _column(spark, texts, split_text(F.col("t"), size, overlap))
    for text, (pieces,) in zip(texts, got):
        body = text.strip()
        assert all(p == p.strip() and 0 < len(p) <= size and p in body for p in pieces)
        if body:
            assert body.startswith(pieces[0]) and body.endswith(pieces[-1])


@pytest.mark.parametrize("size,overlap", [(50, 10), (30, 10), (40, 0), (40, 20)])
def test_pieces_cover_the_text(spark, size, overlap):
    texts = [t.replace("\t", " ") for t in _texts(150, size, 80)] + ["x" * 333, "a b " * 90]
    got = _column(spark, texts, split_text(F.col("t"), size, overlap))
    for text, (pieces,) in zip(texts, got):
        body, at = text.strip(), 0
        if len(body) <= size:
            assert pieces == ([body] if body else [])
            continue
        # Without white space, the pieces laid over one another spell the text.
        bare = "".join(body.split())
        for piece in pieces:
            own = "".join(piece.split())
            assert piece and piece == piece.strip() and len(piece) <= size
            starts = [k for k in range(max(0, at - size), at + 1) if bare.startswith(own, k)]
            assert starts, (text, piece)
            at = max(at, starts[-1] + len(own))
        assert at == len(bare)


def test_pieces_by_hand(spark):
    texts = ["aaa bbb ccc ddd", "abcdefghij", "one two\nthree four"]
    got = [r[0] for r in _column(spark, texts, split_text(F.col("t"), 8, 0))]
    assert got == [["aaa bbb", "ccc ddd"], ["abcdefgh", "ij"], ["one two", "three fo", "ur"]]


def test_split_text_short_and_long(spark):
    long = " ".join(f"word{i}" for i in range(1000))
    got = _column(spark, ["short text", long], split_text(F.col("t"), 200, 40))
    assert got[0][0] == ["short text"]
    assert len(got[1][0]) > 1 and all(len(p) <= 200 for p in got[1][0])


def test_lines_and_language(spark):
    known = [("Traceback (most recent call last):\n  File \"x.py\", line 2, in f", "python"),
             ("\tat com.acme.A.b(A.java:3)\nCaused by: x.YException: z", "java"), ("plain words", None)]
    texts = _texts(200, 3) + ["a\n", "\n", "a\r\nb", *[t for t, _ in known]]
    got = _column(spark, texts, split_lines(F.col("t")), detect_language(F.col("t")))
    for text, (lines, language) in zip(texts, got):
        assert lines == (text.splitlines() or [""]), repr(text)
    assert [r[1] for r in got[-3:]] == [name for _, name in known]


def test_trace_flag(spark):
    texts = ["x Caused by: y", "at a.b.c(", "at a.b(", "no\npanic: x", " panic: x", None]
    got = [r[0] for r in _column(spark, texts, has_trace(F.col("t")))]
    assert got == [True, True, False, True, False, False]


def test_vocabularies(spark):
    values = ["Reopened", "UNCONFIRMED", "abandoned", "", "Won't Fix", " P1 ", "normal", "Blocker",
              "new feature", "change", None]
    got = _column(
        spark, values, M.map_status(F.col("t")), M.map_resolution(F.col("t")),
        M.map_priority(F.col("t")), M.map_severity(F.col("t")), M.map_jira_severity(F.col("t")),
        M.guess_severity(F.coalesce("t", F.lit(""))),
    )
    by_value = dict(zip(values, got))
    assert by_value["Reopened"][0] == "open"
    assert by_value["UNCONFIRMED"][0] == "new"
    assert by_value["abandoned"][1] == "done"
    assert by_value[""][1] == by_value[None][1] == "unresolved"
    assert by_value["Won't Fix"][1] == "wontfix"
    assert by_value[" P1 "][2] == "P1" and by_value["normal"][2] == "P3"
    assert by_value["new feature"][3] == "enhancement"
    assert by_value["Blocker"][4] == "blocker"
    assert by_value["change"][5] == "critical"  # "hang" inside a word


def test_mapped_values_stay_in_their_domains():
    assert {v for _, v in V.SEVERITY_NEEDLES} <= set(V.SEVERITIES)
    assert {v for _, v in V.STATUS_NEEDLES} <= set(V.STATUSES)
    assert {v for _, v in V.RESOLUTION_NEEDLES} <= set(V.RESOLUTIONS)
    assert set(V.PRIORITY_NAMES.values()) <= set(V.PRIORITIES)
