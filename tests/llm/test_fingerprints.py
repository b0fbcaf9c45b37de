"""Sketches against a plain calculation with the xxhash library."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from bugloom.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string"


def hash_of(values: list[int]) -> int:
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed=seed)
    return seed


def shingles(text: str) -> set[int]:
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    own = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in found]
    if len(own) < 5:
        return {hash_of(own)} if own else set()
    return {hash_of(own[k:k + 5]) for k in range(len(own) - 4)}


def sketch(text: str) -> set[int]:
    all_hashes = shingles(text)
    low = {h for h in all_hashes if h >> 62 == 0}
    signed = sorted(all_hashes, key=lambda h: h - 2**64 if h >> 63 else h)
    return low or set(signed[:1])


def like(a: set, b: set) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def expected(rows: list[tuple]) -> dict:
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        out[i] = (
            edited,
            sketch(text),
            like(sketch(text), sketch(edited)),
            like(sketch(text), sketch(following)),
        )
    return out


TEXTS = [
    "one two three four five six seven eight nine ten eleven twelve",
    None,
    "",
    "short text",
    " \t\n\x0b ",
    "ÉCOLE straße ñandú " * 7,
    " only one word",
    "😀 emoji 😀 pair 😀 again 😀 and 😀 so on",
    "w " * 3000,
    " ".join(f"t{k}" for k in range(4000)),
    "one two three four five six seven eight nine ten eleven twelve",
]


@pytest.mark.parametrize("parts", [1, 2, 3, 50])
def test_like_brute_force(spark, parts):
    rows = [(7 * k - 20, t) for k, t in enumerate(TEXTS)]
    want = expected(rows)
    got = fp.fingerprints(spark.createDataFrame(rows, SCHEMA), parts).select(
        "doc_id", "edited_text", "hashes",
        fp.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        fp.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        edited, own, near_edited, near_next = want[r["doc_id"]]
        assert r["edited_text"] == edited
        assert {h % 2**64 for h in r["hashes"]} == own
        assert r["near_edited"] == pytest.approx(near_edited)
        assert r["near_next"] == pytest.approx(near_next)


def test_empty_null_ids_and_repeats(spark):
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f"), (1, "x"), (1, "x"), (1, "y"), (None, None)]
    got = fp.fingerprints(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert len(got) == 5
    # The lowest row of all, a null id with the least text, is followed by the highest.
    last = next(r for r in got if r["doc_id"] is None and r["text"] == "")
    assert [h for h in last["next_hashes"]] == [
        h for r in got if r["text"] == "y" for h in r["hashes"]
    ]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "z")], "doc_id bigint, text string, _key int, hashes string")
    assert fp.fingerprints(docs).count() == 1


def test_merged_sketch_and_containment(spark):
    long = " ".join(f"w{k}" for k in range(2000))
    part = " ".join(f"w{k}" for k in range(500, 1000))
    df = spark.createDataFrame([(long, part)], "a string, b string").select(
        fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b")
    )
    r = df.select(
        fp.containment(F.col("b"), F.col("a")).alias("inside"),
        fp.containment(F.col("a"), F.col("b")).alias("outside"),
        (fp.merge(F.col("a"), F.col("b")) == F.col("a")).alias("same"),
    ).first()
    assert r["inside"] == 1 and r["same"] and 0.15 < r["outside"] < 0.35


def test_sha_is_of_the_edited_text(spark):
    got = fp.fingerprints(spark.createDataFrame([(2, "abcd"), (1, "xyz")], SCHEMA))
    shas = {r[0]: r[1] for r in got.select("doc_id", F.sha2("edited_text", 256)).collect()}
    assert shas[2] == hashlib.sha256(b"abxy").hexdigest()
    assert shas[1] == hashlib.sha256(b"xya").hexdigest()
