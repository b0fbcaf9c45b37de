"""Decoding of disguised words, and held-out accuracy on invented texts."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bugloom.llm import toxicity as tox

VOCABULARY = (
    "the cat sat on a mat while old birds sing about rain over green hills people walk to market "
    "buy bread and talk with friends nasty villain rotten wretch idiot stupid letter better off"
).split()


def model():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(VOCABULARY, k=30)) for _ in range(200)]
    return tox.smoothed(tox.trigram_counts(texts, tox._sign_table()).astype(float))


def test_counts_are_of_triples():
    got = tox.trigram_counts(["ab", "AB é 1"], tox._sign_table())
    a, b, e = (tox.sign(c) for c in "abé")

    def at(*signs):
        return got[(signs[0] * tox.SIGNS + signs[1]) * tox.SIGNS + signs[2]]

    assert (at(0, 0, a), at(0, a, b), at(a, b, 0)) == (2, 2, 2)
    assert at(0, e, 0) == at(0, tox.SIGNS - 1, 0) == 1


@pytest.mark.parametrize("token, words", [
    ("1d10t", ["idiot"]), ("st0p1d", None), ("stuuuupid", ["stupid"]), ("n@sty!", ["nasty"]),
    ("v1lla1n", ["villain"]), ("i.d.i.o.t", ["idiot"]), ("r-o-t-t-e-n", ["rotten"]),
    ("i d i o t", ["idiot"]), ("letter,", ["letter"]), ("***", []), ("mat.", ["mat"]),
    ("wr3tch", ["wretch"]), ("IDIOT".lower(), ["idiot"]),
])
def test_decoding(token, words):
    got = tox.Restorer(model()).words(token)
    assert words is None or got == words


def test_restored_text():
    restorer = tox.Restorer(model())
    assert restorer.restore("The 1d10t sat on a m4t, i d i o t") == "the idiot sat on a mat idiot"
    assert restorer.restore(None) == restorer.restore(" \n") == ""
    assert len(restorer.restore("$1" * 50_000 + " " + "a " * 50_000)) > 0


def texts_and_labels(n, seed):
    rng = random.Random(seed)
    clean = VOCABULARY[:26]
    bad = ["villain", "rotten", "wretch"]
    disguise = str.maketrans("ieoa", "130@")
    rows = []
    for k in range(n):
        own = rng.choices(clean, k=rng.randint(10, 80))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w = rng.choice(bad)
                own[rng.randrange(len(own))] = w.translate(disguise) if k % 2 else w
        rows.append((k, " ".join(own), int(toxic)))
    return rows


def test_held_out_documents_are_told_apart(spark):
    rows = texts_and_labels(900, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in tox.scored(docs, labels).collect()}
    held = [(got[k], y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in held) and len(held) > 150
    assert np.mean([r["predicted"] == y for r, y in held]) > 0.95
    # Labels of the held-out fold change nothing.
    changed = labels.withColumn("toxic", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")
    ).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in tox.scored(docs, changed).collect()}
    assert again == pytest.approx({k: r["score"] for k, r in got.items()})


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, score string, label int"
    docs = spark.createDataFrame([(1, None, "s", 1), (None, "", "t", 2), (1, "x", "u", 3)], schema)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 0), (1, 1), (5, 1)], "doc_id bigint, toxic int")
    for labels in (none, odd):
        got = tox.scored(docs, labels).collect()
        assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert tox.scored(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("text, words", [
    (" ".join("youareastupidrottenvillainandaratwithouthome"), ["stupid", "rotten", "villain"]),
    ("st" + "u" * 100 + "pid", ["stupid"]), ("rotten" + "!" * 100, ["rotten"]),
    ("-".join("wretch" * 30), ["wretch"]), ("http://a.b/" + "x/" * 40 + "v1lla1n/", ["villain"]),
])
def test_long_tokens_are_decoded(text, words):
    restored = tox.Restorer(model()).restore(text)
    assert all(w in restored for w in words)


def test_long_tokens_are_read_as_by_whole_paths():
    """Settling beginnings changes no reading, and takes time in proportion to the length."""
    own, rng = model(), random.Random(5)

    def whole(token):
        states = {(0, 0): (0.0, "")}
        for options in tox.lattice(token):
            after = {}
            for (a, b), (score, text) in states.items():
                for letters, cost in options:
                    x, y, s = a, b, score + cost
                    for c in letters:
                        s += float(own[x, y, 0 if c == " " else tox.sign(c)])
                        x, y = (0, 0) if c == " " else (y, tox.sign(c))
                    if (x, y) not in after or after[x, y][0] < s:
                        after[x, y] = (s, text + letters)
            states = after
        return max((s + float(own[a, b, 0]), t) for (a, b), (s, t) in states.items())[1]

    for _ in range(20):
        token = " ".join("".join(rng.choices(VOCABULARY, k=60)).translate(str.maketrans("ieo", "130")))
        assert tox.decode(token, own) == whole(token)
    for token in ("1." * 100_000, "a " * 100_000, "$1" * 100_000):
        began = time.process_time()
        assert tox.decode(token, own)
        assert time.process_time() - began < 60


@pytest.mark.parametrize("text, restored", [
    ("you i d i o t!", "you idiot"), ("i d i o t.", "idiot"), ("i d i o t, yes", "idiot yes"),
    ("r a t now", "rat now"), ("m a t. the cat", "mat the cat"), ('"i d i o t" sat', "idiot sat"),
    ("i  d  i  o  t", "idiot"), ("i\td\ti\to\tt", "idiot"), ("i\nd\ni\no\nt\n", "idiot"),
    ("i \t d\n\ni o  t ?!", "idiot"), ("stuupid", "stupid"), ("rottten", "rotten"),
    ("nnasty, viillain", "nasty villain"), ("letter better off hills", "letter better off hills"),
    ("a cat", "a cat"), ("( a t", "cat"),
])
def test_disguises_at_the_gates(text, restored):
    got = tox.Restorer(model()).restore(text)
    assert got == restored


@pytest.mark.parametrize("text", [
    "a a" + " " * 200_000 + "bb", "a " * 100_000 + "bb", "a a a" + "." * 200_000 + "bb",
    "(" * 200_000 + "a", ". " * 100_000 + "bb", "a\t\n" * 100_000, "(a " * 50_000,
])
def test_gates_take_no_time(text):
    began = time.process_time()
    tox.tokens(text)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("n", range(62, 68))
def test_one_rule_for_all_lengths(n):
    """Words at the ends of a token are read alike whatever its length."""
    token = ("v1lla1n/" + "ab1-" * 30)[:n - 8] + "/v1lla1n"
    got = tox.Restorer(model()).words(token)
    assert len(token) == n and got[0] == got[-1] == "villain"


def test_doubled_letters_are_read_as_by_the_lattice():
    own, rng = model(), random.Random(6)
    words = {"".join(c * rng.choice((1, 1, 2)) for c in w) for w in VOCABULARY for _ in range(40)}
    for word in words:
        if not tox._STRETCH.search(word):
            assert tox.single_or_twice(word, own.tolist()) == tox.decode(word, own.tolist())
