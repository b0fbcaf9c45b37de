"""Work per stored chunk: vectors from sparse counts, versions hashed once, line tails in linear time."""

import gzip
import html

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bugloom.functions import text
from bugloom.functions.text import clean_text
from bugloom.operators import embed
from bugloom.session import staged
from bugloom.sources import knowledge_base as kb
from bugloom.sources.tracker_csv import _headers
from tests.test_keys import records


def test_counts_become_unit_vectors(spark):
    slots = [[0, 3, 4], [], [1, 5], None, [2, 7]] * 500
    counts = [[3.0, 1.0, 7.0], [], [2.0, 2.0], None, [1.0, 2.0]] * 500
    got = embed.folded_units(
        pa.array(slots, pa.list_(pa.int32())).slice(5), pa.array(counts, pa.list_(pa.float64())).slice(5), 4
    ).to_pylist()
    norm = np.sqrt(17.0)
    want = [[-4 / norm, 0, 0, 1 / norm], [0] * 4, [0] * 4, [0] * 4,
            [0, 0, 1 / np.sqrt(5.0), -2 / np.sqrt(5.0)]] * 499
    assert len(got) == len(want) and np.array_equal(
        np.array(got, "float32"), np.array(want).astype("float32"))
    assert embed.folded_units(pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.float64())), 4).to_pylist() == []


def test_vectors_are_made_without_folds_over_all_slots(spark):
    texts = spark.createDataFrame([("Cart cart fails",), ("",), (None,), ("Ünïcode İ ٣ _x",)], "text string")
    vectors = embed.embed_text(texts, "text")
    sums = [sum(x * x for x in r["embedding"]) for r in vectors.collect()]
    assert [round(s, 5) for s in sums] == [1, 0, 0, 1]
    assert vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    plan = vectors._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "aggregate(" not in plan
    assert texts.select(embed.tokens(F.col("text")).alias("t")).collect()[3]["t"][0] == "ünïcode"


def test_tails_of_lines_are_dropped(spark):
    texts = ["a  \t\n b\u3000 \n\n\n\nc \x1c", " \n x\x85\n", "\U0001f600 \n\U0001f600 ", "a b \n", "\n \n\n \na"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(clean_text(F.col("text"))).collect()
    assert [r[0] for r in rows] == ["a\n b\n\nc", "x", "\U0001f600\n\U0001f600", "a b", "a"]
    # A run of white space inside a line was tried from each of its characters.
    long = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit("\u00a0"), 200_000), F.lit("b\n c")).alias("t"))
    assert long.select(F.length(clean_text(F.col("t")))).first()[0] == 200_005


def test_versions_are_chosen_from_staged_hashes(spark):
    rows = records(spark, [("a", "x", "one"), ("a", "x", "two"), ("a", "x", "two"), (None, "", "three")])
    with staged(kb._numbered(rows, *rows.columns), "batch") as batch:
        _check_choice(batch, kb._chosen(batch))


def _check_choice(batch, chosen):
    read = chosen._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "_version" in read and "description" not in read
    hashed = {(r["source"], r["defect_id"]): r for r in chosen.collect()}
    assert set(hashed) == {("x", "a"), (None, None)}
    least = batch.orderBy("_version", "_uid").filter("defect_id = 'a'").first()
    assert hashed[("x", "a")]["_uid"] == least["_uid"]


def test_plain_entities_stay_in_the_jvm(spark, monkeypatch):
    texts = ["&lt;a&gt; &amp;lt; &quot;x&#39;", "&amp;amp;amp;", "AT&T", "&lt", "&lt;&nbsp;", "&#60;", "&", "&ampx; &amp;", "",
             "&&lt;;", "&#39", "&lt;&#x26;lt;", "&notit; &amp;#39;", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in rows.select(text.unescape_entities(F.col("text"))).collect()]
    assert got == [None if t is None else html.unescape(t) for t in texts]
    # Only texts with another ampersand are given to Python.
    monkeypatch.setattr(text, "_unescape", lambda given: F.when(given.isNotNull(), "Python"))
    got = [r[0] for r in rows.select(text.unescape_entities(F.col("text"))).collect()]
    assert [t for t, g in zip(texts, got) if g != "Python"] == [texts[0], texts[1], "", None]


def test_headers_are_read_without_the_rows(spark, tmp_path):
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    (folder / "one.csv").write_bytes(b"\xef\xbb\xbfid,Title\r\n" + b"1,x\n" * 9)
    (folder / "two.csv.gz").write_bytes(gzip.compress(b'"id","a,b"\n2,y\n'))
    (folder / "empty.csv").write_bytes(b"")
    (folder / "bare.csv").write_bytes(b"id,Title")
    (folder / "notes.txt").write_bytes(b"no header")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    found = _headers(spark, str(folder))
    assert not jobs.getJobIdsForGroup("headers")  # a job read every line before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    names = {head: [f.rsplit("/", 1)[1] for f in files] for head, files in found.items()}
    assert names == {("id", "Title"): ["bare.csv", "one.csv"], ("id", "a,b"): ["two.csv.gz"]}
