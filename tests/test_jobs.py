import pytest
from pyspark.sql import functions as F

from bugloom.operators import chunk, parse, patterns, stats, triage
from bugloom.plans.analyze import analyze
from bugloom.plans.build import build_kb, build_real_kb
from bugloom.schema import combined_text, to_metadata, to_records
from bugloom.sources.knowledge_base import (
    append_chunks,
    append_records,
    count_chunks,
    read_kb,
    reset_kb,
)
from bugloom.streaming.jobs import (
    keep_level_counts,
    level_counts_by_window,
    maintain_kb,
    match_submissions,
    read_level_counts,
    read_matches,
)
from tests.test_sources import BUGZILLA, JIRA


def _records(spark, rows):
    columns = "defect_id string, source string, title string, description string, " \
        "component string, resolution_note string, severity string"
    return to_records(spark.createDataFrame(rows, columns))


ROWS = [
    ("apache-1", "apache", "Cart fails", "word " * 400, "Cart", "Reload it", "major"),
    ("apache-2", "apache", "Login slow", "", "", "", "minor"),
    ("eclipse-3", "eclipse", "", "", "", "", "unknown"),
]


def test_chunks_of_records(spark):
    rows = {}
    for row in chunk.chunk_defects(_records(spark, ROWS)).collect():
        rows.setdefault(row.defect_id, []).append(row)
    text = "[apache] Cart fails\nCart fails\n" + ROWS[0][3] + "\nResolution: Reload it\nComponent: Cart"
    got = sorted(rows["apache-1"], key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in got] == list(range(len(got))) and {r.n_chunks for r in got} == {len(got)}
    assert got[0].text.startswith("[apache] Cart fails\nCart fails\nword word") and len(got) == 3
    assert got[-1].text.endswith("word\n\nResolution: Reload it\nComponent: Cart") or got[-1].text.endswith(
        "word\nResolution: Reload it\nComponent: Cart")
    assert all(len(r.text) <= 800 and r.text in text.replace(" \n", "\n") for r in got)
    assert got[1].chunk_id == "apache-1::chunk1" and got[1].component == "Cart"
    assert rows["apache-2"][0].component is None and rows["apache-2"][0].resolution == "unknown"
    assert rows["eclipse-3"][0].text == "[eclipse]"


def test_combined_text_and_metadata(spark):
    records = _records(spark, ROWS[1:2])
    assert records.select(combined_text()).first()[0] == "[apache] Login slow\nLogin slow"
    row = to_metadata(records).first()
    assert len(row) == 14 and row.has_stack_trace is False and row.keywords is None


def _chunk_sets(spark, path):
    found = {}
    for r in read_kb(spark, path).collect():
        found.setdefault((r.source, r.defect_id), []).append(r)
    return found


def test_append_takes_one_version_of_a_record(spark, tmp_path):
    long, short = "long words " * 400, "short words " * 150
    versions = [("x-1", "apache", "A", long, "", "", "major"), ("x-1", "apache", "A", short, "", "", "major"),
                ("x-1", "mozilla", "M", short, "", "", "major"), ("y-2", "apache", "Y", short, "", "", "minor")]
    path = str(tmp_path / "kb")
    append_records(_records(spark, versions[:3] + versions[1:2]), path)
    first = _chunk_sets(spark, path)
    append_records(_records(spark, [versions[1], versions[0], versions[3]]), path)
    append_chunks(chunk.chunk_defects(_records(spark, versions)), path)
    found = _chunk_sets(spark, path)
    assert set(found) == {("apache", "x-1"), ("mozilla", "x-1"), ("apache", "y-2")}
    for key, rows in found.items():
        assert {r.n_chunks for r in rows} == {len(rows)}
        assert sorted(r.chunk_index for r in rows) == list(range(len(rows)))
        assert len({("long" in r.text, "short" in r.text) for r in rows}) == 1
    assert all(len(found[k]) == len(first[k]) for k in first)


def test_append_inserts_only_absent_ids(spark, tmp_path):
    path = str(tmp_path / "kb")
    chunks = chunk.chunk_defects(_records(spark, ROWS))
    assert count_chunks(spark, path) == 0
    append_chunks(chunks.filter("source = 'apache'"), path)
    before = count_chunks(spark, path)
    append_chunks(chunks.unionByName(chunks), path)
    assert count_chunks(spark, path) == before + 1
    append_chunks(chunks, path)
    append_chunks(chunks.limit(0), path)
    assert count_chunks(spark, path) == before + 1
    assert read_kb(spark, path).filter("size(embedding) <> 384").count() == 0
    reset_kb(spark, path)
    assert count_chunks(spark, path) == 0


def test_breakdowns(spark):
    chunks = chunk.chunk_defects(_records(spark, ROWS))
    n = chunks.count()
    totals = stats.kb_totals(chunks).first()
    assert (totals.chunks, totals.unique_defects, totals.with_stack_trace) == (n, 3, 0)
    per_chunk = {(r.dimension, r.value): r.n for r in stats.kb_breakdown(chunks).collect()}
    assert per_chunk[("source", "apache")] == n - 1
    unknown = chunks.withColumn("severity", F.lit(None).cast("string"))
    assert {r.value for r in stats.kb_breakdown(unknown, ("severity",)).collect()} == {"?"}
    per_defect = stats.kb_breakdown(chunks, per="defect")
    assert {(r.dimension, r.value): r.n for r in per_defect.collect()}[("source", "apache")] == 2


@pytest.fixture()
def exports(tmp_path):
    (tmp_path / "apache_issues.csv").write_text(JIRA)
    (tmp_path / "eclipse_bugs.csv").write_text(BUGZILLA)
    return {s: str(tmp_path / f) for s, f in
            (("apache", "apache_issues.csv"), ("eclipse", "eclipse_bugs.csv"),
             ("mozilla", "absent.csv"))}


def test_build(spark, exports, tmp_path):
    path = str(tmp_path / "kb")
    with pytest.raises(FileNotFoundError):
        build_kb(spark, exports, path)
    built = build_real_kb(spark, exports, path)
    assert {(r.source, r.records) for r in built.loaded.collect()} == {("apache", 3), ("eclipse", 2)}
    again = build_kb(
        spark, exports, path, limit=1, reset=True, skip_missing=True, query="cart is empty"
    )
    assert again.totals.first().unique_defects == 2
    assert again.answers.orderBy("rank").first().defect_id == "eclipse-11"


def test_analysis_routes(spark, exports, tmp_path):
    path = str(tmp_path / "kb")
    kb = build_kb(spark, exports, path, skip_missing=True).kb
    submissions = spark.createDataFrame(
        [
            ("same", "Steps to reproduce: cart is empty again cart is empty again see 11"),
            ("new", "expected the printer to print my large invoices in colour"),
            ("blank", " "), ("short", "hello"),
        ],
        "submission_id string, raw_text string",
    ).withColumn("source_filename", F.lit(None).cast("string"))
    found = analyze(submissions, kb, str(tmp_path / "out"), threshold=0.5)
    routes = {r.submission_id: r for r in found.routing.collect()}
    assert {n: r.route for n, r in routes.items()} == {
        "same": "report", "new": "root_cause", "blank": "reject", "short": "reject",
    }
    # The best hit is itself a duplicate: its original is named.
    assert routes["same"].canonical_defect == "eclipse-11"
    assert {r.submission_id for r in found.hits.collect()} == {"same", "new"}
    notes = found.notes.collect()
    assert {r.submission_id for r in notes} == {"new"}
    assert {r.resolution_note for r in notes} == {"Reload it"}


def test_log_findings(spark):
    text = "[a] INFO up\n[b] ERROR bad one\n[c] FATAL worse\na.b.CException: x\n\tat a.b.C.d(C.java:1)"
    parsed = parse.parse_submissions(
        spark.createDataFrame([(1, None, text)], "submission_id int, source_filename string, raw_text string")
    )
    row = triage.log_findings(parsed).first()
    assert row.salient_errors == ["bad one", "worse"] and row.n_log_lines == 3
    assert row.root_exception == "a.b.CException" and row.level_counts["INFO"] == 1


def test_patterns(spark):
    records = _records(spark, ROWS).withColumn(
        "duplicate_of", F.when(F.col("defect_id") != "eclipse-3", F.lit("eclipse-3"))
    ).withColumn("created_at", F.lit("2020-01-02"))
    family = patterns.duplicate_families(records).first()
    assert (family.canonical, family.duplicates, family.known) == ("eclipse-3", 2, True)
    cube = {(r.source, r.component, r.month): r.defects for r in patterns.defect_cube(records).collect()}
    assert cube[(None, None, None)] == 3 and cube[("apache", "Cart", "2020-01")] == 1


def test_streams(spark, tmp_path):
    kb, out = str(tmp_path / "kb"), str(tmp_path / "out")
    inbox, records = tmp_path / "inbox", tmp_path / "records"
    _records(spark, ROWS).write.parquet(str(records))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(_records(spark, []).schema).parquet(str(records))
        maintain_kb(stream, kb, str(tmp_path / "s1"), once=True).awaitTermination()
    n = count_chunks(spark, kb)
    assert n == chunk.chunk_defects(_records(spark, ROWS)).count()
    # A new checkpoint replays everything, and still inserts nothing twice.
    stream = spark.readStream.schema(_records(spark, []).schema).parquet(str(records))
    maintain_kb(stream, kb, str(tmp_path / "s2"), once=True).awaitTermination()
    assert count_chunks(spark, kb) == n

    from bugloom.sources.submissions import stream_submissions

    inbox.mkdir()
    (inbox / "a.txt").write_text("expected: login is slow")
    for name in ("b.txt", "c.bin"):
        match_submissions(
            stream_submissions(spark, str(inbox)), kb, out, str(tmp_path / "s3"), once=True
        ).awaitTermination()
        (inbox / name).write_text("cart fails")
    match_submissions(
        stream_submissions(spark, str(inbox)), kb, out, str(tmp_path / "s3"), once=True
    ).awaitTermination()
    hits = read_matches(spark, out).collect()
    assert {r.submission_id.split("/")[-1] for r in hits} == {"a.txt", "b.txt"}
    # A new checkpoint on the same output replaces and repeats nothing.
    match_submissions(
        stream_submissions(spark, str(inbox)), kb, out, str(tmp_path / "s4"), once=True
    ).awaitTermination()
    assert sorted(map(str, read_matches(spark, out).collect())) == sorted(map(str, hits))


def test_level_windows_of_a_stream_hold_the_open_ones(spark, tmp_path):
    lines = spark.sql(
        "SELECT timestamp'2024-01-01 10:05:00' + make_interval(0,0,0,0,0,id*40) AS ts,"
        " '[x] WARN again' AS line FROM range(5)"
    )
    for part in (0, 1):
        lines.filter(F.minute("ts") % 2 == part).write.mode("append").parquet(str(tmp_path / "lines"))
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(
            str(tmp_path / "lines"))
        with pytest.raises(ValueError):
            level_counts_by_window(stream, "ts")
        counts = level_counts_by_window(stream, "ts", late="1 day")
        keep_level_counts(counts, str(tmp_path / "out"), str(tmp_path / "s"), once=True).awaitTermination()
    got = read_level_counts(spark, str(tmp_path / "out")).select("window_start", "level", "n")
    want = level_counts_by_window(lines, "ts").select("window_start", "level", "n")
    assert sorted(got.collect()) == sorted(want.collect())


def test_level_windows_of_a_table(spark):
    lines = spark.sql(
        "SELECT timestamp'2024-01-01 10:05:00' + make_interval(0,0,0,0,0,id*40) AS ts,"
        " CASE WHEN id = 2 THEN 'nothing' ELSE '[x] WARN again' END AS line FROM range(4)"
    )
    rows = level_counts_by_window(lines, "ts").orderBy("window_start").collect()
    assert [(r.window_start.hour, r.level, r.n) for r in rows] == [
        (10, "WARNING", 2), (12, "WARNING", 1),
    ]
