import random

from bugloom import vocabulary as V
from bugloom.operators import parse

LINES = [
    "Traceback (most recent call last):", "Traceback (most recent call last): again",
    '  File "a/b.py", line 12, in <module>', '  File "c.py", line 7, in run.it',
    '\tFile "d.py", line 7', "    value = load(x)", "    ~~~~^^^", "FileNotFoundError: gone",
    "ValueError: bad  ", "pkg.mod.OddTimeout", "KeyboardInterrupt", "Error",
    "During handling of the above exception, another exception occurred:", "", "   ", " ",
    'Exception in thread "main" java.lang.NullPointerException: oops',
    "com.acme.Deep.InnerException", "  org.x.YError: msg: more", "Caused by: a.b.CException: x",
    "  Caused by: a.b.DException", "Caused by: plain", "\tat com.acme.Foo.bar(Foo.java:42)",
    "\tat com.acme.Baz$Q.<init>(Native Method)", "  at Top(X.java:abc)", "\tat .odd.(:3)",
    "    at Object.run (/srv/app/index.js:10:5)", "    at /srv/app/lib.js:3:1",
    "  at  (x.js:1:2)", "TypeError: Cannot read x", "panic: boom", "panic:boom",
    "goroutine 1 [running]:", "main.go:12 +0x1f", "x.rb:3:in `y'", "(SomeError)",
    "System.NullReferenceException: z", "node_modules/x",
    "2024-01-02 03:04:05,123 INFO  [main] com.acme.svc.App - started up fine",
    "2024-01-02T03:04:06.5Z ERROR com.acme.svc.Worker: failed", "[x] WARN retry",
    "  [y] ERR: no 10.0.0.1 answer", "WARNING only", "2024-01-02 03:04:05 INFORMATION",
    "2024-01-02 03:04:05+01:00 SEVERE] x", "# Title of it", "## Steps to reproduce", "##   ",
    "#", "Summary: short one", "**Expected:** works", "Expected result ** : fine",
    "actual: E1234 and ORA-00942", "Note: kept", "Severity： high", "environment:",
    "it was unexpectedly broken", "one two three four five six seven",
    "one two three/four/five six seven eight nine", "at one two three four five six",
    "see src/a/b.py and x.java, also http.cpp", "HTTP 500 status code: 404 errno = 5",
    "SQLSTATE[42S02]: x SQLSTATE[42S02]y 0xDEADBEEF E12", "café ERROR niño²",
    "a\x0bb\x0cc", "p\x1cq", "u v", "tail\x85next", "WARN [x] 2024-01-02 03:04:05",
]
ENDS = ["\n", "\n", "\n", "\n", "\r\n", "\r"]


def _texts():
    rng = random.Random(7)
    texts = ["", "\n", "  \n\t", "x"]
    groups = [LINES, LINES[:13], LINES[13:26] + LINES[:1], LINES[26:40], LINES[40:46],
              LINES[46:66]]
    for i in range(600):
        pool = groups[i % len(groups)]
        n = rng.randint(1, 14)
        texts.append("".join(rng.choice(pool) + rng.choice(ENDS) for _ in range(n)))
    return texts


def _table(spark, texts):
    return spark.createDataFrame(
        [(i, None, t) for i, t in enumerate(texts)],
        "submission_id long, source_filename string, raw_text string",
    ).repartition(4)


def test_random_submissions_keep_their_counts_and_places(spark):
    """Whatever the text: what is found lies in it, and the counts add up."""
    texts = _texts()
    rows = parse.parse_submissions(_table(spark, texts)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        got, text = row.asDict(recursive=True), texts[row["submission_id"]]
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        assert got["raw_text"] == text and got["char_count"] == len(text)
        assert got["line_count"] == text.count("\n") + 1
        assert sum(got["log_level_counts"].values()) == len(got["log_entries"])
        assert set(got["log_level_counts"]) == {e["level"] for e in got["log_entries"]}
        chain = got["exceptions"]
        assert got["root_cause"] == (chain[-1] if chain else None)
        for e in chain:
            assert e["exception_type"] in text and e["message"] in text
            assert all(f["raw"] in text for f in e["frames"])
        for entry in got["log_entries"]:
            assert entry["raw"] in text and entry["message"] in entry["raw"]
            assert (entry["timestamp"] or "") in entry["raw"]
        signals = [s.lower() for s in got["key_signals"]]
        assert len(signals) == len(set(signals)) and "" not in signals
        assert all(e["exception_type"].lower() in signals for e in chain if e["exception_type"])
        assert (got["artifact_type"] == "unknown") or text.strip()
        for name, value in got["bug_fields"].items():
            assert name in V.FIELD_NAMES and (value or name == "summary")
        assert bool(got["title"]) <= bool(text.strip())
        if got["title"]:
            assert got["normalized_text"].startswith(got["title"])


PUBLISHED = V.PUBLISHED_CAPS
LONG = (
    "".join(f"E{k}Error: no {k}\n" + "".join(f"    at f{j} (/s/m{k}.js:{j + 1}:2)\n" for j in range(6))
            for k in range(8))
    + " ".join(f"see src/a{k}.py" for k in range(30))
)


def test_nothing_is_cut_unless_asked_for(spark):
    whole = parse.parse_submissions(_table(spark, [LONG, "word " * 2000])).collect()
    capped = parse.parse_submissions(_table(spark, [LONG, "word " * 2000]), PUBLISHED).collect()
    whole, capped = sorted(whole), sorted(capped)
    assert len(whole[0].exceptions) == 8 and len(capped[0].exceptions) == 3
    # Eight types, six functions, thirty-eight files; capped: three types, three functions, one file.
    assert len(whole[0].key_signals) == 52 and len(capped[0].key_signals) == 7
    assert "src/a29.py" in whole[0].key_signals
    assert "in f0 -> f1 -> f2 -> f3 -> f4 -> f5" in whole[0].normalized_text
    assert len(whole[1].title) == len("word " * 2000) - 1 and len(capped[1].title) == 200
    assert len(capped[0].normalized_text) <= 4000


def test_python_trace(spark):
    text = (
        "Traceback (most recent call last):\n"
        '  File "job.py", line 3, in <module>\n    go()\n'
        '  File "job.py", line 9, in go\n    return 1 / 0\n'
        "ZeroDivisionError: division by zero"
    )
    row = parse.parse_submissions(_table(spark, [text])).first()
    assert (row.artifact_type, row.language) == ("stack_trace", "python")
    assert row.root_cause.exception_type == "ZeroDivisionError"
    assert [f.function for f in row.exceptions[0].frames] == ["<module>", "go"]
    assert "ZeroDivisionError" in row.key_signals
    record = parse.submission_records(parse.parse_submissions(_table(spark, [text]))).first()
    assert record.source == "user_submission" and record.has_stack_trace
    assert record.defect_id == "submission-0"


def test_java_chain_of_two(spark):
    text = (
        'Exception in thread "main" java.lang.IllegalArgumentException: no\n'
        "\tat org.acme.App.start(App.java:21)\n"
        "Caused by: java.io.UncheckedIOException: disk\n\tat org.acme.Io.read(Io.java:5)"
    )
    row = parse.parse_submissions(_table(spark, [text])).first()
    first, second = row.exceptions
    assert (first.frames[0].file, first.frames[0].line) == ("App.java", 21)
    assert second.is_cause and not first.is_cause
    assert row.root_cause.exception_type == "java.io.UncheckedIOException"


def test_level_counts(spark):
    text = (
        "2023-11-05 14:23:01,123 INFO  [m] a.b.C - up\n"
        "2023-11-05 14:23:02,456 ERROR [p] a.b.D - failed\n"
        "2023-11-05 14:23:03,789 WARN  [m] a.b.C - again"
    )
    row = parse.parse_submissions(_table(spark, [text])).first()
    assert row.artifact_type == "error_log"
    assert row.log_level_counts == {"INFO": 1, "ERROR": 1, "WARNING": 1}


def test_report_and_mixed(spark):
    report = "# Export hangs\n## Steps to reproduce\n1. go\n## Expected\nfile\n## Actual\nnone"
    trace = "Caused by: a.b.CException: x\n\tat a.b.C.d(C.java:1)"
    first, second = sorted(
        parse.parse_submissions(_table(spark, [report, report + "\n\n" + trace])).collect()
    )
    assert first.artifact_type == "bug_report" and second.artifact_type == "mixed"
    assert first.title == "Export hangs"
    assert set(first.bug_fields) == {"summary", "steps_to_reproduce", "expected", "actual"}


def test_empty_text(spark):
    row = parse.parse_submissions(_table(spark, [None])).first()
    assert row.artifact_type == "unknown" and row.normalized_text == ""


def test_neighbours_do_not_matter(spark):
    texts = _texts()[:60]
    together = {r.submission_id: r for r in parse.parse_submissions(_table(spark, texts)).collect()}
    alone = parse.parse_submissions(_table(spark, texts[40:41])).first()
    assert alone.asDict(True) | {"submission_id": 40} == together[40].asDict(True)


def test_parsing_does_not_shuffle(spark):
    table = spark.range(3).selectExpr(
        "id AS submission_id", "'' AS source_filename", "string(id) AS raw_text"
    )
    plan = parse.parse_submissions(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_extreme_texts(spark):
    names = "a." * 20_000
    run = "x" * 100_000
    texts = [
        f"[x] ERROR {names}b failed", f"[x] ERROR {run}", f"at {names}c(", f"{names}Exception: x",
        f"Caused by: {names}DError", "\n" * 10_000 + "x", "a/b-c." * 5_000 + "py", f"# {run}",
        "Caused by: x\n" + "\tat a.b.C.d(E.java:1)\n" * 2_000,
    ]
    rows = parse.parse_submissions(_table(spark, texts)).collect()
    by_id = {r.submission_id: r for r in rows}
    assert by_id[0].log_entries[0].logger == names + "b"
    assert by_id[2].language == "java" and by_id[4].exceptions[0].is_cause
    assert by_id[6].key_signals == [texts[6]]
    assert len(rows) == len(texts)


def test_dotted_names(spark):
    lines = ["[x] ERROR see com.acme.Cart. Then", "[x] ERROR a.b. c", "[x] ERROR .a.b.c", 
             "[x] ERROR (a$b.c.d..e.f.g)", "[x] ERROR a..b.c.d-x", "[x] ERROR 10.0.0.1:80"]
    rows = sorted(parse.parse_submissions(_table(spark, lines)).collect())
    assert [[e.logger for e in r.log_entries] for r in rows] == [
        ["com.acme.Cart"], [None], ["a.b.c"], ["a$b.c.d"], ["b.c.d"], ["10.0.0.1"],
    ]
    assert [r.log_entries[0].message for r in rows][:2] == ["see com.acme.Cart. Then", "a.b. c"]
