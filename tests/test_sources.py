import gzip

import pytest
from pyspark.sql import functions as F

from bugloom.operators.normalize import normalize_headers, normalize_jira
from bugloom.sources.load import load_all, load_source, sample_paths
from bugloom.sources.submissions import read_log_lines, read_submissions
from bugloom.sources.tracker_csv import read_export
from catalog import queries

JIRA = '''Key , Project,issuetype.name,Summary,description,priority,status,resolution,components,"duplicate_of",resolution_note
AB-1,,Bug,"t1 &lt;b&gt; ""q""","Traceback (most recent call last):
  File ""x.py"", line 2, in f",Blocker,Reopened,Won't Fix,comp,AB-9,note <b>x</b>
AB-2,P,Improvement,t2,d,Major,Open,,c,,
,P,Bug,noid,d,Major,Open,,c,,
AB-3,P,Sub Bug,short,row
AB-4,P,Bug,long,row,Major,Open,,c,,n,extra
AB-5,P,Bug,"long, quoted","a,b",Major,Open,,c,,n,,,
AB-6,P,defect,NULL,NaN,Critical,closed,,c,,n
'''
BUGZILLA = '''bug_id,product,component,bug_severity,priority,short_desc,description,bug_status,resolution,dup_id,resolution_note,reporter,assigned_to,creation_ts,delta_ts
11,Shop,Cart,major,P2,Cart is empty,,RESOLVED,FIXED,,Reload it,ann,bob,2020-01-02,2020-02-01
12,Shop,Cart,normal,P3,Cart is empty again,see 11,RESOLVED,DUPLICATE,11,,cid,bob,2020-01-03,
 ,Shop,Cart,normal,P3,no id,,NEW,,,,,,,
'''
XML = {
    "Prod + B": {
        "reports": '<reports><report id="1"><opening_time>10</opening_time><reporter>bob'
        '</reporter></report><report id="2"><opening_time>11</opening_time></report>'
        '<report id="3"/><report><opening_time>1</opening_time></report>'
        '<report id="1"><opening_time>12</opening_time></report></reports>',
        "short_desc": '<short_desc><report id="1"><update><when>1</when><what>old</what></update>'
        "<update><what> new &amp;lt;b&amp;gt; &amp; x </what></update></report>"
        '<report id="2"><update><what>A</what></update><update><what/></update></report>'
        '<report id="3"><update><what>three</what></update><update><when>2</when></update>'
        '</report><report id="9"><update><what>orphan</what></update></report></short_desc>',
        "severity": '<severity><report id="1"><update><what>critical</what></update></report>'
        '<report id="3"/></severity>',
    },
    "A": {
        "reports": '<reports><report id="1"><reporter>z</reporter></report></reports>',
        "short_desc": '<short_desc><report id="1"><update><what>first</what></update></report>'
        "</short_desc>",
    },
    "C": {
        "short_desc": '<short_desc><report id="1"><update><what>no base</what></update></report>'
        "</short_desc>",
    },
}


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    base = tmp_path_factory.mktemp("exports")
    (base / "apache_issues.csv").write_text(JIRA)
    (base / "eclipse_bugs.csv").write_text(BUGZILLA)
    for product, files in XML.items():
        (base / "xml" / product).mkdir(parents=True)
        for name, text in files.items():
            (base / "xml" / product / f"{name}.xml").write_text(text)
    return base


def _by_id(df):
    return {r.defect_id: r for r in df.collect()}


def test_csv_rows(spark, exports):
    rows = read_export(spark, str(exports / "apache_issues.csv")).collect()
    assert [r.key for r in rows] == ["AB-1", "AB-2", None, "AB-3", "AB-6"]
    assert rows[0]["issuetype.name"] == "Bug" and "\n" in rows[0].description
    assert rows[3].priority is None and rows[4].summary == "NULL"


def test_jira_records(spark, exports):
    records = _by_id(load_source(spark, "apache", str(exports / "apache_issues.csv")))
    assert set(records) == {"apache-AB-1", "apache-AB-3", "apache-AB-6"}
    first = records["apache-AB-1"]
    assert (first.severity, first.priority, first.status) == ("blocker", "P1", "open")
    assert (first.resolution, first.duplicate_of) == ("wontfix", "apache-AB-9")
    assert (first.project, first.title, first.resolution_note) == ("AB", 't1 "q"', "note x")
    assert first.has_stack_trace and first.language == "python"
    assert first.url == "https://issues.apache.org/jira/browse/AB-1"
    assert records["apache-AB-3"].keywords == ["Sub", "Bug"]
    assert records["apache-AB-6"].severity == "critical"


def test_type_filter_can_be_off(spark, exports):
    path = str(exports / "apache_issues.csv")
    records = _by_id(load_source(spark, "apache", path, keep_only_bugs=False))
    assert "apache-AB-2" in records


def test_limit_counts_emitted_records_in_file_order(spark, exports):
    path = str(exports / "apache_issues.csv")
    assert set(_by_id(load_source(spark, "apache", path, limit=2))) == {
        "apache-AB-1", "apache-AB-3",
    }


def test_bugzilla_records(spark, exports):
    records = _by_id(load_source(spark, "eclipse", str(exports / "eclipse_bugs.csv")))
    assert set(records) == {"eclipse-11", "eclipse-12"}
    assert records["eclipse-12"].duplicate_of == "eclipse-11"
    assert records["eclipse-12"].resolution == "duplicate"
    assert records["eclipse-11"].assignee == "bob" and records["eclipse-11"].description == ""


def test_xml_records(spark, exports):
    rows = load_source(spark, "mozilla", str(exports / "xml")).orderBy("project", "title").collect()
    assert [(r.project, r.defect_id, r.title) for r in rows] == [
        ("A", "mozilla-1", "first"), ("Prod + B", "mozilla-1", "new & x"),
        ("Prod + B", "mozilla-3", "three"),
    ]
    assert rows[0].reporter == "z" and rows[0].created_at == ""
    assert (rows[1].severity, rows[1].created_at, rows[1].reporter) == ("critical", "12", "")
    assert rows[1].resolution == "unresolved" and rows[1].component == ""


def test_compressed_xml_files(spark, exports, tmp_path):
    """Of one product compressed, of another plain: the same records as from plain files."""
    for file in (exports / "xml").glob("*/*.xml"):
        to = tmp_path / "xml" / file.parent.name
        to.mkdir(parents=True, exist_ok=True)
        if to.name == "A":
            (to / file.name).write_bytes(file.read_bytes())
        else:
            (to / f"{file.name}.gz").write_bytes(gzip.compress(file.read_bytes()))
    plain, packed = (load_source(spark, "mozilla", str(p / "xml")) for p in (exports, tmp_path))
    assert plain.exceptAll(packed).count() == packed.exceptAll(plain).count() == 0
    assert packed.count() == plain.count() > 0


def test_xml_export_is_written_compressed(spark, tmp_path):
    names = "bug_id creation_ts reporter short_desc bug_severity priority bug_status resolution component"
    rows = spark.createDataFrame([tuple(f"{k} {c}" for c in names.split()) for k in range(2000)], names.split())
    queries._write_exports(rows.coalesce(1), str(tmp_path / "export"))
    files = list((tmp_path / "export").glob("*/*.gz"))
    assert {f.name for f in files} == {f"{n}.xml.gz" for n in ("reports", *queries._XML_COLUMNS)}
    assert sum(len(gzip.decompress(f.read_bytes())) for f in files) > 5 * sum(f.stat().st_size for f in files)
    assert load_source(spark, "mozilla", str(tmp_path / "export")).count() == 2000


def test_xml_limit_follows_products(spark, exports):
    rows = load_source(spark, "mozilla", str(exports / "xml"), limit=2).collect()
    assert sorted((r.project, r.title) for r in rows) == [("A", "first"), ("Prod + B", "new & x")]


def test_union_and_missing_sources(spark, exports):
    paths = sample_paths(str(exports))
    with pytest.raises(FileNotFoundError):
        load_all(spark, paths)
    assert load_all(spark, paths, skip_missing=True).count() == 5
    assert load_all(spark, paths, 1, skip_missing=True).count() == 2


def test_several_files_of_one_export(spark, exports, tmp_path):
    head, *rows = BUGZILLA.splitlines(keepends=True)
    (tmp_path / "a.csv").write_text(head + rows[0])
    (tmp_path / "b.csv").write_text(head + rows[1])
    assert load_source(spark, "eclipse", str(tmp_path)).count() == 2


def test_files_with_other_headers_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("bug_id,short_desc,bug_severity\n1,first title,major\n")
    (tmp_path / "b.csv").write_text(" Bug_Severity , SHORT_DESC,bug_id\nminor,second title,2\nminor,short\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("\ufeffshort_desc,component,bug_id\n\"third, title\",Cart,3\nlong,row,4,5\n")
    (tmp_path / "notes.txt").write_text("not,an,export\n")
    got = {r.defect_id: (r.title, r.severity, r.component) for r in load_source(spark, "eclipse", str(tmp_path)).collect()}
    assert got == {
        "eclipse-1": ("first title", "major", ""), "eclipse-2": ("second title", "minor", ""),
        "eclipse-3": ("third, title", "unknown", "Cart"),
    }
    assert load_source(spark, "eclipse", str(tmp_path), limit=2).count() == 2


def test_a_folder_with_no_export_is_an_error(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("nothing")
    with pytest.raises(ValueError):
        load_source(spark, "eclipse", str(tmp_path))


def test_dead_alias_stays_dead(spark):
    rows = normalize_headers(spark.createDataFrame([("K-1", "K-2")], "Key string, `dupID` string"))
    assert normalize_jira(rows).first().duplicate_of is None


def test_submission_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc \xff d\xc3\xa9f")
    (tmp_path / "b.bin").write_bytes(b"skipped")
    row = read_submissions(spark, str(tmp_path)).select("source_filename", "raw_text").first()
    assert tuple(row) == ("a.txt", "abc � d\xe9f")
    (tmp_path / "c.log").write_text("one\ntwo\n")
    lines = read_log_lines(spark, str(tmp_path / "c.log")).select(F.col("line")).collect()
    assert [r.line for r in lines] == ["one", "two"]


def test_long_fields_in_rows_of_wrong_length(spark, tmp_path):
    big = 'word ""quoted""\n' * 40_000
    (tmp_path / "x.csv").write_text(f'key,summary,description\nA-1,"{big}"\nA-2,"{big}",b,c\nA-3,"a, ""b""",c\n')
    rows = read_export(spark, str(tmp_path / "x.csv")).collect()
    assert [r.key for r in rows] == ["A-1", "A-3"]
    assert rows[0].summary == big.replace('""', '"') and rows[0].description is None
