"""DuckDB counterparts of the registered queries, written independently of them.

Where the queries work on arrays inside a row, these unnest lines and use windows; where the
queries multiply matrices, these take dot products of all pairs.
"""

from catalog import expected as V
from catalog.compose import (
    BUGZILLA_ROWS, JAVA_TEXT, JIRA_ROWS, LOG_LINE, LOG_TEXT, MIXED_TEXT, PYTHON_TEXT,
    REPORT_TEXT, SCRIPT_TEXT,
)

W = r"[\p{L}\p{N}_]"
SPACES = r" \t\n\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LEVELS = "TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL|SEVERE"

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_parts(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------
def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def clean(x: str, redact: bool = False, limit: int | None = None) -> str:
    """The entities that occur in the tables, then the cleaning steps."""
    out = f"coalesce({x}, '')"
    for entity, char in (
        ("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&lt;?", "<"), ("&gt;?", ">"), ("&#39;", "''"),
        ("&amp;?", "&"),
    ):
        out = f"regexp_replace({out}, '{entity}', '{char}', 'g')"
    out = rf"regexp_replace({out}, '\r\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    if redact:
        out = rf"regexp_replace({out}, 'https?://[^{SPACES}]+', '<url>', 'g')"
        # RE2 knows no Unicode word boundary: match one side character and put it back.
        out = (
            rf"regexp_replace({out}, '(^|[^\p{{L}}\p{{N}}_.+-])([.+-]*)"
            rf"([\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_-]+\."
            rf"[\p{{L}}\p{{N}}_.-]*[\p{{L}}\p{{N}}_])', '\1\2<email>', 'g')"
        )
    out = rf"regexp_replace({out}, '[ \t\f\v]+', ' ', 'g')"
    tail = SPACES.replace(r"\n", "")
    out = rf"regexp_replace({out}, '(?m)[{tail}]+$', '', 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(out) if limit is None else f"left({strip(out)}, {limit})"


ORACLES["clean_pages"] = f"SELECT page_id, {clean('html')} AS text FROM pages"
ORACLES["redact_pages"] = f"""
SELECT page_id, {clean("url || ' ' || html", redact=True)} AS text FROM pages"""
ORACLES["redact_documents"] = f"""
SELECT doc_id, {clean("text", redact=True)} AS text FROM documents"""


def chunk_parts(source: str, size: int, overlap: int) -> list[str]:
    """CTEs from ``source(key, body)`` to ``pieces(key, chunk_index, n_chunks, text)``."""
    step = max(size - overlap, 1)
    return [
        f"""bodies AS (
  SELECT key, body, length(body) AS n FROM (SELECT key, {strip('body')} AS body FROM {source})
)""",
        f"""windows AS (
  SELECT key, 0 AS w, 0 AS s, CASE WHEN n <= {size} THEN n ELSE
      {size} - coalesce(least(nullif(instr(reverse(substr(body, {step} + 1, {size - step})), ' '), 0),
        nullif(instr(reverse(substr(body, {step} + 1, {size - step})), chr(10)), 0)), 0) END AS e
  FROM bodies WHERE n > 0
  UNION ALL
  SELECT key, w + 1, s2, CASE WHEN s2 + {size} >= n THEN n ELSE
      s2 + {size} - coalesce(least(
        nullif(instr(reverse(substr(body, s2 + {step} + 1, {size - step})), ' '), 0),
        nullif(instr(reverse(substr(body, s2 + {step} + 1, {size - step})), chr(10)), 0)), 0) END
  FROM (SELECT windows.key, w, greatest(e - {overlap}, s + 1) AS s2, body, n
        FROM windows JOIN bodies ON windows.key = bodies.key WHERE e < n)
)""",
        f"""cut AS (
  SELECT windows.key, w, {strip('substr(body, s + 1, e - s)')} AS text
  FROM windows JOIN bodies ON windows.key = bodies.key
)""",
        """pieces AS (
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY w) - 1 AS chunk_index,
         count(*) OVER (PARTITION BY key) AS n_chunks, text
  FROM cut WHERE text <> ''
)""",
    ]


def _split(size: int, overlap: int) -> str:
    return (
        with_parts(
            "given AS (SELECT doc_id AS key, text AS body FROM documents)",
            *chunk_parts("given", size, overlap),
            recursive=True,
        )
        + "SELECT key AS doc_id, chunk_index, n_chunks, text FROM pieces"
    )


ORACLES["split_documents"] = _split(V.CHUNK_SIZE, V.CHUNK_OVERLAP)
ORACLES["split_documents_wide_overlap"] = _split(1000, 450)

DOCUMENT_RECORDS = """records AS (
  SELECT 'doc-' || documents.doc_id AS defect_id, source, lang AS project,
         'Document ' || documents.doc_id AS title, text AS description,
         CASE toxic WHEN 1 THEN 'critical' WHEN 0 THEN 'normal' END AS severity,
         CASE quality WHEN 1 THEN 'fixed' WHEN 0 THEN 'wontfix' ELSE 'unresolved' END
           AS resolution,
         CASE WHEN quality = 1 THEN 'Kept ' || source END AS resolution_note,
         n_chars % 2 = 0 AS has_stack_trace
  FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id
)"""
DOCUMENT_CHUNKS = [
    DOCUMENT_RECORDS,
    f"""given AS (
  SELECT defect_id AS key, {clean(
      "'[' || source || '] ' || title || chr(10) || title || chr(10) || description"
      " || CASE WHEN resolution_note IS NULL THEN '' ELSE chr(10) || 'Resolution: '"
      " || resolution_note END"
  )} AS body FROM records
)""",
    *chunk_parts("given", V.CHUNK_SIZE, V.CHUNK_OVERLAP),
    """chunks AS (
  SELECT key || '::chunk' || chunk_index AS chunk_id, pieces.text, records.* EXCLUDE description,
         NULL::VARCHAR AS component, 'unknown' AS priority, 'unknown' AS status,
         chunk_index, n_chunks
  FROM pieces JOIN records ON key = defect_id
)""",
]
_DOCUMENT_CHUNKS = with_parts(*DOCUMENT_CHUNKS, recursive=True)
ORACLES["chunk_documents"] = _DOCUMENT_CHUNKS + "SELECT * FROM chunks"
ORACLES["kb_totals"] = _DOCUMENT_CHUNKS + """
SELECT count(*) AS chunks, count(DISTINCT defect_id) AS unique_defects,
       count(*) FILTER (has_stack_trace) AS with_stack_trace FROM chunks"""


def _breakdown(source: str, n: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, coalesce({c}, '?') AS value, {n} AS n FROM {source}"
        f" GROUP BY coalesce({c}, '?')"
        for c in ("source", "severity", "resolution")
    )


ORACLES["kb_breakdown"] = _DOCUMENT_CHUNKS + _breakdown("chunks", "count(*)")
ORACLES["kb_breakdown_per_defect"] = _DOCUMENT_CHUNKS + _breakdown(
    "chunks", "count(DISTINCT defect_id)"
)
ORACLES["load_totals"] = _DOCUMENT_CHUNKS + """
SELECT source, count(DISTINCT defect_id) AS records, count(*) AS chunks
FROM chunks GROUP BY source"""
ORACLES["kb_append"] = ORACLES["load_totals"]
ORACLES["stream_kb"] = (
    with_parts(
        """records AS (SELECT 'doc-' || doc_id AS defect_id, source,
           'Document ' || doc_id AS title, text AS description FROM documents)""",
        f"""given AS (SELECT defect_id AS key, {clean(
            "'[' || source || '] ' || title || chr(10) || title || chr(10) || description"
        )} AS body FROM records)""",
        *chunk_parts("given", V.CHUNK_SIZE, V.CHUNK_OVERLAP),
        recursive=True,
    )
    + """SELECT source, count(DISTINCT key) AS records, count(*) AS chunks
FROM pieces JOIN records ON key = defect_id GROUP BY source"""
)


# ---------------------------------------------------------------------------
# Languages, severities
# ---------------------------------------------------------------------------
def hits(text: str, *regexes: str) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, {quoted(r)}))" for r in regexes)


SCORES = {
    "python": (
        r"Traceback \(most recent call last\)", r'File "[^"]+\.py"', r'\.py", line \d+',
    ),
    "java": (r"Exception in thread", r"\bat (?:[\w$]+\.)+[\w$]+\(", r"Caused by:", r"\.java:\d+"),
    "javascript": (
        r"\bat .+\.js:\d+:\d+", r"node_modules", r"ReferenceError", r"\bTypeError: Cannot read",
    ),
    "csharp": (r"System\.[A-Za-z.]+Exception", r"\bat .+\) in .+\.cs:line \d+"),
    "go": (r"(?m)^panic:", r"goroutine \d+ \[", r"\.go:\d+ \+0x"),
    "ruby": (r"\.rb:\d+:in ", r"\([A-Z]\w*Error\)"),
}


def scored(source: str) -> str:
    """CTE ``scored``: ``source(submission_id, t)`` with one score per language."""
    scores = ", ".join(f"{hits('t', *r)} AS {name}" for name, r in SCORES.items())
    return f"scored AS (SELECT submission_id, t, {scores} FROM {source})"


LANGUAGE = (
    "CASE greatest(python, java, javascript, csharp, go, ruby) WHEN 0 THEN NULL "
    + " ".join(f"WHEN {name} THEN '{name}'" for name in SCORES)
    + " END"
)


def orders_as(text: str, name: str = "subs") -> str:
    return f"{name} AS (SELECT o_orderkey AS submission_id, {text} AS t FROM orders)"


def severity_guess(text: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{c}')" for c in cues) + f" THEN '{s}'"
        for s, cues in V.SEVERITY_CUES
    )
    return f"CASE {cases} ELSE 'unknown' END"


ORACLES["language_of_texts"] = with_parts(orders_as(MIXED_TEXT), scored("subs")) + f"""
SELECT submission_id, {", ".join(SCORES)}, {LANGUAGE} AS language FROM scored"""
ORACLES["severity_guesses"] = with_parts(orders_as(MIXED_TEXT)) + f"""
SELECT submission_id, {severity_guess('t')} AS severity FROM subs"""


# ---------------------------------------------------------------------------
# Records
# ---------------------------------------------------------------------------
def needles(x: str, table, default: str) -> str:
    cases = " ".join(
        f"WHEN contains(lower({x}), {quoted(n)}) THEN '{value}'" for n, value in table
    )
    return f"CASE {cases} ELSE '{default}' END"


def exact(x: str, table: dict) -> str:
    cases = " ".join(f"WHEN '{name}' THEN '{value}'" for name, value in table.items())
    return f"CASE lower({x}) {cases} ELSE 'unknown' END"


TRACE = (
    r"(?m)Traceback \(most recent call last\)|Exception in thread|Caused by:|"
    r"\bat (?:[\w$]+\.){2,}[\w$]+\(|^panic:"
)

BUGZILLA_RECORDS = [
    f"raw AS ({BUGZILLA_ROWS})",
    """picked AS (
  SELECT trim(bug_id) AS id, trim(short_desc) AS title, """
    + strip("coalesce(description, '')")
    + """ AS description, trim(resolution_note) AS note, * EXCLUDE (description)
  FROM raw WHERE trim(bug_id) <> ''
)""",
    "texts AS (SELECT *, title || chr(10) || description AS t, id AS submission_id FROM picked)",
    scored("texts"),
    f"""records AS (
  SELECT 'eclipse-' || id AS defect_id, 'eclipse' AS source, product AS project, component,
         {clean('title')} AS title, {clean('description')} AS description,
         {needles('bug_severity', V.SEVERITY_NEEDLES, 'unknown')} AS severity,
         {exact('trim(priority)', V.PRIORITY_NAMES)} AS priority,
         {needles('bug_status', V.STATUS_NEEDLES, 'unknown')} AS status,
         {needles('resolution', V.RESOLUTION_NEEDLES, 'unresolved')} AS resolution,
         CASE WHEN dup_id <> '' THEN 'eclipse-' || dup_id END AS duplicate_of,
         {clean('note')} AS resolution_note,
         regexp_matches(texts.t, {quoted(TRACE)}) AS has_stack_trace,
         {LANGUAGE} AS language, '' AS keywords, reporter, '' AS assignee,
         creation_ts AS created_at, '' AS resolved_at,
         'https://bugs.eclipse.org/bugs/show_bug.cgi?id=' || id AS url
  FROM texts JOIN scored USING (submission_id)
)""",
]
ORACLES["bugzilla_records"] = with_parts(*BUGZILLA_RECORDS) + "SELECT * FROM records"
ORACLES["combined_texts"] = with_parts(*BUGZILLA_RECORDS) + """
SELECT defect_id, array_to_string(list_filter([
    '[' || source || '] ' || title, title, description,
    CASE WHEN resolution_note <> '' THEN 'Resolution: ' || resolution_note ELSE '' END,
    CASE WHEN component <> '' THEN 'Component: ' || component ELSE '' END
  ], lambda x: trim(x) <> ''), chr(10)) AS text
FROM records"""

JIRA_RECORDS = [
    f"raw AS ({JIRA_ROWS})",
    """picked AS (
  SELECT *, coalesce("priority.name", '') AS pri, coalesce("desc", '') AS description
  FROM raw WHERE key IS NOT NULL
    AND regexp_matches(lower(coalesce("issuetype.name", '')), 'bug|defect')
)""",
    f"""records AS (
  SELECT 'apache-' || key AS defect_id, 'apache' AS source,
         coalesce(nullif("project.key", ''), split_part(key, '-', 1)) AS project,
         '' AS component, summary AS title, {clean('description')} AS description,
         {exact('pri', V.JIRA_SEVERITY_NAMES)} AS severity,
         {exact('pri', V.PRIORITY_NAMES)} AS priority,
         {needles('"status.name"', V.STATUS_NEEDLES, 'unknown')} AS status,
         {needles("coalesce(\"resolution.name\", '')", V.RESOLUTION_NEEDLES, 'unresolved')}
           AS resolution,
         'apache-' || dup_id AS duplicate_of, '' AS resolution_note,
         false AS has_stack_trace, NULL::VARCHAR AS language,
         array_to_string(list_filter(string_split("issuetype.name", ' '),
           lambda x: x <> ''), '|') AS keywords,
         '' AS reporter, '' AS assignee, created AS created_at, '' AS resolved_at,
         'https://issues.apache.org/jira/browse/' || key AS url
  FROM picked
)""",
]
ORACLES["jira_records"] = with_parts(*JIRA_RECORDS) + "SELECT * FROM records"
ORACLES["csv_export_scan"] = ORACLES["jira_records"]
ORACLES["metadata_rows"] = with_parts(*JIRA_RECORDS) + """
SELECT defect_id, source, project, nullif(component, '') AS component, title, severity,
       priority, status, resolution, duplicate_of, has_stack_trace, language,
       replace(keywords, '|', ', ') AS keywords, url FROM records"""
ORACLES["first_records"] = with_parts(*JIRA_RECORDS) + f"""
SELECT * FROM records ORDER BY defect_id LIMIT {V.RECORDS_PER_SOURCE}"""
ORACLES["xml_export_scan"] = with_parts(
    f"raw AS ({BUGZILLA_ROWS})",
    "picked AS (SELECT *, trim(short_desc) AS title FROM raw WHERE trim(bug_id) <> '')",
) + f"""
SELECT 'mozilla-' || bug_id AS defect_id, 'mozilla' AS source, component,
       {clean('title')} AS title, '' AS description,
       {needles('bug_severity', V.SEVERITY_NEEDLES, 'unknown')} AS severity,
       {exact('trim(priority)', V.PRIORITY_NAMES)} AS priority,
       {needles('bug_status', V.STATUS_NEEDLES, 'unknown')} AS status,
       {needles('resolution', V.RESOLUTION_NEEDLES, 'unresolved')} AS resolution,
       NULL::VARCHAR AS duplicate_of, '' AS resolution_note, false AS has_stack_trace,
       NULL::VARCHAR AS language, '' AS keywords, reporter, '' AS assignee,
       creation_ts AS created_at, '' AS resolved_at,
       'https://bugzilla.mozilla.org/show_bug.cgi?id=' || bug_id AS url
FROM picked"""
# The composed rows are short: each is one chunk.
ORACLES["kb_build"] = with_parts(*BUGZILLA_RECORDS) + _breakdown("records", "count(*)")
ORACLES["defect_cube"] = with_parts(*BUGZILLA_RECORDS) + """
SELECT source, component, month, grouping(source, component, month) AS level,
       count(*) AS defects, count(*) FILTER (has_stack_trace) AS with_stack_trace
FROM (SELECT source, component, substr(created_at, 1, 7) AS month, has_stack_trace FROM records)
GROUP BY CUBE (source, component, month)"""
ORACLES["duplicate_families"] = with_parts(*BUGZILLA_RECORDS) + """
SELECT links.duplicate_of AS canonical, coalesce(max(o.title), '') AS title,
       count(DISTINCT links.defect_id) AS duplicates, max(o.title) IS NOT NULL AS known
FROM records links LEFT JOIN records o ON o.defect_id = links.duplicate_of
WHERE links.duplicate_of IS NOT NULL GROUP BY links.duplicate_of"""


# ---------------------------------------------------------------------------
# Lines and chains
# ---------------------------------------------------------------------------
def lines_of(source: str = "subs", name: str = "lines") -> str:
    return f"""{name} AS (
  SELECT submission_id, unnest(string_split(t, chr(10))) AS line,
         generate_subscripts(string_split(t, chr(10)), 1) AS n FROM {source}
)"""


JAVA_FRAME = r"^\s*at\s+([\w$.<>]+)\(([^)]*)\)"
JAVA_TYPE = r"((?:[\w$]+\.)+[\w$]+(?:Exception|Error|Throwable))(?::\s?(.*))?$"
JAVA_HEAD = r'^(?:Exception in thread "[^"]*"\s+)?' + JAVA_TYPE
JAVA_CAUSE = r"^Caused by:\s*" + JAVA_TYPE


def java_parts(text: str) -> list[str]:
    """CTEs up to ``heads`` and ``frames`` with a running head number ``h``."""
    return [
        orders_as(text),
        lines_of(),
        f"""marked AS (
  SELECT *, regexp_matches(line, {quoted(JAVA_FRAME)}) AS is_frame,
         regexp_matches(line, {quoted(JAVA_CAUSE)}) AS is_cause,
         regexp_matches(trim(line), {quoted(JAVA_HEAD)}) AS is_exc FROM lines
)""",
        """numbered AS (
  SELECT *, (is_cause OR is_exc) AND NOT is_frame AS is_head,
         sum(CASE WHEN (is_cause OR is_exc) AND NOT is_frame THEN 1 ELSE 0 END)
           OVER (PARTITION BY submission_id ORDER BY n) AS h FROM marked
)""",
        f"""heads AS (
  SELECT submission_id, h, is_cause,
         regexp_extract(regexp_replace(trim(line), '^Caused by:\\s*', ''),
           {quoted(JAVA_HEAD)}, 1) AS exception_type,
         trim(regexp_extract(regexp_replace(trim(line), '^Caused by:\\s*', ''),
           {quoted(JAVA_HEAD)}, 2)) AS message
  FROM numbered WHERE is_head
)""",
        f"""located AS (
  SELECT submission_id, h, n, trim(line, chr(9) || ' ') AS raw,
         regexp_extract(line, {quoted(JAVA_FRAME)}, 1) AS sig,
         regexp_extract(line, {quoted(JAVA_FRAME)}, 2) AS loc
  FROM numbered WHERE is_frame AND h > 0
)""",
        r"""frames AS (
  SELECT submission_id, h, n, raw, nullif(regexp_extract(loc, '^([^:]+):(\d+)', 1), '') AS file,
         CAST(nullif(regexp_extract(loc, '^([^:]+):(\d+)', 2), '') AS BIGINT) AS line,
         regexp_extract(sig, '([^.]*)$', 1) AS function,
         regexp_replace(sig, '\.[^.]*$', '') AS module
  FROM located
)""",
    ]


_JAVA = with_parts(*java_parts(JAVA_TEXT))
ORACLES["java_chains"] = _JAVA + """
SELECT heads.submission_id, CAST(heads.h - 1 AS BIGINT) AS chain_index, exception_type, message,
       is_cause, coalesce(string_agg(concat_ws('|', module, function, file, line), ';' ORDER BY n),
         '') AS frames
FROM heads LEFT JOIN frames ON heads.submission_id = frames.submission_id AND heads.h = frames.h
GROUP BY ALL"""
ORACLES["java_frames"] = _JAVA + """
SELECT frames.submission_id, CAST(frames.h - 1 AS BIGINT) AS chain_index, exception_type,
       row_number() OVER (PARTITION BY frames.submission_id, frames.h ORDER BY n) - 1
         AS frame_index,
       raw, file, line, function, module
FROM frames JOIN heads ON heads.submission_id = frames.submission_id AND heads.h = frames.h"""
ORACLES["root_causes"] = _JAVA + """
SELECT submission_id, arg_max(exception_type, h) AS root_exception, arg_max(message, h) AS message
FROM heads GROUP BY submission_id"""
ORACLES["exception_patterns"] = _JAVA + """
SELECT exception_type, count(*) AS occurrences, count(DISTINCT submission_id) AS submissions,
       count(*) FILTER (is_cause) AS as_cause
FROM heads GROUP BY exception_type"""

PY_FRAME = r'^\s*File "([^"]+)", line (\d+), in (.+)$'
PY_EXC = (
    r"^([A-Za-z_][\w.]*(?:Error|Exception|Warning|Exit|Interrupt|Failure|Timeout|StopIteration"
    r"|KeyboardInterrupt|GeneratorExit))(?::\s?(.*))?$"
)
GENERIC = r"^([A-Za-z_][\w.]*(?:Error|Exception))(?::\s?(.*))?$"
ORACLES["python_chains"] = with_parts(
    orders_as(PYTHON_TEXT),
    lines_of(),
    f"""marked AS (
  SELECT *, contains(line, 'Traceback (most recent call last):') AS is_header,
         regexp_matches(line, {quoted(PY_FRAME)}) AS is_frame,
         regexp_matches(trim(line), {quoted(PY_EXC)}) AS is_exc,
         trim(line) = '' OR contains(line, 'During handling of the above') AS is_gap,
         starts_with(trim(line), 'File') AS like_frame FROM lines
)""",
    """numbered AS (
  SELECT *, sum(CASE WHEN is_header THEN 1 ELSE 0 END)
    OVER (PARTITION BY submission_id ORDER BY n) AS b FROM marked
)""",
    """skipped AS (
  SELECT *, coalesce(lag(is_frame) OVER (PARTITION BY submission_id, b ORDER BY n), false)
    AND NOT is_frame AND NOT like_frame AS is_source FROM numbered WHERE b > 0
)""",
    """ends AS (
  SELECT submission_id, b, min(n) AS stop FROM skipped
  WHERE NOT is_header AND NOT is_source AND NOT is_frame AND (is_exc OR NOT is_gap)
  GROUP BY submission_id, b
)""",
    f"""closed AS (
  SELECT submission_id, b, n, regexp_extract(trim(line), {quoted(PY_EXC)}, 1) AS exception_type,
         trim(regexp_extract(trim(line), {quoted(PY_EXC)}, 2)) AS message
  FROM skipped JOIN ends USING (submission_id, b) WHERE n = stop AND is_exc
)""",
    f"""frames AS (
  SELECT submission_id, b, skipped.n, concat_ws('|', regexp_extract(line, {quoted(PY_FRAME)}, 3),
         regexp_extract(line, {quoted(PY_FRAME)}, 1), regexp_extract(line, {quoted(PY_FRAME)}, 2))
         AS frame
  FROM skipped JOIN closed USING (submission_id, b) WHERE is_frame AND skipped.n < closed.n
)""",
    f"""bare AS (
  SELECT submission_id, row_number() OVER (PARTITION BY submission_id ORDER BY n) AS b,
         regexp_extract(trim(line), {quoted(GENERIC)}, 1) AS exception_type,
         trim(regexp_extract(trim(line), {quoted(GENERIC)}, 2)) AS message
  FROM lines WHERE regexp_matches(trim(line), {quoted(GENERIC)})
    AND submission_id NOT IN (SELECT submission_id FROM closed)
)""",
) + """
SELECT closed.submission_id,
       row_number() OVER (PARTITION BY closed.submission_id ORDER BY closed.b) - 1 AS chain_index,
       exception_type, message,
       row_number() OVER (PARTITION BY closed.submission_id ORDER BY closed.b) > 1 AS is_cause,
       coalesce(any_value(f.frames), '') AS frames
FROM closed LEFT JOIN (SELECT submission_id, b, string_agg(frame, ';' ORDER BY n) AS frames
                       FROM frames GROUP BY submission_id, b) f
  ON f.submission_id = closed.submission_id AND f.b = closed.b
GROUP BY closed.submission_id, closed.b, exception_type, message
UNION ALL
SELECT submission_id, b - 1, exception_type, message, false, '' FROM bare"""

JS_FRAME = r"^\s*at\s+(?:([^()]+?)\s+\()?([^()]+?):(\d+):\d+\)?\s*$"
ORACLES["script_chains"] = with_parts(
    orders_as(SCRIPT_TEXT),
    lines_of(),
    f"""marked AS (
  SELECT *, regexp_matches(line, {quoted(JS_FRAME)}) AS is_frame,
         regexp_matches(trim(line), {quoted(GENERIC)}) OR starts_with(trim(line), 'panic:')
           AS is_head FROM lines
)""",
    """heads AS (
  SELECT submission_id, n, trim(line) AS line,
         row_number() OVER (PARTITION BY submission_id ORDER BY n) AS h
  FROM marked WHERE is_head
)""",
    f"""frames AS (
  SELECT submission_id, n, n - row_number() OVER (PARTITION BY submission_id ORDER BY n) AS run,
         concat_ws('|', nullif(regexp_extract(line, {quoted(JS_FRAME)}, 1), ''),
           regexp_extract(line, {quoted(JS_FRAME)}, 2), regexp_extract(line, {quoted(JS_FRAME)}, 3))
           AS frame
  FROM marked WHERE is_frame
)""",
    """first_run AS (
  SELECT heads.submission_id, h, arg_min(run, frames.n) AS run, min(frames.n) AS start
  FROM heads JOIN frames ON heads.submission_id = frames.submission_id AND frames.n > heads.n
  GROUP BY heads.submission_id, h
)""",
    """runs AS (
  SELECT first_run.submission_id, h, string_agg(frame, ';' ORDER BY n) AS frames
  FROM first_run JOIN frames ON first_run.submission_id = frames.submission_id
    AND first_run.run = frames.run AND n >= start
  GROUP BY first_run.submission_id, h
)""",
) + f"""
SELECT heads.submission_id, heads.h - 1 AS chain_index,
       CASE WHEN starts_with(line, 'panic:') THEN 'panic'
            ELSE regexp_extract(line, {quoted(GENERIC)}, 1) END AS exception_type,
       trim(CASE WHEN starts_with(line, 'panic:') THEN substr(line, 7)
            ELSE regexp_extract(line, {quoted(GENERIC)}, 2) END) AS message,
       false AS is_cause, coalesce(frames, '') AS frames
FROM heads LEFT JOIN runs ON heads.submission_id = runs.submission_id AND heads.h = runs.h"""

# ---------------------------------------------------------------------------
# Logs
# ---------------------------------------------------------------------------
STAMP = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"


def entries(source: str = "lines") -> str:
    """CTE ``entries`` of the log lines of ``source(submission_id, line, n)``."""
    level = rf"regexp_extract(line, '\b({LEVELS})\b', 1)"
    return rf"""entries AS (
  SELECT submission_id, n, trim(line) AS raw,
         nullif(regexp_extract(line, '{STAMP}'), '') AS timestamp,
         CASE {level} WHEN 'WARN' THEN 'WARNING' WHEN 'ERR' THEN 'ERROR' ELSE {level} END AS level,
         nullif(regexp_extract(line, '[\[(]?((?:[\w$]+\.){{2,}}[\w$]+)[\])]?', 1), '') AS logger,
         trim(ltrim(regexp_replace(line, '^.*?\b({LEVELS})\b', ''), ' -:]' || chr(9))) AS message
  FROM {source}
  WHERE regexp_matches(line, '\b({LEVELS})\b')
    AND (regexp_matches(line, '{STAMP}') OR starts_with(trim(line), '['))
)"""


EVENT_SUBS = f"subs AS (SELECT event_id AS submission_id, {LOG_TEXT} AS t FROM events)"
_LOGS = with_parts(EVENT_SUBS, lines_of(), entries())
ORACLES["log_entries"] = _LOGS + """
SELECT submission_id, row_number() OVER (PARTITION BY submission_id ORDER BY n) - 1 AS entry_index,
       raw, timestamp, level, logger, message FROM entries"""
ORACLES["level_histogram"] = _LOGS + """
SELECT submission_id, level, count(*) AS n FROM entries GROUP BY submission_id, level"""


def _windows(condition: str) -> str:
    return with_parts(
        f"lines AS (SELECT event_id AS submission_id, ts, {LOG_LINE} AS line, 1 AS n FROM events)",
        entries(),
        "timed AS (SELECT date_trunc('hour', ts) AS w, level FROM entries"
        " JOIN events ON submission_id = event_id)",
    ) + f"""
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, level, count(*) AS n
FROM timed WHERE {condition} GROUP BY w, level"""


ORACLES["level_windows"] = _windows("true")
ORACLES["stream_level_windows"] = ORACLES["level_windows"]


# ---------------------------------------------------------------------------
# Artifact types and reports
# ---------------------------------------------------------------------------
def typed(source: str = "subs") -> list[str]:
    """CTEs from ``source(submission_id, t)`` to ``types(submission_id, artifact_type)``."""
    return [
        lines_of(source),
        entries(),
        rf"""per_line AS (
  SELECT submission_id, count(*) FILTER (trim(line) <> '') AS n_full,
         count(*) FILTER (len(regexp_extract_all(line, '[^{SPACES}]+')) >= 6
           AND length(line) - length(replace(line, '/', '')) < 2
           AND NOT starts_with(line, 'at ')) AS n_prose
  FROM lines GROUP BY submission_id
)""",
        "logged AS (SELECT submission_id, count(*) AS n_log FROM entries GROUP BY submission_id)",
        rf"""judged AS (
  SELECT s.submission_id, n_full, coalesce(n_log, 0) AS n_log,
         contains(t, 'Traceback (most recent call last):') OR contains(t, 'Exception in thread')
           OR contains(t, 'Caused by:') OR contains(t, 'goroutine ')
           OR starts_with({strip('t')}, 'panic:') AS trace,
         contains(lower(t), 'steps to reproduce') OR contains(lower(t), 'expected')
           OR contains(lower(t), 'actual result') OR contains(lower(t), 'reproduc')
           OR regexp_matches(t, '(?m)^[{SPACES}]*#{{1,4}}[{SPACES}]+{W}') OR n_prose >= 3
           AS prose
  FROM {source} s JOIN per_line p ON s.submission_id = p.submission_id
  LEFT JOIN logged l ON s.submission_id = l.submission_id
)""",
        """types AS (
  SELECT submission_id, n_log, CASE WHEN n_full = 0 THEN 'unknown'
    WHEN prose AND trace THEN 'mixed'
    WHEN n_log >= 3 AND n_log / n_full >= 0.25 THEN 'error_log'
    WHEN trace THEN 'stack_trace' WHEN prose THEN 'bug_report' ELSE 'unknown' END
    AS artifact_type
  FROM judged
)""",
    ]


ORACLES["artifact_types"] = with_parts(
    f"""subs AS (
  SELECT 'order-' || o_orderkey AS submission_id, {MIXED_TEXT} AS t FROM orders
  UNION ALL SELECT 'document-' || doc_id, text FROM documents
)""",
    *typed(),
) + """
SELECT split_part(submission_id, '-', 1) AS kind,
       CAST(split_part(submission_id, '-', 2) AS BIGINT) AS submission_id, artifact_type
FROM types"""

LABEL = (
    r"^\s*#{0,4}\s*\**\s*([A-Za-z][A-Za-z /]{1,30}?)\s*\**\s*[:：]\s*(.*)$"
)
HEADING_LABEL = r"^\s*#{1,4}\s*\**\s*([A-Za-z][A-Za-z /]{1,30}?)\s*\**\s*$"
_LABEL_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SECTION_LABELS.items())
REPORT_FIELDS = [
    orders_as(REPORT_TEXT),
    lines_of(),
    f"""labelled AS (
  SELECT *, CASE lower(trim(CASE WHEN regexp_matches(line, {quoted(LABEL)})
      THEN regexp_extract(line, {quoted(LABEL)}, 1)
      ELSE regexp_extract(line, {quoted(HEADING_LABEL)}, 1) END)) {_LABEL_CASES} END AS field
  FROM lines
)""",
    """sectioned AS (
  SELECT *, count(field) OVER (PARTITION BY submission_id ORDER BY n) AS s FROM labelled
)""",
    f"""contents AS (
  SELECT submission_id, s, max(field) AS field, trim(string_agg(
      CASE WHEN field IS NULL THEN line
           ELSE nullif(trim(regexp_extract(line, {quoted(LABEL)}, 2)), '') END,
      chr(10) ORDER BY n), ' ' || chr(10)) AS value
  FROM sectioned WHERE s > 0 GROUP BY submission_id, s
)""",
    """fields AS (
  SELECT submission_id, field, string_agg(value, chr(10) ORDER BY s) AS value
  FROM contents WHERE value <> '' GROUP BY submission_id, field
)""",
    r"""summaries AS (
  SELECT submission_id, CASE WHEN regexp_matches(t, '(?m)^\s*#{1,4}\s+(.+)$')
    THEN trim(regexp_extract(t, '(?m)^\s*#{1,4}\s+(.+)$', 1))
    ELSE trim(split_part(t, chr(10), 1)) END AS value
  FROM subs WHERE submission_id NOT IN
    (SELECT submission_id FROM fields WHERE field = 'summary')
)""",
    """all_fields AS (
  SELECT submission_id, field, value FROM fields
  UNION ALL SELECT submission_id, 'summary', value FROM summaries
)""",
]
ORACLES["report_fields"] = with_parts(*REPORT_FIELDS) + "SELECT * FROM all_fields"
ORACLES["submission_titles"] = with_parts(*REPORT_FIELDS) + """
SELECT submission_id, value AS title FROM all_fields WHERE field = 'summary'"""
ORACLES["first_lines"] = rf"""
SELECT conv_id || '-' || turn AS submission_id,
       {strip(rf"regexp_extract(text, '[^{SPACES}][^\n]*')")} AS title
FROM conversations"""
ORACLES["report_signals"] = with_parts(orders_as(REPORT_TEXT)) + r"""
SELECT submission_id, array_to_string(list_concat(
    regexp_extract_all(t, '\b(?:E\d{3,5}|HTTP\s*[45]\d{2})\b'),
    regexp_extract_all(t, '\b[\w./-]+\.(?:java|py)\b')), '|') AS signals
FROM subs"""

# Signals of the composed traces, by their parts: types with their frames, then the file
# names, each once.
JAVA_SIGNALS = [
    *java_parts(JAVA_TEXT),
    """ordered AS (
  SELECT submission_id, h, 0 AS f, exception_type AS signal FROM heads
  UNION ALL
  SELECT submission_id, h, row_number() OVER (PARTITION BY submission_id, h ORDER BY n),
         module || '.' || function FROM frames
  UNION ALL
  SELECT submission_id, 1000, n, file FROM frames WHERE file IS NOT NULL
)""",
    """firsts AS (
  SELECT submission_id, arg_min(signal, (h, f)) AS signal, min((h, f)) AS place
  FROM ordered GROUP BY submission_id, lower(signal)
)""",
    """signals AS (
  SELECT submission_id, signal,
         row_number() OVER (PARTITION BY submission_id ORDER BY place) - 1 AS position FROM firsts
)""",
]
ORACLES["key_signals"] = with_parts(*JAVA_SIGNALS) + """
SELECT submission_id, position, signal FROM signals"""
JAVA_NORMALIZED = [
    *JAVA_SIGNALS,
    """paths AS (
  SELECT submission_id, h, string_agg(function, ' -> ' ORDER BY n) AS path FROM frames
  GROUP BY submission_id, h
)""",
    """chain AS (
  SELECT heads.submission_id, arg_min(exception_type || ': ' || message, heads.h) AS title,
         string_agg(exception_type || ': ' || message
           || coalesce(chr(10) || 'in ' || path, ''), chr(10) ORDER BY heads.h) AS body
  FROM heads LEFT JOIN paths ON heads.submission_id = paths.submission_id AND heads.h = paths.h
  GROUP BY heads.submission_id
)""",
    """normalized AS (
  SELECT chain.submission_id, title, title || chr(10) || body || chr(10) || 'signals: '
         || string_agg(signal, ', ' ORDER BY position) AS normalized_text,
         string_agg(signal, '|' ORDER BY position) AS keywords
  FROM chain JOIN signals ON chain.submission_id = signals.submission_id
  GROUP BY chain.submission_id, title, body
)""",
]
ORACLES["normalized_texts"] = with_parts(*JAVA_NORMALIZED) + """
SELECT submission_id, normalized_text FROM normalized"""
ORACLES["submission_records"] = with_parts(*JAVA_NORMALIZED) + f"""
SELECT 'submission-' || normalized.submission_id AS defect_id, 'user_submission' AS source, title,
       normalized_text AS description, {severity_guess('t')} AS severity, true AS has_stack_trace,
       'java' AS language, 'unknown' AS resolution, keywords
FROM normalized JOIN subs ON normalized.submission_id = subs.submission_id"""
# The number of exceptions follows from the kind of text each order got.
def _counts(name: str, text_query: str) -> str:
    return (
        f"{name} AS (SELECT submission_id, count(*) AS n_exceptions FROM ({text_query})"
        " GROUP BY submission_id)"
    )


ORACLES["parsed_submissions"] = with_parts(
    orders_as(MIXED_TEXT, "mixed"),
    *typed("mixed"),
    scored("mixed"),
    _counts("java_n", ORACLES["java_chains"]),
    _counts("python_n", ORACLES["python_chains"]),
    _counts("script_n", ORACLES["script_chains"]),
) + f"""
SELECT types.submission_id, artifact_type, {LANGUAGE} AS language,
       CASE types.submission_id % 5 WHEN 0 THEN coalesce(java_n.n_exceptions, 0)
         WHEN 1 THEN coalesce(python_n.n_exceptions, 0)
         WHEN 2 THEN coalesce(script_n.n_exceptions, 0) WHEN 3 THEN 0
         ELSE coalesce(java_n.n_exceptions, 0) END AS n_exceptions,
       length(t) AS char_count, length(t) - length(replace(t, chr(10), '')) + 1 AS line_count
FROM types JOIN scored ON types.submission_id = scored.submission_id
LEFT JOIN java_n ON types.submission_id = java_n.submission_id
LEFT JOIN python_n ON types.submission_id = python_n.submission_id
LEFT JOIN script_n ON types.submission_id = script_n.submission_id"""
ORACLES["log_findings"] = with_parts(EVENT_SUBS, *typed()) + """
SELECT subs.submission_id, any_value(artifact_type) AS artifact_type, 0::BIGINT AS n_exceptions,
       NULL::VARCHAR AS root_exception,
       coalesce(string_agg(message, '|' ORDER BY n)
         FILTER (level IN ('ERROR', 'FATAL', 'CRITICAL', 'SEVERE')), '') AS salient_errors,
       count(n) AS n_log_lines, count(*) FILTER (level = 'ERROR') AS errors,
       count(*) FILTER (level = 'WARNING') AS warnings
FROM subs JOIN types ON subs.submission_id = types.submission_id
LEFT JOIN entries ON subs.submission_id = entries.submission_id
GROUP BY subs.submission_id"""


# ---------------------------------------------------------------------------
# Vector search
# ---------------------------------------------------------------------------
def pairs(condition: str) -> str:
    """CTE ``pairs`` of queries and chunks with rounded cosines."""
    return f"""pairs AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id AS chunk_id,
         CAST(c.label AS BIGINT) AS defect_id,
         round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) AS score
  FROM embeddings q JOIN embeddings c ON {condition}
)"""


def ranked(source: str, k: int, name: str = "ranked") -> str:
    return f"""{name} AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank,
         chunk_id, defect_id, score FROM {source} QUALIFY rank <= {k}
)"""


def best_of(source: str, name: str = "best") -> str:
    return f"""{name} AS (
  SELECT query_id, chunk_id, defect_id, score FROM {source}
  QUALIFY row_number() OVER (PARTITION BY query_id, defect_id ORDER BY score DESC, chunk_id) = 1
)"""


OTHERS = "q.vec_id <> c.vec_id"
_TOP5 = with_parts(pairs(OTHERS), ranked("pairs", 5))
ORACLES["vector_topk"] = _TOP5 + "SELECT * FROM ranked"
ORACLES["grid_topk"] = ORACLES["vector_topk"]
# At sf0.01, where both are compared, the shortlists hold all exact neighbours.
ORACLES["coded_topk"] = ORACLES["vector_topk"]
ORACLES["kb_append_null_keys"] = """
SELECT DISTINCT CASE WHEN doc_id % 5 > 1 THEN nullif(source, '') END AS source,
  CASE WHEN doc_id % 4 > 0 THEN 'doc-' || doc_id END AS defect_id, CAST(1 AS BIGINT) AS stored
FROM documents"""
ORACLES["filtered_topk"] = (
    with_parts(pairs(OTHERS + " AND c.label = 3"), ranked("pairs", 5)) + "SELECT * FROM ranked"
)
ORACLES["defect_topk"] = (
    with_parts(pairs("q.label <> c.label"), best_of("pairs"), ranked("best", 3))
    + "SELECT * FROM ranked"
)
_OVERFETCHED = with_parts(
    pairs(OTHERS), ranked("pairs", 20, "fetched"), best_of("fetched"), ranked("best", 5)
)
ORACLES["overfetched_topk"] = _OVERFETCHED + "SELECT * FROM ranked"
_DUPLICATES = with_parts(pairs("q.label <> c.label"), best_of("pairs"), ranked("best", 5))
ORACLES["duplicate_candidates"] = _DUPLICATES + "SELECT * FROM ranked WHERE score >= 0.45"
ORACLES["duplicate_counts"] = _DUPLICATES + """
SELECT query_id, count(*) FILTER (score >= 0.45) AS n_duplicates FROM ranked GROUP BY query_id"""
_SIDES = ", ".join(
    f"""list_sum(list_transform(embedding::DOUBLE[], lambda x, i:
      CASE WHEN bit_count(({b} & (i - 1))::BIGINT) % 2 = 0 THEN x ELSE -x END)) AS s{b}"""
    for b in (1, 2, 3, 4)
)
ORACLES["bucketed_topk"] = with_parts(
    f"sides AS (SELECT *, {_SIDES} FROM embeddings)",
    """bucketed AS (
  SELECT *, (s1 >= 0)::INT + 2 * (s2 >= 0)::INT + 4 * (s3 >= 0)::INT + 8 * (s4 >= 0)::INT AS bucket
  FROM sides
)""",
    """margins AS (
  SELECT vec_id, bucket, unnest([{'m': abs(s1), 'b': 1}, {'m': abs(s2), 'b': 2},
    {'m': abs(s3), 'b': 4}, {'m': abs(s4), 'b': 8}], recursive := true) FROM bucketed
)""",
    """probes AS (
  SELECT vec_id, bucket AS probe FROM bucketed
  UNION ALL
  SELECT vec_id, xor(bucket, b) FROM (SELECT * FROM margins
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY m, b) <= 2)
)""",
    """pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, CAST(c.label AS BIGINT) AS defect_id,
         round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) AS score
  FROM embeddings q JOIN probes ON q.vec_id = probes.vec_id
  JOIN bucketed c ON c.bucket = probes.probe AND c.vec_id <> q.vec_id
)""",
    ranked("pairs", 5),
) + "SELECT * FROM ranked"
ORACLES["recall_at_k"] = _TOP5.rstrip() + """,
judged AS (
  SELECT e.vec_id, min(rank) FILTER (defect_id = e.label) AS best
  FROM embeddings e LEFT JOIN ranked ON query_id = e.vec_id GROUP BY e.vec_id
)
SELECT k, count(*) AS queries, count(*) FILTER (best <= k) AS hits,
       round(count(*) FILTER (best <= k) / count(*), 4) AS recall
FROM judged CROSS JOIN (SELECT unnest([1, 3, 5]::BIGINT[]) AS k) GROUP BY k"""
ORACLES["threshold_sweep"] = _OVERFETCHED.rstrip() + """,
judged AS (SELECT score, defect_id = label AS correct
           FROM ranked JOIN embeddings ON query_id = vec_id)
SELECT threshold, count(*) FILTER (score >= threshold) AS flagged,
       count(*) FILTER (score >= threshold AND correct) AS correct,
       (SELECT count(*) FROM embeddings) AS relevant,
       round(count(*) FILTER (score >= threshold AND correct)
         / nullif(count(*) FILTER (score >= threshold), 0), 4) AS precision,
       round(count(*) FILTER (score >= threshold AND correct)
         / (SELECT count(*) FROM embeddings), 4) AS recall
FROM judged CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS threshold)
GROUP BY threshold"""


# ---------------------------------------------------------------------------
# Hashed embeddings: murmur3 over the bytes of every distinct token
# ---------------------------------------------------------------------------
def _mixed(k: str) -> str:
    scaled = f"(({k})::HUGEINT * 3432918353 % 4294967296)"
    turned = f"({scaled} % 131072 * 32768 + {scaled} // 131072)"
    return f"CAST({turned} * 461845907 % 4294967296 AS BIGINT)"


def vector_parts(texts: str) -> list[str]:
    """CTEs from ``texts(side, key, body)`` to unit vectors ``unit(side, key, j, x)``."""
    half = V.EMBEDDING_DIM
    return [
        rf"""tokens AS (
  SELECT side, key, token, count(*) AS c FROM (
    SELECT side, key, unnest(regexp_extract_all(lower(body), '{W}+')) AS token FROM {texts})
  GROUP BY side, key, token
)""",
        """bytes AS (
  SELECT token, list_transform(range(octet_length(encode(token))),
    lambda i: ('0x' || substr(hex(encode(token)), 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT token FROM tokens)
)""",
        f"""folded AS (
  SELECT token, len(b) AS n, b[len(b) - len(b) % 4 + 1:] AS tail, list_reduce(
    list_transform(range(len(b) // 4), lambda i: {_mixed(
        "b[4 * i + 1] + 256 * b[4 * i + 2] + 65536 * b[4 * i + 3] + 16777216 * b[4 * i + 4]")}),
    lambda h, k: (xor(h, k) % 524288 * 8192 + xor(h, k) // 524288) * 5 % 4294967296
      + 3864292196 - CASE WHEN (xor(h, k) % 524288 * 8192 + xor(h, k) // 524288) * 5 % 4294967296
      + 3864292196 >= 4294967296 THEN 4294967296 ELSE 0 END,
    42::BIGINT) AS h
  FROM bytes
)""",
        f"""tailed AS (
  SELECT token, xor(n, CASE WHEN len(tail) = 0 THEN h ELSE xor(h, {_mixed(
      "tail[1] + 256 * coalesce(tail[2], 0) + 65536 * coalesce(tail[3], 0)")}) END) AS h
  FROM folded
)""",
        "mixed1 AS (SELECT token, CAST(xor(h, h >> 16)::HUGEINT * 2246822507 % 4294967296"
        " AS BIGINT) AS h FROM tailed)",
        "mixed2 AS (SELECT token, CAST(xor(h, h >> 13)::HUGEINT * 3266489909 % 4294967296"
        " AS BIGINT) AS h FROM mixed1)",
        f"""slots AS (
  SELECT token, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END % {2 * half}
    + {2 * half}) % {2 * half} AS slot FROM (SELECT token, xor(h, h >> 16) AS h FROM mixed2)
)""",
        f"""summed AS (
  SELECT side, key, slot % {half} AS j, sum(CASE WHEN slot < {half} THEN c ELSE -c END)::DOUBLE AS v
  FROM tokens JOIN slots ON tokens.token = slots.token GROUP BY side, key, slot % {half}
  HAVING v <> 0
)""",
        """unit AS (
  SELECT side, key, j, (v / sqrt(sum(v * v) OVER (PARTITION BY side, key)))::FLOAT::DOUBLE AS x
  FROM summed
)""",
    ]


ORACLES["embedded_documents"] = with_parts(
    "texts AS (SELECT 'd' AS side, doc_id AS key, text AS body FROM documents)",
    *vector_parts("texts"),
) + """
SELECT doc_id, count(x) AS nonzero, coalesce(round(sum(abs(x)), 3), 0) AS total,
       coalesce(round(sum(x * (j + 1)), 1), 0) AS moment
FROM documents LEFT JOIN unit ON doc_id = key GROUP BY doc_id"""


def questions(texts: str) -> list[str]:
    """CTEs from SQL of (key, body) to ``q_asked(key, body)``: pieces of the cleaned texts."""
    cut = [
        part.replace("bodies", "q_bodies").replace("windows", "q_windows")
        .replace("cut AS", "q_cut AS").replace("FROM cut", "FROM q_cut")
        .replace("pieces AS", "q_pieces AS")
        for part in chunk_parts("q_given", V.CHUNK_SIZE, V.CHUNK_OVERLAP)
    ]
    return [
        f"q_given AS (SELECT key, {clean('body')} AS body FROM ({texts}))",
        *cut,
        "q_asked AS (SELECT key || '::question' || chunk_index AS key, text AS body FROM q_pieces)",
    ]


def searched(queries: str, k: int, condition: str = "true", before=()) -> list[str]:
    """CTEs from ``queries`` SQL of (key, body) to ``hits`` over the document chunks.

    Keys that differ by the number of their question alone are one query.
    """
    return [
        *before,
        *DOCUMENT_CHUNKS,
        f"asked AS ({queries})",
        f"""texts AS (
  SELECT 'q' AS side, CAST(key AS VARCHAR) AS key, body FROM asked
  UNION ALL SELECT 'c', chunk_id, text FROM chunks WHERE {condition}
)""",
        *vector_parts("texts"),
        """pairs AS (
  SELECT regexp_replace(q.key, '::question[0-9]+$', '') AS query_id, c.key AS chunk_id,
         any_value(defect_id) AS defect_id,
         round(sum(q.x * c.x), 4) AS score
  FROM unit q JOIN unit c ON q.side = 'q' AND c.side = 'c' AND q.j = c.j
  JOIN chunks ON chunks.chunk_id = c.key GROUP BY q.key, c.key
)""",
        best_of("pairs"),
        ranked("best", k),
        """hits AS (
  SELECT query_id, rank, ranked.chunk_id, ranked.defect_id, score, title,
         coalesce(severity, '') AS severity, resolution,
         coalesce(resolution_note, '') AS resolution_note
  FROM ranked JOIN chunks ON ranked.chunk_id = chunks.chunk_id
)""",
    ]


BENCHMARK = "SELECT item_id AS key, text AS body FROM benchmark"
ASKED = "SELECT * FROM q_asked"
BENCHMARK_QUESTIONS = questions(BENCHMARK)
CONVERSATION_QUESTIONS = questions(
    "SELECT conv_id || '-' || turn AS key, text AS body FROM conversations"
)
ORACLES["text_search"] = with_parts(*searched(BENCHMARK, 5), recursive=True) + """
SELECT CAST(query_id AS BIGINT) AS query_id, rank, defect_id, chunk_id, score,
       title, resolution, resolution IN ('fixed', 'done') AS is_resolved_fixed FROM hits"""
ORACLES["submission_search"] = with_parts(
    *searched(ASKED, 3, before=CONVERSATION_QUESTIONS), recursive=True
) + """
SELECT query_id AS submission_id, rank, defect_id, score, severity FROM hits"""
ORACLES["fix_notes"] = with_parts(
    *searched(ASKED, 3, "resolution = 'fixed'", BENCHMARK_QUESTIONS), recursive=True
) + """
SELECT CAST(query_id AS BIGINT) AS submission_id, rank, defect_id, score,
       resolution, resolution_note FROM hits"""
ORACLES["stream_submission_matches"] = with_parts(
    *searched(ASKED, 5, before=BENCHMARK_QUESTIONS), recursive=True
) + """
SELECT CAST(query_id AS BIGINT) AS submission_id, rank, defect_id, score,
       score >= 0.45 AS is_duplicate FROM hits"""
ORACLES["triage_routes"] = with_parts(
    *searched(ASKED, 3, before=CONVERSATION_QUESTIONS),
    "subs AS (SELECT conv_id || '-' || turn AS submission_id, text AS t FROM conversations)",
    *typed(),
    f"""triaged AS (
  SELECT submission_id, artifact_type, {severity_guess('t')} AS severity,
         artifact_type <> 'unknown' AS is_actionable
  FROM types JOIN subs USING (submission_id)
)""",
    """summary AS (
  SELECT query_id AS submission_id, count(*) FILTER (score >= 0.45) AS n_duplicates,
         arg_min(defect_id, rank) AS best, max(score) AS best_score FROM hits GROUP BY query_id
)""",
    recursive=True,
) + """
SELECT t.submission_id, artifact_type, severity, is_actionable,
       CASE WHEN is_actionable THEN coalesce(n_duplicates, 0) ELSE 0 END AS n_duplicates,
       is_actionable AND coalesce(n_duplicates, 0) > 0 AS is_duplicate,
       CASE WHEN is_actionable AND n_duplicates > 0 THEN best END AS canonical_defect,
       CASE WHEN is_actionable THEN best_score END AS best_score,
       CASE WHEN NOT is_actionable THEN 'reject'
            WHEN coalesce(n_duplicates, 0) > 0 THEN 'report' ELSE 'root_cause' END AS route
FROM triaged t LEFT JOIN summary s ON t.submission_id = s.submission_id"""

ORACLES["clean_pages_capped"] = f"SELECT page_id, {clean('html', limit=20000)} AS text FROM pages"
ORACLES["csv_mixed_headers"] = ORACLES["jira_records"]
ORACLES["kb_append_versions"] = """
SELECT 'doc-' || doc_id AS defect_id, 1 AS versions, true AS whole, true AS single FROM documents"""
# The composed traces have at most two frames for each head and fewer than twenty signals.
ORACLES["normalized_texts_capped"] = ORACLES["normalized_texts"].replace(
    "normalized_text FROM normalized", "left(normalized_text, 4000) AS normalized_text FROM normalized"
)
ORACLES["uploaded_files_scan"] = """
SELECT text || chr(10) AS raw_text, octet_length(encode(text)) + 1 AS size FROM benchmark"""
ORACLES["log_file_findings"] = with_parts(
    f"lines AS (SELECT event_id AS submission_id, {LOG_LINE} AS line, 1 AS n FROM events)", entries()
) + "SELECT level, count(*) AS n FROM entries GROUP BY level"

# A stream in parts, or two streams into one table, give what one pass gives.
ORACLES["stream_replayed_matches"] = ORACLES["stream_submission_matches"]
ORACLES["stream_levels_of_two_hosts"] = ORACLES["stream_level_windows"]
