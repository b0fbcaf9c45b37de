"""Vocabularies, column aliases, text patterns and defaults.

Everything in this module is a constant of the defect data model. The patterns are
written in the common regex dialect and given their Unicode meaning by
``functions.regex.java_regex`` before Spark sees them.
"""

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES: domains of the record's enumerated columns
# ---------------------------------------------------------------------------
SOURCES = ("eclipse", "mozilla", "apache", "user_submission")
SEVERITIES = (
    "blocker", "critical", "major", "normal", "minor", "trivial", "enhancement", "unknown",
)
PRIORITIES = ("P1", "P2", "P3", "P4", "P5", "unknown")
STATUSES = (
    "new", "assigned", "reopened", "resolved", "verified", "closed", "open", "in_progress",
    "unknown",
)
RESOLUTIONS = (
    "fixed", "duplicate", "wontfix", "invalid", "worksforme", "incomplete", "unresolved", "done",
    "unknown",
)
ARTIFACT_TYPES = ("bug_report", "stack_trace", "error_log", "mixed", "unknown")

# ---------------------------------------------------------------------------
# FIXED VALUES: ordered substring vocabularies (the first needle found wins)
# ---------------------------------------------------------------------------
SEVERITY_NEEDLES = (
    ("blocker", "blocker"),
    ("critical", "critical"),
    ("major", "major"),
    ("normal", "normal"),
    ("minor", "minor"),
    ("trivial", "trivial"),
    ("enhancement", "enhancement"),
    ("feature", "enhancement"),
)
STATUS_NEEDLES = (
    ("unconfirmed", "new"),
    ("new", "new"),
    ("open", "open"),
    ("in progress", "in_progress"),
    ("in_progress", "in_progress"),
    ("assigned", "assigned"),
    ("reopened", "reopened"),
    ("resolved", "resolved"),
    ("verified", "verified"),
    ("closed", "closed"),
    ("done", "closed"),
)
RESOLUTION_NEEDLES = (
    ("fixed", "fixed"),
    ("done", "done"),
    ("duplicate", "duplicate"),
    ("wontfix", "wontfix"),
    ("won't fix", "wontfix"),
    ("won't do", "wontfix"),
    ("invalid", "invalid"),
    ("not a bug", "invalid"),
    ("worksforme", "worksforme"),
    ("works for me", "worksforme"),
    ("cannot reproduce", "worksforme"),
    ("incomplete", "incomplete"),
)
SEVERITY_CUES = (
    ("blocker", ("blocker", "showstopper", "data loss", "corruption")),
    ("critical", ("critical", "crash", "hang", "deadlock", "cannot start", "unusable")),
    ("major", ("major", "broken", "fails", "exception", "error", "regression")),
    ("minor", ("minor", "cosmetic", "typo", "small")),
    ("trivial", ("trivial", "nit")),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: exact vocabularies (whole lower-cased value)
# ---------------------------------------------------------------------------
PRIORITY_NAMES = {
    "p1": "P1", "p2": "P2", "p3": "P3", "p4": "P4", "p5": "P5",
    "highest": "P1", "high": "P2", "medium": "P3", "normal": "P3", "low": "P4", "lowest": "P5",
    "blocker": "P1", "critical": "P2", "major": "P3", "minor": "P4", "trivial": "P5",
}
JIRA_SEVERITY_NAMES = {
    "blocker": "blocker", "critical": "critical", "major": "major", "minor": "minor",
    "trivial": "trivial",
}
FIXED_RESOLUTIONS = ("fixed", "done")

# ---------------------------------------------------------------------------
# FIXED VALUES: column aliases of tracker exports, in order of preference
# ---------------------------------------------------------------------------
BUGZILLA_ALIASES = {
    "id": ("bug_id", "id", "bugID", "bug id", "bugid"),
    "title": ("short_desc", "summary", "title", "shortdesc", "short description"),
    "description": ("description", "long_desc", "comments", "comment", "detail"),
    "resolution": ("resolution", "current_resolution"),
    "duplicate": ("dup_id", "duplicate_of", "dupID", "duplicate"),
    "project": ("product", "project"),
    "component": ("component",),
    "severity": ("bug_severity", "severity"),
    "priority": ("priority",),
    "status": ("bug_status", "status", "current_status"),
    "note": ("resolution_note", "fix", "resolution_desc"),
    "reporter": ("reporter", "reported_by"),
    "assignee": ("assigned_to", "assignee", "owner"),
    "created": ("creation_ts", "opening", "created", "creation_time", "opendate"),
    "resolved": ("delta_ts", "resolved", "resolution_date", "closed"),
}
JIRA_ALIASES = {
    "id": ("key", "issue_key", "issuekey", "issue key", "id"),
    "title": ("summary", "title", "short_desc"),
    "description": ("description", "desc", "detail"),
    "priority": ("priority", "priority.name", "priority_name"),
    "duplicate": ("duplicate_of", "dup_id", "duplicate"),
    "project": ("project.key", "project", "project_key", "project.name", "project_name"),
    "component": ("components", "component", "components.name"),
    "status": ("status", "status.name"),
    "resolution": ("resolution", "resolution.name"),
    "note": ("resolution.description", "resolution_note", "comments", "fix"),
    "reporter": ("reporter", "creator"),
    "assignee": ("assignee",),
    "created": ("created", "created_at", "creation_date"),
    "resolved": ("resolutiondate", "resolved", "resolution_date", "updated"),
    "keywords": ("issuetype.name", "issuetype", "type"),
}
JIRA_TYPE_COLUMNS = ("issuetype.name", "issuetype", "issue_type", "type")
DEFECT_TYPE_CUES = ("bug", "defect")
URL_PREFIXES = {
    "eclipse": "https://bugs.eclipse.org/bugs/show_bug.cgi?id=",
    "mozilla": "https://bugzilla.mozilla.org/show_bug.cgi?id=",
}
JIRA_URL_PREFIX = "https://issues.apache.org/jira/browse/"
SAMPLE_FILES = {
    "eclipse": "eclipse_bugs.csv",
    "mozilla": "mozilla_bugs.csv",
    "apache": "apache_issues.csv",
}
XML_ATTRIBUTES = ("short_desc", "severity", "priority", "bug_status", "resolution", "component")
UPLOAD_EXTENSIONS = (
    "txt", "log", "out", "json", "xml", "csv", "py", "java", "js", "trace", "md",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: text patterns
# ---------------------------------------------------------------------------
TAG = r"<[^>]+>"
URL = r"https?://\S+"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"

PYTHON_HEADER = "Traceback (most recent call last):"
PYTHON_FRAME = r'^\s*File "([^"]+)", line (\d+), in (.+)$'
PYTHON_EXCEPTION = (
    r"^([A-Za-z_][\w.]*"
    r"(?:Error|Exception|Warning|Exit|Interrupt|Failure|Timeout|StopIteration|"
    r"KeyboardInterrupt|GeneratorExit))"
    r"(?::\s?(.*))?$"
)
PYTHON_CHAIN_NOTES = (
    "During handling of the above exception",
    "The above exception was the direct cause",
)
JAVA_FRAME = r"^\s*at\s+([\w$.<>]+)\(([^)]*)\)"
JAVA_EXCEPTION = (
    r'^(?:Exception in thread "[^"]*"\s+)?'
    r"((?:[\w$]+\.)+[\w$]+(?:Exception|Error|Throwable))"
    r"(?::\s?(.*))?$"
)
JAVA_CAUSE = (
    r"^Caused by:\s*((?:[\w$]+\.)+[\w$]+(?:Exception|Error|Throwable))"
    r"(?::\s?(.*))?$"
)
JAVA_LOCATION = r"^([^:]+):(\d+)"
SCRIPT_FRAME = r"^\s*at\s+(?:([^()]+?)\s+\()?([^()]+?):(\d+):\d+\)?\s*$"
GENERIC_EXCEPTION = r"^([A-Za-z_][\w.]*(?:Error|Exception))(?::\s?(.*))?$"
PANIC_LINE = r"^(panic):\s?(.*)$"

# Literals of which every match of a pattern contains one.
JAVA_TYPE_ENDS = ("Exception", "Error", "Throwable")
GENERIC_TYPE_ENDS = ("Error", "Exception")
PYTHON_TYPE_ENDS = (
    "Error", "Exception", "Warning", "Exit", "Interrupt", "Failure", "Timeout", "StopIteration",
)

# (language, ((pattern, literal every match of it contains), ...))
LANGUAGE_SIGNALS = (
    ("python", (
        (r"Traceback \(most recent call last\)", "Traceback (most recent call last)"),
        (r'File "[^"]+\.py"', '.py"'),
        (r"\.py\", line \d+", '.py", line '),
    )),
    ("java", (
        (r"Exception in thread", "Exception in thread"),
        (r"\bat (?:[\w$]+\.)+[\w$]+\(", "at "),
        (r"Caused by:", "Caused by:"),
        (r"\.java:\d+", ".java:"),
    )),
    ("javascript", (
        (r"\bat .+\.js:\d+:\d+", ".js:"),
        (r"node_modules", "node_modules"),
        (r"ReferenceError", "ReferenceError"),
        (r"\bTypeError: Cannot read", "TypeError: Cannot read"),
    )),
    ("csharp", (
        (r"System\.[A-Za-z.]+Exception", "System."),
        (r"\bat .+\) in .+\.cs:line \d+", ".cs:line "),
    )),
    ("go", (
        (r"^panic:", "panic:"),
        (r"goroutine \d+ \[", "goroutine "),
        (r"\.go:\d+ \+0x", ".go:"),
    )),
    ("ruby", (
        (r"\.rb:\d+:in ", ".rb:"),
        (r"\(([A-Z]\w*Error)\)", "Error)"),
    )),
)
TRACE_HINT = (
    r"Traceback \(most recent call last\)|Exception in thread|Caused by:|"
    r"\bat (?:[\w$]+\.){2,}[\w$]+\(|^panic:"
)

LOG_LEVELS = (
    "TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "ERR", "FATAL", "CRITICAL",
    "SEVERE",
)
LOG_LEVEL = r"\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL|SEVERE)\b"
LOG_LEVEL_ALIASES = {"WARN": "WARNING", "ERR": "ERROR"}
SALIENT_LEVELS = ("ERROR", "FATAL", "CRITICAL", "SEVERE")
TIMESTAMP = (
    r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
)
LOGGER = r"[\[(]?((?:[\w$]+\.){2,}[\w$]+)[\])]?"
MESSAGE_LEAD = " -:\t]"

ERROR_CODE = (
    r"\b(?:ORA-\d{4,5}|SQLSTATE\[\w+\]|errno\s*[:=]?\s*\d+|E\d{3,5}|"
    r"HTTP\s*[45]\d{2}|status(?:\s*code)?\s*[:=]?\s*[45]\d{2}|0x[0-9A-Fa-f]{6,})\b"
)
FILE_NAME = r"\b[\w./-]+\.(?:java|py|js|ts|tsx|jsx|cs|go|rb|cpp|cc|c|h|kt|scala)\b"

LABEL_COLON = r"^\s*#{0,4}\s*\**\s*([A-Za-z][A-Za-z /]{1,30}?)\s*\**\s*[:：]\s*(.*)$"
LABEL_HEADING = r"^\s*#{1,4}\s*\**\s*([A-Za-z][A-Za-z /]{1,30}?)\s*\**\s*$"
HEADING = r"^\s*#{1,4}\s+(.+)$"
HEADING_START = r"^\s*#{1,4}\s+\w"
PROSE_CUES = ("steps to reproduce", "expected", "actual result", "reproduc")

# FIXED VALUES: report section labels and the field each one fills
SECTION_LABELS = {
    "summary": "summary",
    "title": "summary",
    "description": "description",
    "steps to reproduce": "steps_to_reproduce",
    "steps": "steps_to_reproduce",
    "reproduction": "steps_to_reproduce",
    "how to reproduce": "steps_to_reproduce",
    "expected": "expected",
    "expected behavior": "expected",
    "expected result": "expected",
    "actual": "actual",
    "actual behavior": "actual",
    "actual result": "actual",
    "observed": "actual",
    "environment": "environment",
    "system": "environment",
    "platform": "environment",
    "version": "version",
    "severity": "severity",
    "priority": "priority",
}
FIELD_NAMES = (
    "summary", "description", "steps_to_reproduce", "expected", "actual", "environment",
    "version", "severity", "priority",
)
NORMALIZED_FIELDS = ("steps_to_reproduce", "expected", "actual", "description", "environment")

# ---------------------------------------------------------------------------
# FIXED VALUES: defaults
# ---------------------------------------------------------------------------
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
EMBEDDING_DIM = 384
TOP_K = 5
OVERFETCH = 4
DUPLICATE_THRESHOLD = 0.60


@dataclass(frozen=True)
class Caps:
    """Upper bounds on texts and lists; None, the default of each, cuts nothing."""

    clean_chars: int | None = None
    title_chars: int | None = None
    note_chars: int | None = None
    signals: int | None = None
    signal_frames: int | None = None
    signal_files: int | None = None
    generic_exceptions: int | None = None
    fallback_title_chars: int | None = None
    fallback_text_chars: int | None = None
    normalized_chars: int | None = None
    records_per_source: int | None = None


NO_CAPS = Caps()
PUBLISHED_CAPS = Caps(
    clean_chars=20_000,
    title_chars=500,
    note_chars=1000,
    signals=20,
    signal_frames=3,
    signal_files=5,
    generic_exceptions=3,
    fallback_title_chars=200,
    fallback_text_chars=1500,
    normalized_chars=4000,
    records_per_source=3000,
)
