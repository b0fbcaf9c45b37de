"""Regex and whitespace helpers that keep Unicode text semantics inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word, white-space and digit classes over all of Unicode. Java's own \w \s \d are ASCII only.
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_DIGIT = r"\p{Nd}"
_BOUNDARY = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"

# Every character that counts as white space at the ends of a string.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_BREAK = r"(?:\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}])"


# A dotted name's segments. Java recurses once per repetition of a group and overflows its
# stack on very long names, but for possessive repetitions. These match the same: a segment
# is only taken if another follows, and no dot is left to give back.
_SEGMENT = r"(?:[\w$]+\.)"
_POSSESSIVE_SEGMENT = r"(?:[\w$]++\.(?=[\w$]))"


def java_regex(pattern: str, multiline: bool = False) -> str:
    r"""Give ``\w \s \d \b`` Unicode meaning and make ``. ^ $`` know only ``\n``."""
    for repeated in ("+", "{2,}"):
        pattern = pattern.replace(_SEGMENT + repeated, _POSSESSIVE_SEGMENT + repeated + "+")
    if multiline and pattern.startswith(r"^\s*"):
        # White space before the marker need not reach back over lines: the marker's own line
        # starts a match too. This keeps the search linear on many blank lines.
        pattern = r"^[\s&&[^\n]]*+" + pattern[4:]
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two in (r"\w", r"\s", r"\d"):
            body = {"w": _WORD, "s": _SPACE, "d": _DIGIT}[two[1]]
            out.append(body if in_class else f"[{body}]")
        elif two == r"\S" and not in_class:
            out.append(f"[^{_SPACE}]")
        elif two == r"\b" and not in_class:
            out.append(_BOUNDARY)
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = (two[0] == "[") or (in_class and two[0] != "]")
            out.append(two[0])
            i += 1
            continue
        i += 2
    return ("(?dm)" if multiline else "(?d)") + "".join(out)


def strip(col: Column) -> Column:
    """Drop Unicode white space at both ends (Spark's ``trim`` drops only blanks)."""
    return F.btrim(col, F.lit(WHITESPACE))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def split_lines(col: Column) -> Column:
    """Lines of a text at every Unicode line boundary; a final boundary opens no new line."""
    return F.split(F.regexp_replace(col, _BREAK + r"\z", ""), _BREAK)


def unify_newlines(col: Column) -> Column:
    return F.regexp_replace(col, r"\r\n?", "\n")


def matches(
    col: Column, pattern: str, multiline: bool = False, literals: tuple[str, ...] = ()
) -> Column:
    """Regex test. Of ``literals``, every match contains one: others are spared the regex."""
    found = col.rlike(java_regex(pattern, multiline))
    return contains_any(col, literals) & found if literals else found


def stripped_matches(line: Column, pattern: str, literals: tuple[str, ...]) -> Column:
    """Regex test of a stripped line. The literals, without white space at their ends, are
    looked for in the line as it is: only lines that hold one are stripped."""
    return contains_any(line, literals) & matches(strip(line), pattern)


def extract(col: Column, pattern: str, group: int, multiline: bool = False) -> Column:
    return F.regexp_extract(col, java_regex(pattern, multiline), group)


def contains_any(col: Column, needles) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | col.contains(needle)
    return found


def at_most(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; the whole text for None."""
    return text if chars is None else F.substring(text, 1, chars)


def first_items(array: Column, n: int | None) -> Column:
    """The first ``n`` items; the whole array for None."""
    return array if n is None else F.slice(array, 1, n)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a lambda-bound variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)
