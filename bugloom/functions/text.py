"""Text cleaning, redaction, digests of whole texts."""

import html

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugloom import vocabulary as V
from bugloom.functions.regex import (
    _SPACE,
    at_most,
    java_regex,
    matches,
    strip,
    unify_newlines,
)

# Trailing white space of a line in a reversed text: all white space but the line feed. The feed
# comes first, so that the dear class is tried at line ends alone.
_LINE_TAIL = rf"\n[{_SPACE}&&[^\n]]++"


_PLAIN = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
_OTHER_AMPERSAND = "&(?!" + "|".join(entity[1:] for entity in _PLAIN) + ")"


@F.udf(T.StringType(), useArrow=False)
def _unescape(text: str | None) -> str | None:
    """Row by row: whole pages in Arrow batches of thousands would fill a worker's memory."""
    return None if text is None else html.unescape(text)


def unescape_entities(col: Column) -> Column:
    """Resolve HTML5 entities. Texts whose ampersands all begin one of ``_PLAIN`` are resolved by
    replacement, ampersands last; only texts with another ampersand travel to Python."""
    plain = col
    for entity, char in _PLAIN.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    other = col.contains("&") & col.rlike(_OTHER_AMPERSAND)
    return F.coalesce(_unescape(F.when(other, col)), plain)


def clean_text(
    col: Column, redact: bool = False, max_chars: int | None = None
) -> Column:
    """Entities, newlines, tags, optional redaction, white space; NULL gives ''.

    The whole text is cleaned and kept, unless ``max_chars`` is given.
    """
    text = unify_newlines(unescape_entities(F.coalesce(col, F.lit(""))))
    text = F.regexp_replace(text, V.TAG, " ")
    if redact:
        text = F.regexp_replace(text, java_regex(V.URL), "<url>")
        text = F.regexp_replace(text, java_regex(V.EMAIL), "<email>")
    # \v inside a Java class would also take line feeds, hence \x0B.
    text = F.regexp_replace(text, r"[ \t\f\x0B]+", " ")
    # The last line's tail is left to ``strip``.
    text = F.reverse(F.regexp_replace(F.reverse(text), _LINE_TAIL, "\n"))
    text = strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))
    return at_most(text, max_chars)


def char_count(col: Column) -> Column:
    return F.length(col)


def line_count(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit(""))) + 1


def has_trace(col: Column) -> Column:
    """Does the text show signs of a stack trace?"""
    return matches(F.coalesce(col, F.lit("")), V.TRACE_HINT, multiline=True)
