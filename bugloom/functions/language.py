"""Programming-language fingerprints."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions.regex import bind, java_regex

LANGUAGES = tuple(name for name, _ in V.LANGUAGE_SIGNALS)


def _hits(text: Column, pattern: str, literal: str) -> Column:
    """Match count; the cheap literal test spares the regex on texts that cannot match."""
    found = F.regexp_count(text, F.lit(java_regex(pattern, multiline=True)))
    return F.when(text.contains(literal), found).otherwise(0)


def language_scores(text: Column) -> Column:
    """array<int>: total signal matches per language, in the order of ``LANGUAGES``."""
    return F.array(
        *[sum((_hits(text, p, lit) for p, lit in signals), F.lit(0))
          for _, signals in V.LANGUAGE_SIGNALS]
    )


def detect_language(text: Column) -> Column:
    """Language with most signal matches, the earlier one on ties, NULL without any."""
    names = F.array(*[F.lit(name) for name in LANGUAGES])
    return bind(
        language_scores(F.coalesce(text, F.lit(""))),
        lambda scores: F.when(
            F.array_max(scores) > 0,
            F.get(names, F.array_position(scores, F.array_max(scores)).cast("int") - 1),
        ),
    )
