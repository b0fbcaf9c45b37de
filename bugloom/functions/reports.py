"""Sections of written bug reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions.regex import (
    at_most,
    bind,
    contains_any,
    extract,
    java_regex,
    matches,
    strip,
)


def _field_of(line: Column) -> Column:
    """Field that a label line opens, NULL for every other line.

    Lines without colon or number sign cannot be labels and are spared the patterns.
    """
    with_colon = F.when(
        line.contains(":") | line.contains("："),
        F.nullif(extract(line, V.LABEL_COLON, 1), F.lit("")),
    )
    heading = F.when(line.contains("#"), extract(line, V.LABEL_HEADING, 1))

    def field(label: Column) -> Column:
        case = F
        for name in V.FIELD_NAMES:
            labels = [known for known, opened in V.SECTION_LABELS.items() if opened == name]
            case = case.when(label.isin(labels), name)
        return case.otherwise(F.lit(None))

    return bind(F.lower(strip(F.coalesce(with_colon, heading))), field)


def _sections(lines: Column) -> Column:
    """array<struct<field,value>> in text order, blank values dropped."""

    def build(items: Column, starts: Column) -> Column:
        def section(at: Column, n: Column) -> Column:
            stop = F.coalesce(F.get(starts, n + 1), F.size(items))
            body = F.transform(
                F.slice(items, at + 2, F.greatest(stop - at - 1, F.lit(0))),
                lambda x: x["line"],
            )
            inline = strip(extract(F.get(items, at)["line"], V.LABEL_COLON, 2))
            head = F.when(inline != "", F.array(inline)).otherwise(
                F.array().cast("array<string>")
            )
            return F.struct(
                F.get(items, at)["field"].alias("field"),
                strip(F.array_join(F.concat(head, body), "\n")).alias("value"),
            )

        return F.filter(F.transform(starts, section), lambda s: s["value"] != "")

    marked = F.transform(
        lines, lambda line: F.struct(line.alias("line"), _field_of(line).alias("field"))
    )

    def with_items(items: Column) -> Column:
        starts = F.array_compact(
            F.transform(items, lambda x, i: F.when(x["field"].isNotNull(), i))
        )
        return bind(starts, lambda s: build(items, s))

    return bind(marked, with_items)


def first_line(lines: Column, max_chars: int | None = None) -> Column:
    """First non-blank line, stripped; '' if there is none."""
    full = F.filter(lines, lambda line: strip(line) != "")
    return at_most(strip(F.coalesce(F.get(full, F.lit(0)), F.lit(""))), max_chars)


def _fallback_summary(text: Column, lines: Column, max_chars: int | None) -> Column:
    """First markdown heading, else the first non-blank line; NULL if neither exists."""
    return F.when(
        matches(text, V.HEADING, multiline=True),
        strip(extract(text, V.HEADING, 1, multiline=True)),
    ).otherwise(F.nullif(first_line(lines, max_chars), F.lit("")))


def report_fields(text: Column, lines: Column, max_chars: int | None = None) -> Column:
    """map<field, value>; sections of one field are joined in text order.

    ``max_chars`` bounds a first line that stands in for the summary.
    """

    def to_map(sections: Column) -> Column:
        def value(name: str) -> Column:
            of_field = F.filter(sections, lambda s: s["field"] == name)
            joined = F.array_join(F.transform(of_field, lambda s: s["value"]), "\n")
            return F.nullif(joined, F.lit(""))

        entries = [
            F.struct(
                F.lit(name).alias("key"),
                (
                    F.coalesce(value(name), _fallback_summary(text, lines, max_chars))
                    if name == "summary"
                    else value(name)
                ).alias("value"),
            )
            for name in V.FIELD_NAMES
        ]
        return F.map_from_entries(
            F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
        )

    return bind(_sections(lines), to_map)


def has_prose(text: Column, lines: Column) -> Column:
    """Report wording, a markdown heading, or three lines of running words."""

    def is_prose_line(line: Column) -> Column:
        words = F.size(F.split(strip(line), java_regex(r"\s+")))
        slashes = F.length(line) - F.length(F.replace(line, F.lit("/"), F.lit("")))
        # Six words and what is between them: shorter lines are not split.
        long = F.length(line) >= 11
        return ~line.startswith("at ") & long & (slashes < 2) & (words >= 6)

    return (
        bind(F.lower(text), lambda low: contains_any(low, V.PROSE_CUES))
        | matches(text, V.HEADING_START, multiline=True)
        | (F.size(F.filter(lines, is_prose_line)) >= 3)
    )
