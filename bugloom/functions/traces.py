"""Exception chains of stack traces, from the line array of a text.

Each extractor classifies all lines once, finds the positions of the heads, and cuts the
frames of a head out of the classified array with ``slice``. Nothing is shuffled: a text is
one row, so no group of lines can grow beyond it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions.regex import (
    bind,
    contains_any,
    extract,
    first_items,
    is_blank,
    matches,
    strip,
    stripped_matches,
)

FRAME_TYPE = "struct<raw:string,file:string,line:bigint,function:string,module:string>"
EXCEPTION_TYPE = (
    f"struct<exception_type:string,message:string,frames:array<{FRAME_TYPE}>,is_cause:boolean>"
)
CHAIN_TYPE = f"array<{EXCEPTION_TYPE}>"


def _frame(raw, file=None, line=None, function=None, module=None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        strip(raw).alias("raw"),
        (text if file is None else file).alias("file"),
        F.expr("cast(null as bigint)").alias("line") if line is None
        else line.try_cast("bigint").alias("line"),
        (text if function is None else function).alias("function"),
        (text if module is None else module).alias("module"),
    )


def _exception(kind: Column, message: Column, frames: Column, is_cause: Column) -> Column:
    return F.struct(
        kind.alias("exception_type"),
        strip(message).alias("message"),
        frames.alias("frames"),
        is_cause.alias("is_cause"),
    )


def _positions(items: Column, wanted) -> Column:
    """array<int>: 0-based positions of the items that ``wanted`` accepts."""
    marked = F.transform(items, lambda x, i: F.when(wanted(x), i))
    return F.array_compact(marked)


def _between(items: Column, after: Column, before: Column) -> Column:
    """Items strictly between two 0-based positions."""
    return F.slice(items, after + 2, F.greatest(before - after - 1, F.lit(0)))


# ---------------------------------------------------------------------------
# Java: a head owns the frame lines up to the next head
# ---------------------------------------------------------------------------
def _java_frame(line: Column) -> Column:
    def build(parts: Column) -> Column:
        signature, location = parts["signature"], parts["location"]
        function = F.substring_index(signature, ".", -1)
        before = F.length(signature) - F.length(function) - 1
        return _frame(
            line,
            file=F.nullif(extract(location, V.JAVA_LOCATION, 1), F.lit("")),
            line=F.nullif(extract(location, V.JAVA_LOCATION, 2), F.lit("")),
            function=function,
            module=F.when(before >= 0, F.substring(signature, F.lit(1), before)),
        )

    parts = F.struct(
        extract(line, V.JAVA_FRAME, 1).alias("signature"),
        extract(line, V.JAVA_FRAME, 2).alias("location"),
    )
    return bind(parts, build)


def _java_head(line: Column, is_cause: Column, frames: Column) -> Column:
    def part(group: int) -> Column:
        return F.when(is_cause, extract(line, V.JAVA_CAUSE, group)).otherwise(
            extract(strip(line), V.JAVA_EXCEPTION, group)
        )

    return _exception(part(1), part(2), frames, is_cause)


def java_chain(lines: Column) -> Column:
    def classify(line: Column) -> Column:
        is_cause = matches(line, V.JAVA_CAUSE, literals=("Caused by:",))
        is_frame = matches(line, V.JAVA_FRAME, literals=("(",))
        is_thrown = stripped_matches(line, V.JAVA_EXCEPTION, V.JAVA_TYPE_ENDS)
        return F.struct(
            line.alias("line"),
            is_cause.alias("is_cause"),
            (~is_frame & (is_cause | is_thrown)).alias("is_head"),
            is_frame.alias("is_frame"),
        )

    def chain(items: Column, heads: Column) -> Column:
        return F.transform(
            heads,
            lambda at, n: _java_head(
                F.get(items, at)["line"],
                F.get(items, at)["is_cause"],
                F.transform(
                    _between(items, at, F.coalesce(F.get(heads, n + 1), F.size(items))),
                    lambda x: _java_frame(x["line"]),
                ),
            ),
        )

    kept = F.filter(F.transform(lines, classify), lambda x: x["is_head"] | x["is_frame"])
    return bind(
        kept,
        lambda items: bind(
            _positions(items, lambda x: x["is_head"]), lambda heads: chain(items, heads)
        ),
    ).cast(CHAIN_TYPE)


# ---------------------------------------------------------------------------
# Python: a header opens a block that an exception line closes
# ---------------------------------------------------------------------------
def _python_frame(line: Column) -> Column:
    return _frame(
        line,
        file=extract(line, V.PYTHON_FRAME, 1),
        line=extract(line, V.PYTHON_FRAME, 2),
        function=extract(line, V.PYTHON_FRAME, 3),
    )


def _python_line(line: Column) -> Column:
    """Role of a line inside a block, and whether it is a header."""
    is_exception = stripped_matches(line, V.PYTHON_EXCEPTION, V.PYTHON_TYPE_ENDS)
    role = (
        F.when(matches(line, V.PYTHON_FRAME, literals=('File "',)), "frame")
        .when(is_exception, "exception")
        .when(is_blank(line) | contains_any(line, V.PYTHON_CHAIN_NOTES), "gap")
        .otherwise("other")
    )
    return F.struct(
        line.alias("line"),
        role.alias("role"),
        line.contains(V.PYTHON_HEADER).alias("is_header"),
        strip(line).startswith("File").alias("like_frame"),
    )


def _python_blocks(items: Column) -> Column:
    """array<struct<header,close>>: positions of the blocks that reach an exception line.

    A fold over the roles. ``header`` is the open block's header or NULL; ``source_due``
    says that the line before was a frame, so that the next one is its source text.
    """
    block = "array<struct<header:int,close:int>>"

    def state(at, header, source_due, blocks) -> Column:
        return F.struct(
            (at + 1).alias("at"),
            header.cast("int").alias("header"),
            source_due.alias("source_due"),
            blocks.alias("blocks"),
        )

    def step(acc: Column, x: Column) -> Column:
        at, header, blocks = acc["at"], acc["header"], acc["blocks"]
        no, yes = F.lit(False), F.lit(True)
        outside = state(at, F.when(x["is_header"], at), no, blocks)
        closed = F.concat(blocks, F.array(F.struct(header.alias("header"), at.alias("close"))))
        return (
            F.when(header.isNull(), outside)
            .when(x["role"] == "frame", state(at, header, yes, blocks))
            .when(acc["source_due"] & ~x["like_frame"], state(at, header, no, blocks))
            .when(x["role"] == "exception", state(at, F.lit(None), no, closed))
            .when(x["role"] == "gap", state(at, header, no, blocks))
            .otherwise(outside)
        )

    init = F.struct(
        F.lit(0).alias("at"),
        F.lit(None).cast("int").alias("header"),
        F.lit(False).alias("source_due"),
        F.array().cast(block).alias("blocks"),
    )
    return F.aggregate(items, init, step)["blocks"]


def python_chain(lines: Column) -> Column:
    def chain(items: Column, blocks: Column) -> Column:
        def exception(b: Column, n: Column) -> Column:
            last = strip(F.get(items, b["close"])["line"])
            body = _between(items, b["header"], b["close"])
            frames = F.transform(
                F.filter(body, lambda x: x["role"] == "frame"),
                lambda x: _python_frame(x["line"]),
            )
            return _exception(
                extract(last, V.PYTHON_EXCEPTION, 1),
                extract(last, V.PYTHON_EXCEPTION, 2),
                frames,
                n > 0,
            )

        return F.transform(blocks, exception)

    return bind(
        F.transform(lines, _python_line),
        lambda items: bind(_python_blocks(items), lambda blocks: chain(items, blocks)),
    ).cast(CHAIN_TYPE)


# ---------------------------------------------------------------------------
# Other languages: a bare head takes the next run of script frames after it
# ---------------------------------------------------------------------------
def _script_frame(line: Column) -> Column:
    return _frame(
        line,
        file=extract(line, V.SCRIPT_FRAME, 2),
        line=extract(line, V.SCRIPT_FRAME, 3),
        function=F.nullif(strip(extract(line, V.SCRIPT_FRAME, 1)), F.lit("")),
    )


def generic_chain(lines: Column, most: int | None = None) -> Column:
    def is_head(line: Column) -> Column:
        return stripped_matches(
            line, V.GENERIC_EXCEPTION, V.GENERIC_TYPE_ENDS
        ) | stripped_matches(line, V.PANIC_LINE, ("panic:",))

    def head(line: Column, frames: Column) -> Column:
        bare = matches(line, V.GENERIC_EXCEPTION)

        def part(group: int) -> Column:
            return F.when(bare, extract(line, V.GENERIC_EXCEPTION, group)).otherwise(
                extract(line, V.PANIC_LINE, group)
            )

        return _exception(part(1), part(2), frames, F.lit(False))

    def next_run(items: Column, flags: Column, at: Column) -> Column:
        """Lines of the first contiguous run of frames after position ``at``."""
        size = F.size(items)

        def run(first: Column) -> Column:
            stop = F.array_position(F.slice(flags, first, size), F.lit(False))
            length = F.when(stop > 0, stop - 1).otherwise(size).cast("int")
            return F.slice(items, first, length)

        offset = F.array_position(F.slice(flags, at + 2, size), F.lit(True)).cast("int")
        return F.when(offset > 0, run(at + 1 + offset)).otherwise(
            F.array().cast("array<string>")
        )

    def chain(flags: Column, heads: Column) -> Column:
        return F.transform(
            heads,
            lambda at: head(
                strip(F.get(lines, at)),
                F.transform(next_run(lines, flags, at), _script_frame),
            ),
        )

    def with_heads(heads: Column) -> Column:
        flags = F.transform(
            lines, lambda line: matches(line, V.SCRIPT_FRAME, literals=("at",))
        )
        return F.when(F.size(heads) == 0, F.array().cast(CHAIN_TYPE)).otherwise(
            bind(flags, lambda f: chain(f, heads).cast(CHAIN_TYPE))
        )

    return bind(first_items(_positions(lines, is_head), most), with_heads)


# ---------------------------------------------------------------------------
# Dispatch
# ---------------------------------------------------------------------------
def has_python_header(text: Column) -> Column:
    return text.contains(V.PYTHON_HEADER)


def has_java_marker(text: Column) -> Column:
    return text.contains("Exception in thread") | text.contains("Caused by:")


def exception_chain(
    text: Column, lines: Column, language: Column, most_generic: int | None = None
) -> Column:
    """Chain of the first extractor that applies and finds one."""
    python_found = F.when(has_python_header(text), python_chain(lines))
    java_found = F.when(
        F.coalesce(language == "java", F.lit(False)) | has_java_marker(text), java_chain(lines)
    )

    def non_empty(chain: Column) -> Column:
        return bind(chain, lambda c: F.when(F.size(c) > 0, c))

    return F.coalesce(non_empty(python_found), non_empty(java_found), generic_chain(lines, most_generic))


def looks_like_trace(text: Column) -> Column:
    return (
        has_python_header(text)
        | has_java_marker(text)
        | strip(text).startswith("panic:")
        | text.contains("goroutine ")
    )


def summary(exception: Column) -> Column:
    """``type: message`` without trailing colons."""
    joined = F.concat(exception["exception_type"], F.lit(": "), exception["message"])
    return F.regexp_replace(strip(joined), ":+$", "")


def root_cause(exceptions: Column) -> Column:
    return F.try_element_at(exceptions, F.lit(-1))
