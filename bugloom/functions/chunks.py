"""Sliding-window text splitting in one native pass per text.

Rule: a text up to ``size`` characters is one piece. A longer one is covered by windows of
``size`` characters; a window that is not the last ends at the last blank or line feed among
its final ``overlap`` characters, if there is one. The next window starts ``overlap``
characters before that end. Pieces are stripped and empty ones dropped.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugloom import vocabulary as V
from bugloom.functions.regex import bind, strip


def _strides(text: Column, size: int, overlap: int) -> Column:
    """array<string>: each window without its last ``overlap`` characters.

    Strides are disjoint and cover the text, so one ``regexp_extract_all`` finds them:
    the rest of the text once it fits a window, else the longest stride whose window ends
    before a break, else a full one.
    """
    step = size - overlap
    rest = rf"(?!.{{{size + 1}}}).+"
    at_break = rf".{{{step - overlap},{step - 1}}}(?=.{{{overlap}}}[ \n])"
    full = rf".{{{step}}}"
    options = [rest, at_break, full] if overlap else [rest, full]
    return F.regexp_extract_all(text, F.lit("(?s)" + "|".join(options)), F.lit(0))


def _windows_from_strides(text: Column, size: int, overlap: int) -> Column:
    """Every window is its stride plus the first ``overlap`` characters of the next one."""
    return bind(
        _strides(text, size, overlap),
        lambda strides: F.transform(
            strides,
            lambda stride, i: F.concat(
                stride, F.substring(F.coalesce(F.get(strides, i + 1), F.lit("")), 1, overlap)
            ),
        ),
    )


def _windows_by_fold(text: Column, length: Column, size: int, overlap: int) -> Column:
    """The same rule for overlaps above a third of the size, window after window.

    The start moves by at least ``advance``, which bounds the number of windows.
    """
    step = max(size - overlap, 1)
    advance = max(step - overlap, 1)
    most = F.ceil((length - size) / F.lit(advance)).cast("int") + 1

    def next_window(state: Column, _: Column) -> Column:
        start = state["start"]
        backwards = F.reverse(F.substring(text, start + step + 1, F.lit(size - step)))
        end = bind(
            F.struct(
                F.nullif(F.instr(backwards, " "), F.lit(0)).alias("blank"),
                F.nullif(F.instr(backwards, "\n"), F.lit(0)).alias("feed"),
            ),
            lambda at: F.when(start + size >= length, length).otherwise(
                start + size - F.coalesce(F.least(at["blank"], at["feed"]), F.lit(0))
            ),
        )
        grown = bind(
            end,
            lambda e: F.struct(
                F.greatest(e - overlap, start + 1).alias("start"),
                (e >= length).alias("done"),
                F.concat(
                    state["windows"], F.array(F.substring(text, start + 1, e - start))
                ).alias("windows"),
            ),
        )
        return F.when(state["done"], state).otherwise(grown)

    init = F.struct(
        F.lit(0).alias("start"),
        F.lit(False).alias("done"),
        F.array().cast("array<string>").alias("windows"),
    )
    return F.aggregate(F.sequence(F.lit(1), most), init, next_window)["windows"]


def split_text(
    text: Column, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP
) -> Column:
    """array<string>: the pieces of a text."""

    def pieces(body: Column, length: Column) -> Column:
        if 0 <= 3 * overlap <= size:
            windows = _windows_from_strides(body, size, overlap)
        else:
            windows = _windows_by_fold(body, length, size, overlap)
        return (
            F.when(length == 0, F.array().cast("array<string>"))
            .when(length <= size, F.array(body))
            .otherwise(F.filter(F.transform(windows, strip), lambda p: p != ""))
        )

    return bind(
        strip(F.coalesce(text, F.lit(""))),
        lambda body: bind(F.length(body), lambda length: pieces(body, length)),
    )
