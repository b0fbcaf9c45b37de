"""Threshold-scaled sketches of documents, by DataFrame functions alone.

A sketch keeps every shingle hash below a fixed fraction of the hash range. The choice depends
on the hash alone, so sketches of texts of any length can be compared, and the sketch of a union
is the union of sketches: shared hashes over own hashes estimate containment, even where one
document is many times as long as the other. A text none of whose hashes is below the fraction
keeps its smallest one, so only a text without words has an empty sketch.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bugloom.functions.regex import bind
from bugloom.llm.common import (
    id_bounds,
    id_key,
    id_range,
    shingle_hashes,
    shuffle_partitions,
)

FRACTION_BITS = 2  # keeps one hash in 2^2


def sketch(text: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """Sorted hashes whose first ``fraction_bits`` bits are zero; else the smallest hash."""

    def scaled(all_hashes: Column) -> Column:
        low = F.filter(all_hashes, lambda h: F.shiftrightunsigned(h, 64 - fraction_bits) == 0)
        return F.when(F.size(low) > 0, low).otherwise(F.slice(all_hashes, 1, 1))

    return bind(shingle_hashes(text), scaled)


def merge(a: Column, b: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """The sketch of two texts taken together (but for shingles across their seam)."""

    def scaled(both: Column) -> Column:
        low = F.filter(both, lambda h: F.shiftrightunsigned(h, 64 - fraction_bits) == 0)
        return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))

    return bind(F.sort_array(F.array_union(a, b)), scaled)


def to_text(hashes: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), " ")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches: 1 for two empty ones, 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        bind(shared, lambda n: n / (F.size(a) + F.size(b) - n))
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second holds; 1 for an empty first."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a)
    )


def with_next(docs: DataFrame, columns: dict[str, str], parts: int | None = None) -> DataFrame:
    """Each row with columns of the next one by descending doc_id; after the last, the first.

    The ids are cut into ranges at ids that occur. The rows of each range's highest id go to the
    range before, too, as its end, so one shuffle by range is all it takes. Rows of one id follow
    one another by descending text; a null id is the lowest.
    """
    parts = parts or 4 * shuffle_partitions(docs.sparkSession)
    bounds, top = id_bounds(docs, parts)
    key = F.col("_key")
    # A bound is the highest id of its range. The range above ends with it; the lowest range,
    # last in order, ends with the first of all.
    is_bound = F.array_contains(F.lit(bounds).cast("array<bigint>"), key) if bounds else F.lit(False)
    places = (
        F.when(key == F.lit(top), F.array(F.col("_own"), F.lit(0)))
        .when(is_bound, F.array(F.col("_own"), F.col("_own") + 1))
        .otherwise(F.array(F.col("_own")))
    )
    owned = docs.withColumn("_key", id_key()).withColumn("_own", id_range(bounds, key))
    names = [F.col(c) for c in docs.columns]
    placed = owned.select(*names, "_key", F.posexplode(places).alias("_copy", "_range"))
    order = Window.partitionBy("_range").orderBy("_copy", key.desc(), F.col("text").desc())
    nexts = {new: F.lead(old).over(order) for old, new in columns.items()}
    return placed.withColumns(nexts).filter(F.col("_copy") == 0).select(*names, *nexts)


def edited(text: Column, following: Column) -> Column:
    """The last half of a text replaced by as many first code points of the following one."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), F.char_length(text) - half),
        F.substring(following, F.lit(1), half),
    )


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Sketches of every document, of its edited text and of the next document.

    Returns doc_id, text, edited_text, hashes, edited_hashes, next_hashes. Null texts count as
    empty; repeated rows stay; other columns are dropped.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("hashes", sketch(F.col("text")))
    follow = with_next(own, {"text": "next_text", "hashes": "next_hashes"}, parts)
    changed = follow.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    return changed.withColumn("edited_hashes", sketch(F.col("edited_text"))).drop("next_text")
