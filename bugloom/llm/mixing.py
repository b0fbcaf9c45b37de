"""Mix sources to target weights by capped water-filling, then repeat documents to the targets.

Targets: each source gets words in proportion to its weight; one whose target passes
``max_epochs`` times its size is clamped there, and the excess is shared out again by weight
until none is above. Every round is one aggregation over one row per source.

Repetitions: a source's rate target / size gives each of its documents floor(rate) whole
repetitions. The rest is reached by one more for the documents that come first in the order of
a seeded hash, up to the document whose repetition brings the sum nearest to the target. That
document is found in histograms of the hash's digits, level by level, so no task sorts a source.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bugloom.llm.common import WORD_BREAK, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
# Hexadecimal digits per level of the histogram: at most 4,096 rows per source and level.
LEVEL_DIGITS = 3
# A group of at most so many documents is put in order at once.
LEAF_ROWS = 4096


def word_count(text):
    """Words of a text between white space; none in a null one."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WORD_BREAK}|{WORD_BREAK}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WORD_BREAK))).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """One row per source: source, source_size, weight, target, whole, need.

    Sources in code-point order, null last, take the weights in turn. ``whole`` is the number of
    whole repetitions, ``need`` the words missing after them. A source without words has target
    0, as its cap is 0; without any words all targets are 0.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, not per document, passes the ranking.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_epochs
    sources = written(
        summed.withColumn("weight", weight.cast("bigint")).withColumn("cap", cap), "sources"
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = None, -1
    while True:
        # At a level, a source is clamped where level * weight reaches its cap.
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("cap")
        r = sources.agg(
            F.sum(F.when(above, F.col("cap"))).alias("caps"),
            F.sum(F.when(~above, F.col("weight"))).alias("weights"),
            F.count(F.when(above, 1)).alias("clamped"),
        ).first()
        if not r["weights"] or r["clamped"] == clamped:
            break
        clamped = r["clamped"]
        level = (total - (r["caps"] or 0)) / r["weights"]
    target = F.least(F.col("weight") * F.lit(float(level or 0)), F.col("cap").cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        sources.withColumn("target", target)
        .withColumn("whole", F.floor(rate))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .drop("cap")
    )


def _same_source(a: str, b: str):
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _in_cut():
    return _same_source("d", "c") & F.col("d._h").startswith(F.col("c.prefix"))


def last_taken(
    narrow: DataFrame, targets: DataFrame, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Where each source's order ends: source, prefix, last (hash, doc_id and size; or null)."""
    cuts = targets.select("source", "need", F.lit("").alias("prefix"))
    digits, leaves = 0, None
    while True:
        digits += LEVEL_DIGITS
        buckets = (
            narrow.alias("d").join(cuts.alias("c"), _in_cut())
            .groupBy("d.source", F.substring("d._h", 1, digits).alias("bucket"))
            .agg(F.sum("d.size").alias("words"), F.count("*").alias("rows"),
                 F.max("c.need").alias("need"))
        )
        before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        cut = buckets.withColumn("before", before - F.col("words")).filter(
            (F.col("before") <= F.col("need")) & (F.col("before") + F.col("words") > F.col("need"))
        )
        cut = written(
            cut.select("source", (F.col("need") - F.col("before")).alias("need"),
                       F.col("bucket").alias("prefix"), "rows"),
            "mix-cuts",
        )
        small = (F.col("rows") <= leaf_rows) | F.lit(digits + LEVEL_DIGITS > 30)
        leaves = cut.filter(small) if leaves is None else leaves.unionByName(cut.filter(small))
        cuts = cut.filter(~small)
        if cuts.isEmpty():
            break
    leaf = narrow.alias("d").join(leaves.alias("c"), _in_cut()).select("d.*", "c.need")
    order = Window.partitionBy("source").orderBy("_h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    # The last one taken brings the sum nearest to the need, from below or above.
    taken = (
        leaf.withColumn("sum", F.sum("size").over(order))
        .filter(2 * F.col("sum") - F.col("size") <= 2 * F.col("need"))
        .groupBy("source").agg(F.max(F.struct("_h", "doc_id", "size")).alias("last"))
    )
    return leaves.alias("c").join(taken.alias("t"), _same_source("c", "t"), "left").select(
        "c.source", "c.prefix", "t.last"
    )


def repetitions(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``sizes`` (doc_id, source, size, more) with source_size, target and times.

    Reruns give the same rows. Documents of one source, id and size share a place in the order.
    A null source is a source of its own; a null id counts as an empty one. Columns with the
    names of the new ones are replaced.
    """
    key = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    narrow = written(
        sizes.select("source", "doc_id", "size", F.md5(key).alias("_h")), "mix-sizes"
    )
    targets = written(source_targets(narrow, weights, max_epochs), "mix-targets")
    limits = last_taken(narrow, targets, leaf_rows)
    known = targets.alias("s").join(limits.alias("l"), _same_source("s", "l"), "left").select(
        "s.source", "s.source_size", "s.target", "s.whole", "s.need", "l.prefix", "l.last"
    )
    # One row per source: once it is written, its size decides how the documents meet it.
    known = written(known, "mix-known")
    own = F.struct(F.md5(key).alias("_h"), F.col("d.doc_id"), F.col("d.size"))
    in_leaf = F.md5(key).startswith(F.col("t.prefix"))
    once_more = (
        F.when(F.col("t.prefix").isNull(), F.col("t.need") > 0)
        .when(in_leaf, F.coalesce(own <= F.col("t.last"), F.lit(False)))
        .otherwise(F.md5(key) < F.col("t.prefix"))
    )
    new = {"source_size", "target", "times"}
    kept = [F.col(f"d.`{c}`") for c in sizes.columns if c not in new]
    return sizes.alias("d").join(known.alias("t"), _same_source("d", "t")).select(
        *kept, "t.source_size", "t.target",
        (F.col("t.whole") + once_more.cast("bigint")).alias("times"),
    )


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """Documents with each row as often as the mix takes it; the columns stay as they are."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    sized = docs.select(
        F.struct(*own).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")
    )
    counted = repetitions(sized, **parameters)
    return (
        counted.filter(F.col("times") > 0)
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("n"))
        .select("row.*")
    )
