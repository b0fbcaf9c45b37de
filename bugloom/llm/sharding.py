"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of every block of the input go to every shard follows one law: the matrix of counts
of a uniform permutation, a multivariate hypergeometric draw per block from what the shards still
take. With the counts drawn, a block deals its rows by a permutation of as many labels of each
shard; the rows are exchanged; and each shard permutes what it got. The shards' sizes are exact,
at most one apart, and every arrangement is equally likely, up to the generators.

Rows are staged once with their block and place, so that all later steps, repeated after a lost
executor, see the same blocks. The matrix is drawn in two levels: the counts of at most
``GROUPS`` groups of blocks on the driver, those of a group's blocks in a task.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugloom.llm.common import ranked, shuffle_partitions, sized_broadcast, written

LAW = "rows"
SHARDS = 8
SEED = 20
GROUPS = 1024
BLOCK_ROWS = 65_536
# Half width of a draw's window, in standard deviations: what lies outside is below 1e-30.
TAILS = 12


def shard_sizes(n: int, shards: int) -> list[int]:
    """Sizes at most one apart; the first shards take the remainder."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good: inversion over the window that holds all the mass.

    Any population size will do; probabilities come from their ratios, in double precision.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    share = good / total
    spread = (drawn * share * (1 - share) * (total - drawn) / max(1, total - 1)) ** 0.5
    middle = min(max(int(drawn * share), low), high)
    low = max(low, middle - int(TAILS * spread) - TAILS)
    high = min(high, middle + int(TAILS * spread) + TAILS)
    k = np.arange(low, high, dtype=float)
    ratios = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def deal(rng: np.random.Generator, capacities: list[int], rows: int) -> list[int]:
    """How many of ``rows`` go to each shard: one row of the matrix, a draw per shard."""
    out, rest = [], sum(capacities)
    for capacity in capacities:
        rest -= capacity
        took = hypergeometric(rng, capacity, rest, rows)
        out.append(took)
        rows -= took
    return out


def matrix(rng: np.random.Generator, capacities: list[int], sizes: list[int]) -> list[list[int]]:
    """Counts from blocks of the given sizes to shards; columns sum up to the capacities."""
    left, out = list(capacities), []
    for rows in sizes:
        out.append(deal(rng, left, rows))
        left = [a - b for a, b in zip(left, out[-1])]
    return out


def _staged(df: DataFrame) -> DataFrame:
    """The rows as one struct ``_row`` with their block and place in it, written."""
    number = F.monotonically_increasing_id()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                     number.alias("_number"))
    staged = written(rows, "shard-input")
    # The number is the partition's (from bit 33) and the row's in it.
    block = F.shiftright("_number", 33) * (1 << 20) + F.shiftright(
        F.col("_number").bitwiseAND((1 << 33) - 1), BLOCK_ROWS.bit_length() - 1
    )
    return staged.withColumns({
        "_block": block,
        "_place": F.col("_number").bitwiseAND(BLOCK_ROWS - 1).cast("int"),
    })


def communication(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """``_block, counts``: how many rows of a block go to each shard.

    ``blocks`` are ``_block, n``, one row each. Groups of blocks are dealt first, from their
    totals (at most ``GROUPS`` rows), and then each group's blocks in one task of their own.
    """
    grouped = blocks.withColumn("_group", F.pmod(F.xxhash64("_block"), F.lit(GROUPS)).cast("int"))
    totals = grouped.groupBy("_group").agg(F.sum("n").alias("n")).orderBy("_group").collect()
    capacities = shard_sizes(sum(r["n"] for r in totals), shards)
    dealt = matrix(np.random.default_rng([seed, 0]), capacities, [r["n"] for r in totals])
    told = {r["_group"]: counts for r, counts in zip(totals, dealt)}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        group = table.column("_group")[0].as_py()
        rng = np.random.default_rng([seed, 1, group])
        counts = matrix(rng, told[group], table.column("n").to_pylist())
        return pa.table({
            "_block": table.column("_block"), "counts": pa.array(counts, pa.list_(pa.int64())),
        })

    return grouped.groupBy("_group").applyInArrow(run, "_block bigint, counts array<bigint>")


def _shard(seed: int) -> Column:
    """A row's shard: its place's label in the block's permuted labels."""

    @F.pandas_udf(T.IntegerType())
    def label(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, labels = None, np.zeros(0, np.int32)
        for block, place, counts in batches:
            out = np.empty(len(block), np.int32)
            ids, places = block.to_numpy(), place.to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if a == b:
                    continue
                if ids[a] != known:
                    known, own = ids[a], counts.iloc[a]
                    rng = np.random.default_rng([seed, 2, int(known)])
                    labels = rng.permutation(np.repeat(np.arange(len(own), dtype=np.int32), own))
                out[a:b] = labels[places[a:b]]
            yield pd.Series(out)

    return label("_block", "_place", "counts")


def sharded(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows and columns, with ``shard`` and ``slot``, from 0 without gaps in each shard.

    Shards' sizes are at most one apart; which rows go where, and in which order, is a uniform
    draw by ``seed`` (and by how the input is split, as its blocks are). Values don't matter: null
    ids, equal and repeated rows are rows like others. Columns named shard or slot are replaced.
    A shard's rows lie in parts that are small enough for a task, each part a range of random
    numbers, so no shard is one task's work.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    kept = df.drop("shard", "slot")
    rows = _staged(kept)
    blocks = written(rows.groupBy("_block").agg(F.count("*").alias("n")), "shard-blocks")
    counts = written(communication(blocks, shards, seed), "shard-matrix")
    labelled = rows.join(sized_broadcast(counts), "_block").withColumn("shard", _shard(seed))
    # The second permutation: rows of a shard in the order of a random number of their own.
    order = F.struct(F.xxhash64(F.lit(seed), "_number"), "_number").alias("_order")
    placed = ranked(
        labelled.select("_row", "shard", order), "shard", "_order",
        max(1, 2 * shuffle_partitions(df.sparkSession) // shards),
    )
    return placed.select("_row.*", "shard", F.col("rank").cast("bigint").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The shards as Parquet, a folder each, slots ascending in every file; returns the table."""
    rows = sharded(df, shards, seed)
    staged = written(rows, "sharded")
    staged.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def digest_columns(rows: DataFrame) -> DataFrame:
    """What tells a sharded document: its size, its text's checksum, its shard and slot."""
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
