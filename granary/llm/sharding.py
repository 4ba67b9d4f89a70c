"""Shards that each hold the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.store import written


def _placed(df: DataFrame, whole: list[str], block: str, order: list[str], counts: DataFrame, to: str) -> DataFrame:
    """Number the rows of each `whole` from 0 by block and then by `order`: the rows of the blocks before
    come from `counts` (one row `n` per block), so no task sorts more than a block."""
    before = Window.partitionBy(*whole).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("at:before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*whole, block).orderBy(*order))
    return df.join(starts, [*whole, block]).withColumn(to, F.col("at:before") + within - 1).drop("at:before")


def interleave(
    df: DataFrame, *, shards: int, stratum: str = "source", key: str = "doc_id", ties: tuple[str, ...] = (), seed: int = 17
) -> DataFrame:
    """Add `shard` (int) and `slot` (long, gapless from 0 in each shard).

    The rows of a stratum, in a seeded random order, are spread evenly over [0, 1); all rows are sorted by
    that fraction and cut into shards whose counts differ by one at most. A stratum's rows in a shard are off
    from its share of the whole by less than two, and by its share of the number of strata.

    The order within a stratum is that of a hash of seed, key and `ties`, then of these; rows equal in all of
    these are interchangeable. A null key counts like any other, null strata are one stratum, an empty table
    gives an empty table. Strata and the whole are ranked in about sqrt(rows) blocks, so that a stratum that
    holds most rows takes as many tasks as its rows need. Every column of `df` is shuffled: pass narrow rows.
    """
    rows = max(1, df.count())
    bits = max(1, math.ceil(math.log2(rows) / 2))
    drawn = df.withColumns({
        "at:stratum": F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")),
        "at:draw": F.xxhash64(F.lit(seed), F.col(key), *map(F.col, ties)),
    }).withColumn("at:block", F.shiftrightunsigned("at:draw", 64 - bits))
    blocks = (
        drawn.groupBy("at:stratum", "at:block").agg(F.count("*").alias("n"))
        .withColumn("at:size", F.sum("n").over(Window.partitionBy("at:stratum")))
    )
    order = ["at:draw", key, *ties]
    ranked = _placed(drawn, ["at:stratum"], "at:block", order, blocks, "at:rank")
    spread = written(
        ranked.withColumn("at:fraction", (2 * F.col("at:rank") + 1) / (2 * F.col("at:size")))
        .withColumn("at:range", F.floor(F.col("at:fraction") * F.lit(1 << bits)))
        .drop("at:block", "at:rank", "at:size"),
        "interleaved",
    )
    ranges = spread.groupBy("at:range").agg(F.count("*").alias("n"))
    placed = _placed(spread, [], "at:range", ["at:fraction", "at:stratum", *order], ranges, "at:place")
    return (
        placed.withColumn("shard", F.expr(f"cast((`at:place` * {shards}) div {rows} as int)"))
        .withColumn("slot", F.expr(f"`at:place` - (shard * {rows}L + {shards - 1}) div {shards}"))
        .drop("at:stratum", "at:draw", "at:fraction", "at:range", "at:place")
    )
