"""Running totals, positions and replays along one key's history, safe for very large keys.

A window over (sku, warehouse) puts a whole key into one task. Here all rows are dealt once to ranges of (key, order) of
even size, so a long key, a burst of rows of one moment and rows without a time are cut into several slices like
anything else. The slices are totalled and summed up on a table with one row per (key, slice); each slice then
gets what came before it as one extra row ahead of its own, so a window over (key, slice) yields the running total of
the key. No task sees more than one slice of one key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.session import enable_checkpoints

SLICE = "_slice"
FOUND = "_found"
_OWN = "_own_row"


def cut(df: DataFrame, keys: list[str], order: list[str], *, slices: int | None = None) -> DataFrame:
    """The rows with the number of their range of (key, order), ascending, as `_slice`; nulls come first.

    There are as many ranges as the session has shuffle partitions, or `slices`; adaptive execution joins small ones. The
    limits come from a sample, so the rows are checkpointed: each reader must see the same ranges.
    """
    enable_checkpoints(df.sparkSession)
    number = [] if slices is None else [slices]
    return df.repartitionByRange(*number, *keys, *order).withColumn(SLICE, F.spark_partition_id()).checkpoint()


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column],
    *,
    start: DataFrame | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add each named running sum, from the start of the key up to and with the row.

    `order` must be unique within a key; `slices` is as for `cut`.

    `start` has the keys and, under the names of `totals`, the level each sum starts from.
    `_found` then tells whether the row's key is in it; without a level the sum starts at 0.
    """
    names = list(totals)
    place = [*keys, SLICE]
    sliced = cut(df.withColumns(totals), keys, order, slices=slices)

    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    ahead = sliced.groupBy(*place).agg(*[F.sum(n).alias(n) for n in names]).withColumns(
        {n: F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in names}
    )
    if start is not None:
        levels = start.select(*keys, F.struct(*names).alias("_level"))
        ahead = ahead.join(levels, keys, "left").withColumns({
            **{n: F.col(n) + F.coalesce(f"_level.{n}", F.lit(0)) for n in names},
            FOUND: F.col("_level").isNotNull().cast("int"),
        }).drop("_level")
        sliced = sliced.withColumn(FOUND, F.lit(0))
        names = [*names, FOUND]

    both = sliced.withColumn(_OWN, F.lit(True)).unionByName(
        ahead.withColumn(_OWN, F.lit(False)), allowMissingColumns=True
    )
    along = W.partitionBy(*place).orderBy(_OWN, *order).rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumns({n: F.sum(n).over(along) for n in names}).filter(_OWN).drop(_OWN, SLICE)
    return out if start is None else out.withColumn(FOUND, F.col(FOUND) > 0)


def with_position(
    df: DataFrame, keys: list[str], order: list[str], *, name: str = "_position", slices: int | None = None
) -> DataFrame:
    """1, 2, 3 … along each key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, slices=slices)


def with_trailing(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    *,
    rows: int,
    block: int = 50_000,
    slices: int | None = None,
) -> DataFrame:
    """Add _n, _s1 and _s2: count, sum and sum of squares of the last `rows` values.

    Blocks of `block` consecutive positions are windowed on their own; each block also gets
    the `rows - 1` rows before it, so every frame is whole. Sums are exact integers and
    each row costs the same however long the frame is.
    """
    if block < rows:
        raise ValueError("a block must hold at least one whole frame")
    position = F.col("_position")
    offset = F.pmod(position - 1, F.lit(block))
    home = F.floor((position - 1) / block)
    seen_by = F.when(offset >= block - rows + 1, F.array(home, home + 1)).otherwise(F.array(home))

    spread = (
        with_position(df.withColumn("_v", value.cast("bigint")), keys, order, slices=slices)
        .withColumns({"_home": home, "_block": F.explode(seen_by)})
    )
    along = W.partitionBy(*keys, "_block").orderBy("_position")
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    summed = spread.withColumns({
        "_c1": F.sum("_v").over(so_far),
        # squares of large integers would overflow a bigint once added up
        "_c2": F.sum((F.col("_v") * F.col("_v")).cast("decimal(19,0)")).over(so_far),
    }).withColumns({
        "_s1": F.col("_c1") - F.coalesce(F.lag("_c1", rows).over(along), F.lit(0)),
        "_s2": F.col("_c2") - F.coalesce(F.lag("_c2", rows).over(along), F.lit(0)),
        "_n": F.least(position, F.lit(rows).cast("bigint")),
    })
    return summed.filter(F.col("_block") == F.col("_home")).drop(
        "_v", "_home", "_block", "_c1", "_c2"
    )


def settle(slices: DataFrame, keys: list[str], state: list[str], fold: Callable[[Column, Column], Column]) -> DataFrame:
    """The state that each slice of a key starts from, for a history whose steps depend on the state before them.

    `slices` has a row per key and `_slice`: under the names of `state` the numbers that the key starts from, in `_guess` by how
    much the slice changes them if nothing unforeseen happens, and `_rows`, its steps in order. `fold` gives the state
    after the steps from the state before them. Slices are folded side by side from guessed states; the changes found are
    added up along the key and give new guesses, and slices whose guess is new are folded again. A key's first
    slice starts from a known state, so each round makes at least one more slice exact; when no guess changes
    all are, and rounds go on until then. The result has the state as struct `_at`. Each round is checkpointed.
    """
    enable_checkpoints(slices.sparkSession)
    place = [*keys, SLICE]
    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    at = F.struct(*[F.col(f"_next_{n}").alias(n) for n in state]).alias("_at")

    def guessed(known: DataFrame) -> DataFrame:
        return known.withColumns({
            f"_next_{n}": F.col(n) + F.coalesce(F.sum(f"_by_{n}").over(before), F.lit(0).cast("bigint")) for n in state
        }).checkpoint()

    known = guessed(slices.select(*place, *state, *[F.col(f"_guess.{n}").alias(f"_by_{n}") for n in state]))
    todo = known
    while True:
        ended = todo.select(*place, at).join(slices.select(*place, "_rows"), place).select(
            *place, "_at", fold(F.col("_rows"), F.col("_at")).alias("_end"))
        found = ended.select(*place, *[(F.col(f"_end.{n}") - F.col(f"_at.{n}")).alias(f"_found_{n}") for n in state])
        known = guessed(known.join(found, place, "left").select(
            *place, *state,
            *[F.coalesce(f"_found_{n}", f"_by_{n}").alias(f"_by_{n}") for n in state],
            *[F.col(f"_next_{n}").alias(f"_was_{n}") for n in state],
        ))
        todo = known.filter(_any([F.col(f"_next_{n}") != F.col(f"_was_{n}") for n in state]))
        if todo.isEmpty():
            return known.select(*place, at)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
