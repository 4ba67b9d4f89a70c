"""Stock commands on a stream: the levels of a key are its state."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.commands import JUDGED, judge
from granary.schemas import KEY
from granary.streaming.ordered import DELAY, Waiting
from granary.streaming.tables import BATCH, Tiers, newest, read_table, write_batch

_LEVELS = ["quantity_on_hand", "quantity_reserved"]


def run_judge(
    items: DataFrame, commands: DataFrame, path: str, *, checkpoint: str, delay: timedelta = DELAY, ended: bool = True
) -> DataFrame:
    """Streaming twin of `operators.commands.judge`: the same rows as for all commands at once, but for those that come later
    than the delay allows and are quarantined under `path`.

    Commands are taken in the order of (timestamp, id) once they are ready. A key's levels are those of `items` until its
    first command, and from then on those after its last one.
    """
    asked = commands.select("id", *KEY, "op", "quantity", "timestamp")
    spark = asked.sparkSession
    levels = items.select(*KEY, *_LEVELS, "quantity_in_transit").schema.add(BATCH, "long")
    state = Tiers(spark, f"{path}/levels", levels, newest(KEY))
    waiting = Waiting(asked, f"{path}/rows", delay=delay)
    out = f"{path}/judged"
    like = spark.createDataFrame([], JUDGED)

    def step(ready: DataFrame, done, batch_id: int) -> None:
        now = state.read(before=batch_id).select(*KEY, F.struct(*_LEVELS).alias("_now"))
        touched = items.select(*KEY, *_LEVELS, "quantity_in_transit").join(ready.select(*KEY).distinct(), KEY, "left_semi")
        current = touched.join(now, KEY, "left").withColumns({c: F.coalesce(f"_now.{c}", c) for c in _LEVELS}).drop("_now")
        write_batch(judge(current, ready), batch_id, out)
        # read back what was written: the state then agrees with it and nothing is judged twice
        judged = spark.read.schema(like.schema).parquet(f"{out}/{BATCH}={batch_id}").filter("on_hand_after is not null")
        last = judged.groupBy(*KEY).agg(F.max_by(F.struct("on_hand_after", "reserved_after"), F.struct("timestamp", "id")).alias("_last"))
        state.commit(last.select(
            *KEY, F.col("_last.on_hand_after").cast("int").alias("quantity_on_hand"),
            F.col("_last.reserved_after").cast("int").alias("quantity_reserved"),
            F.lit(None).cast("int").alias("quantity_in_transit"), F.lit(batch_id).cast("bigint").alias(BATCH),
        ), batch_id)

    waiting.run(asked, step, checkpoint=checkpoint, ended=ended)
    return read_table(spark, out, like).drop(BATCH)
