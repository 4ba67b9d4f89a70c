"""Event-time windows over inventory events, with a watermark on lateness.

Rows later than the watermark are dropped by the stream, which counts them (`run_available`); in append mode a window is emitted
once, after the watermark has passed its end, in update mode each time it changes.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.timing import as_instant, as_wall_clock
from granary.schemas import KEY
from granary.streaming.ordered import DELAY, Waiting
from granary.streaming.tables import BATCH, Tiers, newest, read_table, write_batch

WATERMARK = "10 minutes"


_TIME = "_event_time"


def _windowed(
    events: DataFrame, size: str, slide: str | None, watermark: str, ts: str
) -> tuple[DataFrame, Column]:
    marked = events.withColumn(_TIME, as_instant(ts)).withWatermark(_TIME, watermark)
    return marked, F.window(_TIME, size, slide) if slide else F.window(_TIME, size)


def _bounds(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        as_wall_clock("window.start").alias("window_start"),
        as_wall_clock("window.end").alias("window_end"),
        *rest,
    )


def window_sum(
    events: DataFrame, *, size: str, watermark: str = WATERMARK, ts: str = "timestamp"
) -> DataFrame:
    """Net quantity change per key and tumbling window."""
    marked, window = _windowed(events, size, None, watermark, ts)
    return _bounds(
        marked.groupBy(window, *KEY).agg(
            F.sum(F.col("quantity_change").cast("bigint")).alias("quantity_change")
        )
    )


def window_velocity(
    events: DataFrame, *, minutes: int, watermark: str = WATERMARK, ts: str = "timestamp"
) -> DataFrame:
    """Net quantity per minute over tumbling windows of so many minutes."""
    sums = window_sum(events, size=f"{minutes} minutes", watermark=watermark, ts=ts)
    return sums.select(
        "window_start", "window_end", *KEY,
        (F.col("quantity_change") / F.lit(float(minutes))).alias("velocity"),
        F.lit(minutes).alias("period"),
    )


def request_rate(
    requests: DataFrame,
    *,
    by: list[str],
    size_minutes: int = 5,
    slide_minutes: int = 1,
    watermark: str = WATERMARK,
    ts: str = "ts",
) -> DataFrame:
    """Requests per second over sliding windows."""
    marked, window = _windowed(
        requests, f"{size_minutes} minutes", f"{slide_minutes} minutes", watermark, ts
    )
    counted = marked.groupBy(window, *by).agg(F.count(F.lit(1)).alias("requests"))
    return _bounds(counted).withColumn("rate", F.col("requests") / F.lit(size_minutes * 60.0))


def error_rate_alerts(rates: DataFrame, *, above: float = 0.1) -> DataFrame:
    """Windows whose rate of failed requests is too high."""
    return rates.filter(F.col("rate") > above).withColumn("severity", F.lit("critical"))


def minute_levels(
    levels: DataFrame, *, by: list[str], value: str, watermark: str = WATERMARK, ts: str = "timestamp"
) -> DataFrame:
    """Highest value of each key in each minute: the part of the low-stock rule that streams."""
    marked, window = _windowed(levels, "1 minute", None, watermark, ts)
    return _bounds(marked.groupBy(window, *by).agg(F.max(value).alias("highest")))


def low_runs(minutes: DataFrame, *, by: list[str], below: float) -> DataFrame:
    """Runs of minutes in which a key's highest value stays below the threshold: (key, low_since, until, highest, open).

    Works on the one row per key and reported minute of `minute_levels`, so a key has at most
    as many rows as its history has minutes. A minute without a report keeps the last level,
    as a gauge does: a low run lasts until the next minute that is not low, and the last one,
    which is still `open`, until the end of its last minute.
    """
    along = W.partitionBy(*by).orderBy("window_start")
    low = F.col("highest") < below
    starts = low & ~F.coalesce(F.lag(low).over(along), F.lit(False))
    runs = minutes.withColumns({
        "_low": low,
        "_starts": F.when(starts, 1).otherwise(0),
        "_next": F.lead("window_start").over(along),
    }).withColumn("_run", F.sum("_starts").over(along)).filter("_low")
    return runs.groupBy(*by, "_run").agg(
        F.min("window_start").alias("low_since"),
        F.max(F.coalesce("_next", "window_end")).alias("until"),
        F.max("highest").alias("highest"),
        F.bool_or(F.col("_next").isNull()).alias("open"),
    ).drop("_run")


def lasting(runs: DataFrame, *, by: list[str], for_minutes: int) -> DataFrame:
    """Alerts for the runs that lasted so many minutes."""
    lasted = F.col("until") - F.col("low_since") >= F.make_dt_interval(mins=F.lit(for_minutes))
    return runs.filter(lasted).select(*by, "low_since", "until", "highest", F.lit("warning").alias("severity"))


def sustained_low(
    minutes: DataFrame, *, by: list[str], below: float = 10, for_minutes: int = 5
) -> DataFrame:
    """Runs in which a key's highest value stays below the threshold for so many minutes."""
    return lasting(low_runs(minutes, by=by, below=below), by=by, for_minutes=for_minutes)


def run_sustained_low(
    levels: DataFrame, path: str, *, by: list[str], value: str, checkpoint: str, below: float = 10, for_minutes: int = 5,
    delay: timedelta = DELAY, ts: str = "timestamp", ended: bool = True,
) -> DataFrame:
    """The rule on a stream: each run once, when a minute that is not low, or the end of the stream, has closed it.

    Whole minutes are judged as the watermark passes them. The open run of each key is its state: it stands for
    the minutes that made it and goes on in the next part of the history.
    """
    spark = levels.sparkSession
    rows = levels.select(*by, value, ts)
    waiting = Waiting(rows, f"{path}/rows", time=ts, delay=delay, whole=timedelta(minutes=1))
    runs_like = low_runs(minute_levels(spark.createDataFrame([], rows.schema), by=by, value=value, ts=ts), by=by, below=below)
    state = Tiers(spark, f"{path}/open", runs_like.schema.add(BATCH, "long"), newest(by))
    closed_path = f"{path}/closed"

    def step(ready: DataFrame, done, batch_id: int) -> None:
        minutes = minute_levels(ready, by=by, value=value, ts=ts)
        # an open run comes first, as one long minute
        before = state.read(before=batch_id).filter("open").join(minutes.select(*by).distinct(), by, "left_semi")
        known = before.select(F.col("low_since").alias("window_start"), F.col("until").alias("window_end"), *by, "highest")
        runs = low_runs(known.unionByName(minutes), by=by, below=below)
        write_batch(runs, batch_id, f"{path}/runs")
        written = spark.read.schema(runs_like.schema).parquet(f"{path}/runs/{BATCH}={batch_id}")
        write_batch(written.filter("not open"), batch_id, closed_path)
        touched = minutes.select(*by).distinct().join(written.filter("open"), by, "left")
        state.commit(touched.withColumns({
            "open": F.coalesce("open", F.lit(False)), BATCH: F.lit(batch_id).cast("bigint"),
        }), batch_id)

    waiting.run(rows, step, checkpoint=checkpoint, ended=ended)
    closed = read_table(spark, closed_path, spark.createDataFrame([], runs_like.schema)).drop(BATCH)
    if ended:
        closed = closed.unionByName(state.read().filter("open").drop(BATCH))
    return lasting(closed, by=by, for_minutes=for_minutes)
