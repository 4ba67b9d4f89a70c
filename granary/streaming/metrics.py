"""Events to metrics: each micro-batch recomputes the keys it touches, out of a table of days that the ledger's stream keeps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.timing import at, days_before
from granary.operators.events import parse_events, split_malformed
from granary.operators.series import daily_sales, high_risk_alerts, metrics_from_days
from granary.schemas import KEY
from granary.streaming.tables import BATCH, Tiers, newest, read_table, run_available, write_batch

_DAY = [*KEY, "date"]
#: Before any movement: the days of a batch are kept however old they are.
_ALWAYS = datetime(1, 1, 1)


def enrich(touched: DataFrame, history: DataFrame) -> DataFrame:
    """Events with the history columns of their key; a key without history gets NULLs.

    `history` holds one row per key, so a key with many events is not multiplied; adaptive execution splits the join on
    a key that has a large share of the events.
    """
    return touched.join(history, KEY, "left")


def run_enriched(events: DataFrame, history: DataFrame, path: str, *, checkpoint: str) -> DataFrame:
    """A stream of events joined with a table. Each micro-batch is a batch join, which a join inside the stream's own plan is
    not: there a hot key would be one task."""
    spark = events.sparkSession
    like = enrich(spark.createDataFrame([], events.schema), history)
    run_available(events, lambda df, n: write_batch(enrich(df, history), n, path), checkpoint=checkpoint)
    return read_table(spark, path, spark.createDataFrame([], like.schema)).drop(BATCH)


def _added_days(days: DataFrame) -> DataFrame:
    return days.groupBy(*_DAY).agg(
        F.sum("daily_sales").alias("daily_sales"), F.sum("transaction_count").alias("transaction_count")
    )


def days_table(ledger: DataFrame, path: str) -> Tiers:
    """Units sold and movements per key and day, as micro-batches of the ledger add to them."""
    spark = ledger.sparkSession
    return Tiers(spark, path, daily_sales(spark.createDataFrame([], ledger.schema), as_of=_ALWAYS, days=0).schema, _added_days)


def run_days(ledger: DataFrame, path: str, *, checkpoint: str) -> Tiers:
    """Keep the table of days up to date with a stream of movements: each is read once."""
    table = days_table(ledger, path)
    run_available(ledger, lambda df, n: table.commit(daily_sales(df, as_of=_ALWAYS, days=0), n), checkpoint=checkpoint)
    return table


def run_metrics(
    raw: DataFrame,
    sold: Tiers,
    *,
    as_of: datetime,
    path: str,
    checkpoint: str,
    days: int = 90,
) -> Tiers:
    """Raw JSON events to metrics, alerts and a quarantine of malformed rows, in folders under `path`.

    `sold` is the table of days; the ledger itself is not read. A batch is parsed once. The result has the newest
    metrics of each key.
    """
    spark = raw.sparkSession
    parsed_like = parse_events(spark.createDataFrame([], raw.schema), received_at=as_of)
    since = F.col("date") >= F.to_date(days_before(as_of, days))

    def metrics_of(events: DataFrame) -> DataFrame:
        return metrics_from_days(events, sold.read().filter(since)).withColumn("processed_at", at(as_of))

    like = metrics_of(split_malformed(parsed_like)[0])
    table = Tiers(spark, f"{path}/newest", like.schema.add(BATCH, "long"), newest(KEY))

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(parse_events(batch, received_at=as_of), batch_id, f"{path}/parsed")
        parsed = spark.read.schema(parsed_like.schema).parquet(f"{path}/parsed/{BATCH}={batch_id}")
        events, bad = split_malformed(parsed)
        write_batch(bad.select("value"), batch_id, f"{path}/quarantine")
        write_batch(metrics_of(events), batch_id, f"{path}/metrics")
        # read back what was written: the rest then agrees with it and nothing is computed twice
        written = spark.read.schema(like.schema).parquet(f"{path}/metrics/{BATCH}={batch_id}")
        write_batch(high_risk_alerts(written), batch_id, f"{path}/alerts")
        table.commit(written.withColumn(BATCH, F.lit(batch_id).cast("bigint")), batch_id)

    run_available(raw, each, checkpoint=checkpoint)
    return table
