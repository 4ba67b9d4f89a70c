"""Keyed state kept by a stream: totals, last values, reserved counters, low-stock keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.events import event_totals, stock_alerts, with_index_name
from granary.schemas import KEY
from granary.sources.sinks import JSON_TIME
from granary.streaming.tables import BATCH, Tiers, run_available, to_table


def added_totals(totals: DataFrame) -> DataFrame:
    """Totals per key out of totals of parts."""
    return totals.groupBy(*KEY).agg(
        F.sum("event_count").alias("event_count"), F.sum("quantity_changed").alias("quantity_changed")
    )


def run_event_totals(events: DataFrame, path: str, *, checkpoint: str) -> DataFrame:
    """Running count and total per key; each micro-batch adds the totals of the keys it touches."""
    spark = events.sparkSession
    table = Tiers(spark, path, event_totals(spark.createDataFrame([], events.schema)).schema, added_totals)
    run_available(events, lambda df, n: table.commit(event_totals(df), n), checkpoint=checkpoint)
    return table.read()


def run_stock_alerts(events: DataFrame, path: str, *, checkpoint: str) -> DataFrame:
    return to_table(stock_alerts(events), path, checkpoint=checkpoint).drop(BATCH)


def run_routed(events: DataFrame, path: str, *, checkpoint: str) -> DataFrame:
    """Events into one folder per index and micro-batch."""

    def each(df: DataFrame, batch_id: int) -> None:
        (
            df.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("index_name", BATCH)
            .option("timestampNTZFormat", JSON_TIME)
            .json(path)
        )

    routed = with_index_name(events)
    run_available(routed, each, checkpoint=checkpoint)
    spark = events.sparkSession
    return spark.read.schema(routed.schema.add(BATCH, "long")).json(path).drop(BATCH)


def batch_state(events: DataFrame) -> DataFrame:
    """What one micro-batch contributes to the state of each key it touches."""
    kind, size = F.col("event_type"), F.abs("quantity_change").cast("bigint")
    updated = kind.isin("INVENTORY_UPDATED", "RESTOCKED")
    other = ~kind.isin(
        "INVENTORY_UPDATED", "RESTOCKED", "RESERVED", "RELEASED", "LOW_STOCK", "LOW_STOCK_ALERT"
    )
    value = F.struct("timestamp", "event_id", "quantity_change", "event_type")
    return events.groupBy(*KEY).agg(
        F.max(F.when(updated | other, value)).alias("last_event"),
        F.max(F.when(updated, value)).alias("last_update"),
        F.sum(F.when(kind == "RESERVED", size).when(kind == "RELEASED", -size)).alias("reserved"),
        F.count_if(kind.isin("LOW_STOCK", "LOW_STOCK_ALERT")).alias("low_stock_alerts"),
    )


def merged_state(contributions: DataFrame) -> DataFrame:
    """The contributions of many micro-batches as those of one."""
    return contributions.groupBy(*KEY).agg(
        F.max("last_event").alias("last_event"),
        F.max("last_update").alias("last_update"),
        F.sum("reserved").alias("reserved"),
        F.sum("low_stock_alerts").alias("low_stock_alerts"),
    )


def fold_state(contributions: DataFrame) -> DataFrame:
    """State per key out of the contributions of all micro-batches."""
    return merged_state(contributions).select(
        *KEY,
        F.col("last_event.event_type").alias("last_event_type"),
        F.col("last_event.timestamp").alias("last_event_at"),
        F.col("last_update.quantity_change").alias("last_quantity"),
        "reserved",
        (F.col("low_stock_alerts") > 0).alias("low_stock"),
    )


def run_event_state(events: DataFrame, path: str, *, checkpoint: str) -> DataFrame:
    """Last value, reserved counter and low-stock flag per key.

    Each micro-batch is reduced to one row per key it touches, and adds these to the table.
    """
    spark = events.sparkSession
    table = Tiers(spark, path, batch_state(spark.createDataFrame([], events.schema)).schema, merged_state)
    run_available(events, lambda df, n: table.commit(batch_state(df), n), checkpoint=checkpoint)
    return fold_state(table.read())
