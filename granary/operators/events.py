"""Inventory events: reading JSON, routing, totals, and the messages sent onward.

All of these are plain column expressions or aggregates, so they serve batches and streams.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.timing import at, hour_dow_weekend, utc_wall_clock
from granary.schemas import EVENT_JSON, KEY


def parse_events(raw: DataFrame, *, value: str = "value", received_at: datetime) -> DataFrame:
    """JSON text to event columns, every missing field replaced by its default.

    `malformed` is true for text that is no JSON object or holds an unreadable timestamp;
    `split_malformed` sends those rows to quarantine.
    """
    parsed = raw.withColumn("_j", F.from_json(F.col(value), EVENT_JSON)).withColumn(
        "_ts_text", F.col("_j.timestamp")
    )
    ts = utc_wall_clock("_ts_text")
    # from_json gives a struct of NULLs for text that is not an object
    is_object = F.col(value).rlike(r"(?s)^\s*\{.*\}\s*$") & F.get_json_object(value, "$").isNotNull()
    return parsed.select(
        *[c for c in raw.columns if c not in EVENT_OUTPUT],
        F.coalesce("_j.eventId", "_j.id", F.lit("")).alias("event_id"),
        F.coalesce("_j.sku", F.lit("")).alias("sku"),
        F.coalesce("_j.warehouse", "_j.warehouseId", F.lit("")).alias("warehouse_id"),
        F.coalesce("_j.quantityChange", "_j.quantity", F.lit(0)).alias("quantity_change"),
        F.coalesce("_j.eventType", F.lit("UNKNOWN")).alias("event_type"),
        F.when(F.col("_ts_text").isNull(), at(received_at)).otherwise(ts).alias("timestamp"),
        (
            ~F.coalesce(is_object, F.lit(False)) | (F.col("_ts_text").isNotNull() & ts.isNull())
        ).alias("malformed"),
    )


EVENT_OUTPUT = {
    "event_id", "sku", "warehouse_id", "quantity_change", "event_type", "timestamp", "malformed",
}


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable events, malformed rows)."""
    return parsed.filter(~F.col("malformed")).drop("malformed"), parsed.filter("malformed")


def with_time_features(events: DataFrame) -> DataFrame:
    return events.withColumns(hour_dow_weekend(F.col("timestamp")))


def event_json(events: DataFrame) -> Column:
    """The JSON a producer sends."""
    return F.to_json(F.struct(
        F.col("sku"),
        F.col("warehouse_id").alias("warehouse"),
        F.col("quantity_change").alias("quantityChange"),
        F.col("event_type").alias("eventType"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    ))


def as_messages(events: DataFrame) -> DataFrame:
    """Topic records: key sku_warehouse, value JSON."""
    return events.select(F.concat_ws("_", *KEY).alias("key"), event_json(events).alias("value"))


def with_index_name(events: DataFrame, *, indexed_at: Column | None = None) -> DataFrame:
    """The index each event belongs to; `indexed_at` is filled only where it is missing."""
    kind = F.lower("event_type")
    # Event type, index name. Producers and sinks spell the alert differently.
    name = (
        F.when(kind == "inventory_updated", "inventory-updates")
        .when(kind.isin("reserved", "released"), "inventory-reservations")
        .when(kind == "restocked", "inventory-restocks")
        .when(kind.isin("low_stock_alert", "low_stock"), "inventory-alerts")
        .otherwise("inventory-events")
    )
    out = events.withColumn("index_name", name)
    if indexed_at is None:
        return out
    present = F.col("indexed_at") if "indexed_at" in events.columns else F.lit(None).cast("timestamp_ntz")
    return out.withColumn("indexed_at", F.coalesce(present, indexed_at))


def stock_alerts(events: DataFrame) -> DataFrame:
    """LOW_STOCK and OUT_OF_STOCK events as alert rows."""
    return events.filter(F.col("event_type").isin("LOW_STOCK", "OUT_OF_STOCK")).select(
        *KEY, "event_type", "timestamp",
        F.concat(
            F.lit("ALERT: "), F.col("event_type"), F.lit(" - SKU: "), F.col("sku"),
            F.lit(", Warehouse: "), F.col("warehouse_id"),
        ).alias("alert"),
    )


def event_totals(events: DataFrame) -> DataFrame:
    """Number of events and total quantity moved per key."""
    return events.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.abs("quantity_change").cast("bigint")).alias("quantity_changed"),
    )


def grand_totals(totals: DataFrame) -> DataFrame:
    return totals.agg(
        F.sum("event_count").alias("total_events"),
        F.sum("quantity_changed").alias("total_quantity_changed"),
    )
