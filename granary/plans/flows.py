"""Sources and sinks: what is written is read back and must be what went in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from granary import schemas
from granary.operators import events as ev
from granary.operators import series
from granary.plans.aggregates import DEMAND
from granary.plans.joins import SNAPSHOT, daily_rows
from granary.plans.registry import query
from granary.plans.series import METRICS, metrics
from granary.plans.views import EVENTS_AS_OF, Tables
from granary.schemas import KEY
from granary.session import fresh_dir
from granary.sources import sinks, streams, tables
from granary.streaming.tables import to_table

_EVENT = "event_id, sku, warehouse_id, quantity_change, event_type, CAST(timestamp AS VARCHAR) AS timestamp"


@query("src_parquet", """
SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, round(value, 6) AS value FROM events""")
def _(t: Tables):
    df = tables.read_parquet(t.spark, f"{t.folder}/events.parquet", t.event_schema)
    return df.select("event_id", "ts", "user_id", "event_type", "value")


@query("src_mongo_docs", DEMAND.format(table="tx"), views="tx")
def _(t: Tables):
    path = fresh_dir(t.spark, "documents")
    tables.as_documents(t.tx).write.option("timestampNTZFormat", sinks.JSON_TIME).json(path)
    return series.daily_net_demand(tables.read_ledger_documents(t.spark, path))


@query("src_kafka_events", f"SELECT {_EVENT} FROM (SELECT * REPLACE ('' AS event_id) FROM stock_events)",
       views="stock_events")
def _(t: Tables):
    """The topic's JSON out of files; the records carry no event id."""
    path, out = fresh_dir(t.spark, "topic"), fresh_dir(t.spark, "topic-read")
    ev.as_messages(t.stock_events).select("value").write.text(path)
    stream = ev.parse_events(streams.read_json_lines(t.spark, path), received_at=EVENTS_AS_OF)
    table = to_table(stream, out, checkpoint=f"{out}-checkpoint")
    return table.filter(~F.col("malformed")).select(schemas.EVENTS.fieldNames())


query("publish_event", """
SELECT sku || '_' || warehouse_id AS key,
       '{"sku":"' || sku || '","warehouse":"' || warehouse_id || '","quantityChange":' || quantity_change
       || ',"eventType":"' || event_type || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '"}' AS value
FROM stock_events""", views="stock_events")(lambda t: ev.as_messages(t.stock_events))

_METRICS = """SELECT sku, warehouse_id, round(velocity_7d, 6) AS velocity_7d, round(velocity_30d, 6) AS velocity_30d,
       round(volatility, 6) AS volatility, round(trend, 6) + 0.0 AS trend,
       round(seasonality_index, 6) AS seasonality_index, stockout_risk, reorder_recommendation,
       '2024-01-31 06:30:00' AS processed_at"""
RUN = datetime(2024, 1, 31, 6, 30)


@query("sink_parquet_archive", f"""
{_METRICS}, '2024-01-31' AS processed_date, '20240131_063000' AS run FROM ({METRICS})""", views="tx_dense")
def _(t: Tables):
    path = fresh_dir(t.spark, "archive")
    rows = metrics(t)
    sinks.archive_metrics(rows, path, processed_at=RUN)
    stored = rows.schema.add("processed_at", "timestamp_ntz").add("processed_date", "string").add("run", "string")
    return t.spark.read.schema(stored).parquet(path)


@query("sink_append_table", f"{_METRICS} FROM ({METRICS})", views="tx_dense")
def _(t: Tables):
    path = fresh_dir(t.spark, "metrics")
    rows = metrics(t)
    for _ in range(2):  # a repeated run leaves the same table
        sinks.append_metrics(rows, path, processed_at=RUN)
    return t.spark.read.schema(rows.schema.add("processed_at", "timestamp_ntz")).parquet(path).drop("run")


@query("sink_upsert_snapshot", f"""
SELECT '2024-01-31' AS snapshot_date, sku, warehouse_id, quantity_on_hand, quantity_reserved,
       quantity_on_hand - quantity_reserved AS available_quantity,
       CASE WHEN quantity_on_hand % 2 = 0 THEN -1 ELSE reorder_point END AS reorder_point,
       status AS inventory_status, round(inventory_value, 6) AS inventory_value,
       CAST(CAST(daily_velocity AS DECIMAL(10,2)) AS DOUBLE) AS daily_velocity, action_required
FROM ({SNAPSHOT})
UNION ALL
SELECT '2024-01-30', sku, warehouse_id, quantity_on_hand, quantity_reserved,
       quantity_on_hand - quantity_reserved, reorder_point, status, round(inventory_value, 6),
       CAST(CAST(daily_velocity AS DECIMAL(10,2)) AS DOUBLE), action_required
FROM ({SNAPSHOT})""", views="ordered_items tx")
def _(t: Tables):
    """Two days are stored; then part of the second day, with other values, meets the full day."""
    path = fresh_dir(t.spark, "snapshots")
    rows = daily_rows(t)
    names = rows.columns
    yesterday = rows.withColumn("snapshot_date", F.date_sub("snapshot_date", 1))
    early = rows.filter(F.col("quantity_on_hand") % 2 == 0).withColumns({
        "quantity_on_hand": F.lit(1), "reorder_point": F.lit(-1), "action_required": F.lit("OLD"),
    })
    sinks.write_partitions(yesterday.unionByName(early).select(names), path, ["snapshot_date"])
    sinks.upsert_partitions(
        t.spark, path, rows, schema=rows.schema, keys=["snapshot_date", *KEY], by="snapshot_date",
        update=[c for c in names if c not in ("snapshot_date", *KEY, "reorder_point")],
    )
    return t.spark.read.schema(rows.schema).parquet(path).select(names)


@query("sink_alert_topic", f"""
SELECT '{{"type":"HIGH_STOCKOUT_RISK","sku":"' || sku || '","warehouse_id":"' || warehouse_id || '","risk_score":'
       || stockout_risk || ',"recommended_reorder":' || reorder_recommendation
       || ',"timestamp":"2024-01-31T06:30:00"}}' AS value
FROM ({METRICS}) WHERE stockout_risk > 0.3""", views="tx_dense")
def _(t: Tables):
    path = fresh_dir(t.spark, "alerts")
    alerts = series.high_risk_alerts(metrics(t), above=0.3).drop("velocity_30d", "volatility")
    for _ in range(2):
        sinks.write_alerts(alerts, path, at_time=RUN)
    return t.spark.read.text(path).select("value")


@query("sink_routed_index", f"""
SELECT {_EVENT}, CASE event_type WHEN 'INVENTORY_UPDATED' THEN 'inventory-updates'
       WHEN 'RESERVED' THEN 'inventory-reservations' WHEN 'RELEASED' THEN 'inventory-reservations'
       WHEN 'RESTOCKED' THEN 'inventory-restocks' WHEN 'LOW_STOCK' THEN 'inventory-alerts'
       WHEN 'LOW_STOCK_ALERT' THEN 'inventory-alerts' ELSE 'inventory-events' END AS index_name
FROM stock_events""", views="stock_events")
def _(t: Tables):
    path = fresh_dir(t.spark, "routed")
    for _ in range(2):
        sinks.write_routed(t.stock_events, path, batch="20240131")
    stored = t.stock_events.schema.add("index_name", "string")
    return t.spark.read.schema(stored).json(path).select(stored.fieldNames())


