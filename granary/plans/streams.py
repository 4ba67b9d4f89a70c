"""Streams over the given tables, run to the end of their input and compared with batch SQL."""

from __future__ import annotations

from datetime import timedelta
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.timing import at
from granary.operators import anomaly, snapshot
from granary.operators import commands as cmd
from granary.plans.commands import REPLAY
from granary.plans.flows import _EVENT
from granary.plans.joins import SUMMARY
from granary.plans.registry import query
from granary.plans.series import ANOMALIES, METRICS, SCORED
from granary.plans.views import DENSE_AS_OF, EVENTS_AS_OF, VIEWS, Tables
from granary.schemas import KEY
from granary.session import fresh_dir, materialized
from granary.sources import streams as src
from granary.streaming import commands as stream_cmd
from granary.streaming import state, windows
from granary.streaming.anomaly import run_anomalies as run_detector
from granary.streaming.metrics import run_days, run_enriched, run_metrics
from granary.streaming.tables import BATCH, to_newest


def event_stream(t: Tables) -> DataFrame:
    """The given events table as a stream of files."""
    return src.read_table_files(t.spark, t.folder, t.event_schema, only="events.parquet")


def tx_stream(t: Tables) -> DataFrame:
    return t.spark.sql(VIEWS["tx"], events=event_stream(t))


def stock_event_stream(t: Tables) -> DataFrame:
    return t.spark.sql(VIEWS["stock_events"], tx=tx_stream(t))


def _updated(t: Tables, stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    path = fresh_dir(t.spark, label)
    return to_newest(stream, path, keys, checkpoint=f"{path}-checkpoint")


_WINDOW = ["window_start", "window_end", *KEY]
_HOUR = """
SELECT CAST(time_bucket(INTERVAL '1 hour', timestamp, TIMESTAMP '1970-01-01') AS VARCHAR) AS window_start,
       CAST(time_bucket(INTERVAL '1 hour', timestamp, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS VARCHAR) AS window_end,
       sku, warehouse_id, CAST(sum(quantity_change) AS BIGINT) AS quantity_change FROM tx GROUP BY ALL"""

query("stream_window_sum", _HOUR, views="tx")(
    lambda t: _updated(t, windows.window_sum(tx_stream(t), size="1 hour"), "window-sum", _WINDOW)
)
query("stream_velocity", f"""
SELECT window_start, window_end, sku, warehouse_id, round(quantity_change / 60.0, 6) AS velocity, 60 AS period
FROM ({_HOUR})""", views="tx")(
    lambda t: _updated(t, windows.window_velocity(tx_stream(t), minutes=60), "velocity", _WINDOW)
)


def run_anomalies(t: Tables, threshold: float = 3.0, critical: float = 5.0) -> DataFrame:
    path = fresh_dir(t.spark, "anomalies")
    return run_detector(tx_stream(t), path, checkpoint=f"{path}-checkpoint", threshold=threshold, critical=critical)


query("stream_anomaly", ANOMALIES.format(threshold=3, critical=5), views="tx")(run_anomalies)
query("stream_alerts", f"""
SELECT sku, warehouse_id, CAST(timestamp AS VARCHAR) AS timestamp,
       'ALERT: VOLUME_ANOMALY detected for SKU ' || sku || ' at ' || warehouse_id AS alert
FROM ({SCORED}) WHERE z > 2.5""", views="tx")(
    lambda t: anomaly.alert_messages(run_anomalies(t, threshold=2.0, critical=2.5))
)


@query("stream_event_totals", """
SELECT sku, warehouse_id, count(*) AS event_count, CAST(sum(abs(quantity_change)) AS BIGINT) AS quantity_changed
FROM stock_events GROUP BY sku, warehouse_id""", views="stock_events")
def _(t: Tables):
    path = fresh_dir(t.spark, "totals")
    return state.run_event_totals(stock_event_stream(t), path, checkpoint=f"{path}-checkpoint")


@query("stream_low_stock_alerts", """
SELECT sku, warehouse_id, event_type, CAST(timestamp AS VARCHAR) AS timestamp,
       'ALERT: ' || event_type || ' - SKU: ' || sku || ', Warehouse: ' || warehouse_id AS alert
FROM stock_events WHERE event_type IN ('LOW_STOCK', 'OUT_OF_STOCK')""", views="stock_events")
def _(t: Tables):
    path = fresh_dir(t.spark, "stock-alerts")
    return state.run_stock_alerts(stock_event_stream(t), path, checkpoint=f"{path}-checkpoint")


@query("stream_route", f"""
SELECT {_EVENT}, CASE event_type WHEN 'INVENTORY_UPDATED' THEN 'inventory-updates'
       WHEN 'RESERVED' THEN 'inventory-reservations' WHEN 'RELEASED' THEN 'inventory-reservations'
       WHEN 'RESTOCKED' THEN 'inventory-restocks' WHEN 'LOW_STOCK' THEN 'inventory-alerts'
       WHEN 'LOW_STOCK_ALERT' THEN 'inventory-alerts' ELSE 'inventory-events' END AS index_name
FROM stock_events""", views="stock_events")
def _(t: Tables):
    path = fresh_dir(t.spark, "stream-routed")
    return state.run_routed(stock_event_stream(t), path, checkpoint=f"{path}-checkpoint")


STATE = """
SELECT sku, warehouse_id,
       arg_max(event_type, (timestamp, event_id)) FILTER (WHERE event_type IN ('INVENTORY_UPDATED', 'RESTOCKED', 'OUT_OF_STOCK', 'ADJUSTED')) AS last_event_type,
       CAST(max(timestamp) FILTER (WHERE event_type IN ('INVENTORY_UPDATED', 'RESTOCKED', 'OUT_OF_STOCK', 'ADJUSTED')) AS VARCHAR) AS last_event_at,
       arg_max(quantity_change, (timestamp, event_id)) FILTER (WHERE event_type IN ('INVENTORY_UPDATED', 'RESTOCKED')) AS last_quantity,
       CAST(sum(CASE event_type WHEN 'RESERVED' THEN abs(quantity_change) WHEN 'RELEASED' THEN -abs(quantity_change) END) AS BIGINT) AS reserved,
       count(CASE WHEN event_type IN ('LOW_STOCK', 'LOW_STOCK_ALERT') THEN 1 END) > 0 AS low_stock
FROM stock_events GROUP BY sku, warehouse_id"""


def run_state(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "event-state")
    return state.run_event_state(stock_event_stream(t), path, checkpoint=f"{path}-checkpoint")


query("stream_upsert_state", STATE, views="stock_events")(run_state)


@query("sink_event_state", STATE, views="stock_events")
def _(t: Tables):
    """The same state out of a batch of events."""
    return state.fold_state(state.batch_state(t.stock_events))


@query("stream_metrics_etl", f"""
SELECT sku, warehouse_id, round(velocity_7d, 6) AS velocity_7d, round(velocity_30d, 6) AS velocity_30d,
       round(volatility, 6) AS volatility, round(trend, 6) + 0.0 AS trend,
       round(seasonality_index, 6) AS seasonality_index, stockout_risk, reorder_recommendation
FROM ({METRICS})""", views="tx_dense")
def _(t: Tables):
    """Movements arrive as JSON events; the ledger is a stream of its own, which keeps the table of days."""
    base = fresh_dir(t.spark, "metrics-etl")
    event = F.struct(
        "sku", F.col("warehouse_id").alias("warehouse"), F.col("quantity_change").alias("quantityChange"),
        F.lit("INVENTORY_UPDATED").alias("eventType"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    t.tx_dense.select(F.to_json(event).alias("value")).write.text(f"{base}/topic")
    lines = src.read_table_files(t.spark, t.folder, t.lineitem.schema, only="lineitem.parquet")
    ledger = t.spark.sql(VIEWS["tx_dense"], lineitem=lines, **{n: getattr(t, n) for n in ("part", "supplier", "nation")})
    sold = run_days(ledger, f"{base}/days", checkpoint=f"{base}/days-checkpoint")
    newest = run_metrics(
        src.read_json_lines(t.spark, f"{base}/topic"), sold, as_of=DENSE_AS_OF, path=base, checkpoint=f"{base}/checkpoint",
    )
    return newest.read().drop("processed_at", BATCH)


@query("stream_enrich", f"""
SELECT e.event_id, e.sku, e.warehouse_id, h.sales_count_30d, CAST(h.total_sales_30d AS BIGINT) AS total_sales_30d
FROM stock_events e LEFT JOIN ({SUMMARY}) h ON e.sku = h.sku AND e.warehouse_id = h.warehouse_id
""", views="stock_events tx")
def _(t: Tables):
    path = fresh_dir(t.spark, "enriched")
    history = snapshot.sales_summary(t.tx, as_of=EVENTS_AS_OF)
    return run_enriched(stock_event_stream(t), history, path, checkpoint=f"{path}-checkpoint").select(
        "event_id", *KEY, "sales_count_30d", "total_sales_30d"
    )


# -- rates ----------------------------------------------------------------------------------

RATE = """
SELECT CAST(w AS VARCHAR) AS window_start, CAST(w + INTERVAL 5 MINUTE AS VARCHAR) AS window_end, event_type,
       count(*) AS requests, round(count(*) / 300.0, 6) AS rate
FROM (SELECT event_type, time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01') - to_minutes(k) AS w
      FROM events, generate_series(0, 4) g(k) WHERE {where}) x GROUP BY w, event_type"""
_RATED = ["window_start", "window_end", "event_type"]

query("request_rate", RATE.format(where="TRUE"))(
    lambda t: _updated(t, windows.request_rate(event_stream(t), by=["event_type"]), "rate", _RATED)
)


@query("error_rate_alert", f"""
SELECT *, 'critical' AS severity FROM ({RATE.format(where="event_type = 'error'")}) WHERE rate > 0.01""")
def _(t: Tables):
    """Failed requests; the bar is lowered to what the data reaches."""
    failed = event_stream(t).filter(F.col("event_type") == "error")
    rates = _updated(t, windows.request_rate(failed, by=["event_type"]), "error-rate", _RATED)
    return windows.error_rate_alerts(rates, above=0.01)


@query("sustained_low_stock", """
WITH levels AS (
  SELECT t.sku, t.warehouse_id, t.timestamp, i.quantity_on_hand + sum(t.quantity_change) OVER (
           PARTITION BY t.sku, t.warehouse_id ORDER BY t.timestamp, t.id ROWS UNBOUNDED PRECEDING) AS stock_after
  FROM tx t JOIN items i ON t.sku = i.sku AND t.warehouse_id = i.warehouse_id),
minutes AS (
  SELECT sku, warehouse_id, date_trunc('minute', timestamp) AS m, max(stock_after) AS highest FROM levels GROUP BY ALL),
marked AS (
  SELECT *, lead(m) OVER w AS next, highest < 10 AS low,
         coalesce(lag(highest) OVER w < 10, FALSE) AS was FROM minutes
  WINDOW w AS (PARTITION BY sku, warehouse_id ORDER BY m)),
runs AS (
  SELECT *, sum(CASE WHEN low AND NOT was THEN 1 ELSE 0 END) OVER (
           PARTITION BY sku, warehouse_id ORDER BY m ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT sku, warehouse_id, CAST(low_since AS VARCHAR) AS low_since, CAST(until AS VARCHAR) AS until,
       CAST(highest AS BIGINT) AS highest, 'warning' AS severity
FROM (SELECT sku, warehouse_id, min(m) AS low_since, max(coalesce(next, m + INTERVAL 1 MINUTE)) AS until,
             max(highest) AS highest FROM runs WHERE low GROUP BY sku, warehouse_id, run)
WHERE until - low_since >= INTERVAL 5 MINUTE""", views="tx items")
def _(t: Tables):
    """Levels by replaying the ledger, published a week at a time, and the rule on the stream of them."""
    path = fresh_dir(t.spark, "levels")
    levels = materialized(
        cmd.replay_ledger(t.items, t.tx).select(*KEY, F.col("stock_after").cast("bigint").alias("stock_after"), "timestamp")
    )
    weeks = [EVENTS_AS_OF - timedelta(days=d) for d in (10_000, 21, 14, 7, -10_000)]
    for first, after in pairwise(weeks):
        week = levels.filter((F.col("timestamp") >= at(first)) & (F.col("timestamp") < at(after)))
        week.write.mode("append").parquet(f"{path}/published")
    stream = src.read_table_files(t.spark, f"{path}/published", levels.schema, only="*.parquet", files_per_trigger=2)
    return windows.run_sustained_low(
        stream, f"{path}/rule", by=KEY, value="stock_after", checkpoint=f"{path}/checkpoint", delay=timedelta(days=12)
    )


@query("stream_apply_commands", f"""
{REPLAY}
SELECT s.id, s.sku, s.warehouse_id, s.rejection, s.h AS on_hand_after, s.r AS reserved_after
FROM steps s WHERE s.rn > 0""", views="commands items")
def _(t: Tables):
    path = fresh_dir(t.spark, "judged")
    stream = t.spark.sql(VIEWS["commands"], tx=tx_stream(t))
    judged = stream_cmd.run_judge(t.items, stream, path, checkpoint=f"{path}-checkpoint")
    return judged.select("id", *KEY, "rejection", "on_hand_after", "reserved_after")
