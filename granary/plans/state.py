"""Latest values, counters and rankings per key."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from granary.operators import keyed, reports
from granary.plans.registry import query
from granary.plans.views import EVENTS_AS_OF, Tables
from granary.schemas import KEY
from granary.session import fresh_dir

query("latest_inventory", """
SELECT sku, warehouse_id, CAST(updated_at AS VARCHAR) AS updated_at, version, quantity_on_hand, quantity_reserved,
       quantity_on_hand - quantity_reserved AS quantity_available, inventory_status AS status
FROM (SELECT *, row_number() OVER (PARTITION BY sku, warehouse_id ORDER BY updated_at DESC, version DESC) AS r
      FROM item_versions) WHERE r = 1""", views="item_versions")(
    lambda t: keyed.latest_inventory(t.item_versions, order=["updated_at", "version"])
)

query("reserved_counter", """
SELECT sku, warehouse_id,
       CAST(sum(CASE event_type WHEN 'RESERVED' THEN abs(quantity_change) ELSE -abs(quantity_change) END) AS BIGINT) AS reserved
FROM stock_events WHERE event_type IN ('RESERVED', 'RELEASED') GROUP BY sku, warehouse_id""",
      views="stock_events")(lambda t: keyed.reserved_counter(t.stock_events))

query("low_stock_set", """
SELECT DISTINCT sku, warehouse_id FROM stock_events WHERE event_type IN ('LOW_STOCK', 'LOW_STOCK_ALERT')""",
      views="stock_events")(lambda t: keyed.low_stock_set(t.stock_events))

_SCORES = """
SELECT sku, warehouse_id, round(sum(abs(quantity_change)) / 30.0, 2) AS score FROM tx
WHERE timestamp BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'
  AND transaction_type IN ('SALE', 'RETURN') GROUP BY sku, warehouse_id"""


def scores(t: Tables):
    return reports.velocity(t.tx, as_of=EVENTS_AS_OF).select(*KEY, F.col("velocity").alias("score"))


query("velocity_rankings", f"{_SCORES} ORDER BY score DESC, sku, warehouse_id LIMIT 20", views="tx")(
    lambda t: keyed.velocity_rankings(scores(t), k=20)
)
query("velocity_rankings_per_warehouse", f"""
SELECT sku, warehouse_id, score, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY warehouse_id ORDER BY score DESC, sku) AS r FROM ({_SCORES}))
WHERE r <= 5""", views="tx")(lambda t: keyed.velocity_rankings(scores(t), k=5, per_warehouse=True))

# Estimates from the 64 least hashes; a small sketch, so that the given tables fill it.
_SKETCH = 64
_HASHED = "SELECT DISTINCT {by}CAST('0x' || substr(md5(sku), 1, 15) AS BIGINT) AS h FROM tx"
_ESTIMATE = f"""round(CASE WHEN count(*) >= {_SKETCH} THEN {_SKETCH - 1} / (CAST(max(h) AS DOUBLE) / pow(2, 60)) ELSE count(*) END, 6) AS hot_items,
       round(CASE WHEN count(*) >= {_SKETCH} THEN 1 / sqrt({_SKETCH - 2}) ELSE 0 END, 6) AS standard_error"""
_DISTINCT = f"SELECT {_ESTIMATE} FROM (SELECT h FROM ({_HASHED.format(by='')}) ORDER BY h LIMIT {_SKETCH})"


def daily_sketches(t: Tables):
    """One stored sketch per day."""
    path = fresh_dir(t.spark, "sketches")
    daily = t.tx.withColumn("day", F.to_date("timestamp"))
    keyed.hot_item_sketches(daily, by="day", size=_SKETCH).write.parquet(path)
    return t.spark.read.parquet(path)


query("hot_items_distinct", _DISTINCT, views="tx")(lambda t: keyed.distinct_hot_items(t.tx, size=_SKETCH))
query("hot_items_merged", _DISTINCT, views="tx")(
    lambda t: keyed.with_estimate(keyed.merge_hot_items(daily_sketches(t), size=_SKETCH), size=_SKETCH).drop("sketch")
)
query("hot_items_daily", f"""
SELECT CAST(day AS VARCHAR) AS day, {_ESTIMATE}
FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY h) AS r FROM ({_HASHED.format(by="CAST(timestamp AS DATE) AS day, ")}))
WHERE r <= {_SKETCH} GROUP BY day""", views="tx")(
    lambda t: keyed.with_estimate(daily_sketches(t), size=_SKETCH).drop("sketch")
)

query("access_counts", """
SELECT sku, count(*) AS access_count FROM tx WHERE timestamp > TIMESTAMP '2024-01-30 00:00:00' GROUP BY sku""",
      views="tx")(lambda t: keyed.access_counts(t.tx, as_of=EVENTS_AS_OF))

query("ttl_expired", """
SELECT event_id, sku, warehouse_id, CAST(timestamp AS VARCHAR) AS timestamp FROM stock_events
WHERE timestamp > TIMESTAMP '2024-01-15 11:00:00' AND timestamp <= TIMESTAMP '2024-01-15 12:00:00'""",
      views="stock_events")(
    lambda t: keyed.fresh(
        t.stock_events.filter(F.col("timestamp") <= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")),
        as_of=datetime(2024, 1, 15, 12), ttl=timedelta(hours=1),
    ).select("event_id", *KEY, "timestamp")
)

query("sink_latest_cache", """
SELECT sku, warehouse_id, CAST(processed_at AS VARCHAR) AS processed_at, round(velocity_7d, 6) AS velocity_7d,
       round(velocity_30d, 6) AS velocity_30d, stockout_risk,
       CAST(processed_at + INTERVAL 1 HOUR AS VARCHAR) AS expires_at
FROM (SELECT *, row_number() OVER (PARTITION BY sku, warehouse_id ORDER BY processed_at DESC) AS r FROM metrics_log)
WHERE r = 1""", views="metrics_log")(lambda t: keyed.latest_metrics(t.metrics_log))
