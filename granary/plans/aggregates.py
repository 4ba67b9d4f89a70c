"""Rollups, velocity, value and status reports, top-k and pages."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from granary.operators import events as ev
from granary.operators import lookups, replenishment, reports, rollups, series
from granary.plans.registry import query
from granary.plans.views import DENSE_AS_OF, EVENTS_AS_OF, Tables
from granary.schemas import KEY
from granary.sources.tables import as_documents

MONTH = "timestamp BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"

query("tx_daily_rollup", """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS aggregation_date, sku, warehouse_id, transaction_type,
       CAST(sum(abs(quantity_change)) AS BIGINT) AS total_quantity, count(*) AS transaction_count
FROM tx GROUP BY CAST(timestamp AS DATE), sku, warehouse_id, transaction_type""", views="tx")(
    lambda t: rollups.daily_rollup(t.tx)
)

query("tx_daily_rollup_yesterday", """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS aggregation_date, sku, warehouse_id, transaction_type,
       CAST(sum(abs(quantity_change)) AS BIGINT) AS total_quantity, count(*) AS transaction_count
FROM tx WHERE CAST(timestamp AS DATE) = DATE '2024-01-30'
GROUP BY CAST(timestamp AS DATE), sku, warehouse_id, transaction_type""", views="tx")(
    lambda t: rollups.daily_rollup(t.tx, first=date(2024, 1, 30))
)

_WEEK = """
SELECT CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS week_start_date, sku, warehouse_id, transaction_type,
       CAST(sum(q) AS BIGINT) AS total_quantity, CAST(sum(n) AS BIGINT) AS transaction_count,
       round(avg(q), 6) AS avg_daily_quantity
FROM (SELECT CAST(timestamp AS DATE) AS d, sku, warehouse_id, transaction_type,
             sum(abs(quantity_change)) AS q, count(*) AS n
      FROM {table} GROUP BY ALL) x {where}
GROUP BY date_trunc('week', d), sku, warehouse_id, transaction_type"""

query("tx_weekly_rollup",
      _WEEK.format(table="tx", where="WHERE d >= DATE '2024-01-22' AND d <= DATE '2024-01-28'"),
      views="tx")(
    lambda t: rollups.weekly_rollup(t.tx, week_start=rollups.previous_week(EVENTS_AS_OF))
)
query("tx_weekly_rollup_all", _WEEK.format(table="tx_dense", where=""), views="tx_dense")(
    lambda t: rollups.weekly_rollup_all(t.tx_dense)
)

query("daily_sales_history", """
SELECT sku, warehouse_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date,
       CAST(sum(CASE WHEN transaction_type = 'SALE' THEN abs(quantity_change) ELSE 0 END) AS BIGINT) AS daily_sales,
       count(*) AS transaction_count
FROM tx_dense WHERE timestamp >= TIMESTAMP '2001-06-30 00:00:00' - INTERVAL 90 DAY
GROUP BY sku, warehouse_id, CAST(timestamp AS DATE)""", views="tx_dense")(
    lambda t: series.daily_sales(t.tx_dense, as_of=DENSE_AS_OF)
)

DEMAND = """
SELECT sku, warehouse_id, strftime(timestamp, '%Y-%m-%d') AS day,
       CAST(abs(sum(quantity_change)) AS BIGINT) AS demand, count(*) AS transaction_count
FROM {table} WHERE transaction_type IN ('SALE', 'RETURN')
GROUP BY sku, warehouse_id, strftime(timestamp, '%Y-%m-%d')"""


@query("daily_demand_mongo", DEMAND.format(table="tx_dense"), views="tx_dense")
def _(t: Tables):
    documents = as_documents(t.tx_dense).withColumnRenamed("quantity", "quantity_change")
    return series.daily_net_demand(documents)


query("velocity_abs", f"""
SELECT k.sku, k.warehouse_id, 30 AS period_days, CAST(coalesce(q, 0) AS BIGINT) AS total_quantity,
       round(coalesce(q, 0) / 30.0, 2) AS velocity, coalesce(n, 0) AS transaction_count,
       CASE WHEN coalesce(q, 0) / 30.0 > 10 THEN 'HIGH' WHEN coalesce(q, 0) / 30.0 > 5 THEN 'MEDIUM' ELSE 'LOW' END AS trend
FROM items k LEFT JOIN (
  SELECT sku, warehouse_id, sum(abs(quantity_change)) AS q, count(*) AS n FROM tx
  WHERE {MONTH} AND transaction_type IN ('SALE', 'RETURN') GROUP BY sku, warehouse_id) x
ON k.sku = x.sku AND k.warehouse_id = x.warehouse_id""", views="items tx")(
    lambda t: reports.velocity(t.tx, as_of=EVENTS_AS_OF, period_days=30, keys=t.items)
)

NET = """
SELECT sku, warehouse_id, round(w / 7.0, 2) AS velocity_7d, round(m / 30.0, 2) AS velocity_30d,
       round(m / 30.0 * {short}, 2) AS total_sales, round({daily}, 2) AS average_daily_sales, {days} AS period_days
FROM (SELECT k.sku, k.warehouse_id, coalesce(w, 0) AS w, coalesce(m, 0) AS m
  FROM items k LEFT JOIN (
    SELECT sku, warehouse_id, abs(sum(quantity_change)) AS m,
           abs(sum(CASE WHEN timestamp >= TIMESTAMP '2024-01-24 00:00:00' THEN quantity_change END)) AS w
    FROM tx WHERE """ + MONTH + """ AND transaction_type IN ('SALE', 'RETURN')
    GROUP BY sku, warehouse_id) x
  ON k.sku = x.sku AND k.warehouse_id = x.warehouse_id) y"""
TREND = """CASE WHEN velocity_7d > velocity_30d * 1.1 THEN 'increasing'
            WHEN velocity_7d < velocity_30d * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend_direction"""

query("velocity_metrics",
      f"SELECT *, {TREND} FROM (" + NET.format(short=7, daily="w / 7.0", days=7) + ")",
      views="items tx")(
    lambda t: reports.net_velocity(t.tx, as_of=EVENTS_AS_OF, period_days=7, keys=t.items)
)
query("trend_direction",
      f"SELECT *, {TREND} FROM (" + NET.format(short=30, daily="m / 30.0", days=30) + ")",
      views="items tx")(
    lambda t: reports.net_velocity(t.tx, as_of=EVENTS_AS_OF, period_days=30, keys=t.items)
)

query("period_velocity_net", f"""
SELECT sku, warehouse_id, round(abs(sum(quantity_change)) / 30.0, 6) AS velocity, count(*) AS transaction_count
FROM tx WHERE {MONTH} AND transaction_type IN ('SALE', 'RETURN') GROUP BY sku, warehouse_id""", views="tx")(
    lambda t: reports.period_velocity_net(t.tx, as_of=EVENTS_AS_OF, days=30)
)

SALES = f"""SELECT sku, warehouse_id, sum(abs(quantity_change)) AS s, count(*) AS n FROM tx
  WHERE {MONTH} AND transaction_type = 'SALE' GROUP BY sku, warehouse_id"""

query("turnover_rate", f"""
SELECT sku, warehouse_id, 30 AS period_days, CAST(s AS BIGINT) AS total_sales,
       CAST(quantity_on_hand AS DOUBLE) AS average_inventory, round(r, 2) AS turnover_rate,
       round(CASE WHEN r > 0 THEN 30.0 / r ELSE 0 END, 2) AS days_to_turnover
FROM (SELECT i.sku, i.warehouse_id, quantity_on_hand, coalesce(s, 0) AS s,
             CASE WHEN quantity_on_hand > 0 THEN CAST(coalesce(s, 0) AS DOUBLE) / quantity_on_hand ELSE 0 END AS r
      FROM items i LEFT JOIN ({SALES}) x ON i.sku = x.sku AND i.warehouse_id = x.warehouse_id) y
""", views="items tx")(lambda t: reports.turnover(t.items, t.tx, as_of=EVENTS_AS_OF))

query("sales_trends", f"""
SELECT k.sku, k.warehouse_id, 'MONTH' AS period, 30 AS period_days, CAST(coalesce(s, 0) AS BIGINT) AS total_sales,
       coalesce(n, 0) AS transaction_count,
       CAST(CASE WHEN n > 0 THEN s // n ELSE 0 END AS BIGINT) AS average_sale_quantity
FROM items k LEFT JOIN ({SALES}) x ON k.sku = x.sku AND k.warehouse_id = x.warehouse_id""",
      views="items tx")(
    lambda t: reports.sales_trends(t.tx, as_of=EVENTS_AS_OF, period="MONTH", keys=t.items)
)

_LOW = "SELECT * FROM items WHERE quantity_on_hand - quantity_reserved <= reorder_point"
query("low_stock_report", f"""
SELECT 'reorder_point' AS threshold, (SELECT count(*) FROM ({_LOW})) AS low_stock_count, sku, warehouse_id,
       quantity_on_hand, quantity_reserved, quantity_on_hand - quantity_reserved AS available_quantity,
       reorder_point, inventory_status
FROM ({_LOW})""", views="items")(lambda t: reports.low_stock_report(t.items))

VALUE = "round(CAST(sum(quantity_on_hand * coalesce(unit_cost, 0)) AS DOUBLE), 6) AS total_value"


@query("warehouse_summary", f"""
SELECT warehouse_id, count(*) AS total_items,
       count(CASE WHEN quantity_on_hand - quantity_reserved <= reorder_point THEN 1 END) AS low_stock_count,
       count(CASE WHEN quantity_on_hand = 0 THEN 1 END) AS out_of_stock_count, {VALUE}
FROM items GROUP BY warehouse_id""", views="items")
def _(t: Tables):
    current = lookups.with_derived_status(t.items).drop("inventory_status")
    return reports.warehouse_summary(current.withColumnRenamed("derived_status", "inventory_status"))


query("inventory_value", f"SELECT warehouse_id, {VALUE} FROM items GROUP BY warehouse_id", views="items")(
    lambda t: reports.inventory_value(t.items)
)

query("status_summary", """
SELECT 'status:' || coalesce(inventory_status, '(none)') AS metric, count(*) AS n FROM items GROUP BY 1
UNION ALL SELECT 'total_items', count(*) FROM items
UNION ALL SELECT 'low_stock_items', count(*) FROM items WHERE quantity_on_hand - quantity_reserved <= reorder_point
UNION ALL SELECT 'overstock_items', count(*) FROM items WHERE quantity_on_hand > 3 * reorder_point""",
      views="items")(lambda t: reports.status_summary(t.items))

query("event_totals", """
SELECT sku, warehouse_id, count(*) AS event_count, CAST(sum(abs(quantity_change)) AS BIGINT) AS quantity_changed
FROM stock_events GROUP BY sku, warehouse_id""", views="stock_events")(
    lambda t: ev.event_totals(t.stock_events)
)
query("event_grand_totals", """
SELECT count(*) AS total_events, CAST(sum(abs(quantity_change)) AS BIGINT) AS total_quantity_changed
FROM stock_events""", views="stock_events")(lambda t: ev.grand_totals(ev.event_totals(t.stock_events)))

query("dashboard_stats", """
SELECT count(*) AS total_products, round(CAST(sum(price * 10) AS DOUBLE), 6) AS total_value,
       (SELECT count(*) FROM items WHERE quantity_on_hand - quantity_reserved <= 20) AS low_stock_items,
       (SELECT count(*) FROM warehouses WHERE is_active) AS total_warehouses
FROM catalog WHERE is_active""", views="catalog items warehouses")(
    lambda t: reports.dashboard_stats(t.catalog, t.items, t.warehouses)
)

ALERTS = """
SELECT sku, warehouse_id, quantity_on_hand, quantity_reserved,
       quantity_on_hand - quantity_reserved AS available_quantity, reorder_point, reorder_quantity,
       inventory_status, round(CAST(unit_cost AS DOUBLE), 6) AS unit_cost,
       CASE WHEN quantity_on_hand = 0 THEN 'URGENT'
            WHEN quantity_on_hand - quantity_reserved <= reorder_point THEN 'HIGH' ELSE 'NORMAL' END AS priority
FROM items
WHERE inventory_status <> 'DISCONTINUED'
  AND (quantity_on_hand = 0 OR quantity_on_hand - quantity_reserved <= reorder_point)"""

query("low_stock_priority", ALERTS, views="items")(lambda t: reports.low_stock_alerts(t.items))
query("alert_counts", f"""
SELECT count(*) AS total_low_stock_items, count(CASE WHEN priority = 'URGENT' THEN 1 END) AS urgent_count,
       count(CASE WHEN priority = 'HIGH' THEN 1 END) AS high_priority_count FROM ({ALERTS})""", views="items")(
    lambda t: reports.alert_counts(t.items)
)
query("alert_summary", f"""
WITH a AS ({ALERTS})
SELECT sku, warehouse_id, quantity_on_hand, available_quantity, reorder_point, priority,
       (SELECT count(*) FROM a) AS total_low_stock_items,
       (SELECT count(*) FROM a WHERE priority = 'URGENT') AS urgent_count,
       (SELECT count(*) FROM a WHERE priority = 'HIGH') AS high_priority_count
FROM a ORDER BY CASE priority WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END, warehouse_id, sku LIMIT 10
""", views="items")(lambda t: reports.alert_summary(t.items))

query("top_moving", f"""
SELECT sku, warehouse_id, round(sum(abs(quantity_change)) / 30.0, 2) AS velocity
FROM tx WHERE {MONTH} AND transaction_type IN ('SALE', 'RETURN')
GROUP BY sku, warehouse_id ORDER BY velocity DESC, sku, warehouse_id LIMIT 10""", views="tx")(
    lambda t: reports.top_moving(reports.velocity(t.tx, as_of=EVENTS_AS_OF), 10).select(*KEY, "velocity")
)

query("recent_products", """
SELECT id, sku, name, CAST(created_at AS VARCHAR) AS created_at FROM catalog
ORDER BY catalog.created_at DESC, id LIMIT 5""", views="catalog")(
    lambda t: lookups.newest(t.catalog).select("id", "sku", "name", "created_at")
)
query("product_page", """
SELECT id, sku, name, round(CAST(price AS DOUBLE), 6) AS price FROM catalog WHERE is_active
ORDER BY catalog.price DESC, id LIMIT 10 OFFSET 30""", views="catalog")(
    lambda t: lookups.page(
        lookups.active(t.catalog), sort_by="price", descending=True, number=3
    ).select("id", "sku", "name", "price")
)

# -- replenishment --------------------------------------------------------------------------

RECOMMEND = """
SELECT sku, warehouse_id, quantity_on_hand AS current_quantity, reorder_point,
       CASE WHEN quantity_on_hand <= reorder_point THEN reorder_point * 2 - quantity_on_hand ELSE 0 END AS recommended_quantity,
       CASE WHEN quantity_on_hand <= reorder_point THEN 'HIGH' ELSE 'LOW' END AS priority
FROM items"""
query("reorder_recommendation", RECOMMEND, views="items")(
    lambda t: replenishment.recommendations(t.items)
)


@query("purchase_orders", f"""
SELECT sha256(sku || '|' || warehouse_id || '|2024-01-31') AS order_id, 'SUPPLIER_001' AS supplier_id, warehouse_id,
       sku, recommended_quantity AS quantity, 10.0::DOUBLE AS unit_price, '2024-01-31 00:00:00' AS order_date,
       '2024-02-07 00:00:00' AS expected_delivery_date, 'PENDING' AS status
FROM ({RECOMMEND}) WHERE priority = 'HIGH'""", views="items")
def _(t: Tables):
    high = replenishment.recommendations(t.items).filter(F.col("priority") == "HIGH")
    orders = replenishment.purchase_orders(high, as_of=datetime(2024, 1, 31))
    return orders.select("*", F.inline("items")).drop("items")


query("auto_reorder_batch", """
SELECT sku, warehouse_id, coalesce(reorder_quantity, 100) AS quantity, TRUE AS auto_generated,
       'Low stock automation' AS reason
FROM items WHERE quantity_on_hand - quantity_reserved <= reorder_point""", views="items")(
    lambda t: replenishment.auto_reorder(t.items)
)
