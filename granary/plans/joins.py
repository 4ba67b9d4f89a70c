"""The stock snapshot, joins of items with movements, and catalog joins."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from granary.operators import catalog, snapshot
from granary.plans.registry import query
from granary.plans.views import EVENTS_AS_OF, Tables
from granary.schemas import KEY

# Units sold and the last movement of each key since the first day of January.
SUMMARY = """
SELECT sku, warehouse_id, count(*) FILTER (transaction_type = 'SALE') AS sales_count_30d,
       coalesce(sum(abs(quantity_change)) FILTER (transaction_type = 'SALE'), 0) AS total_sales_30d,
       avg(abs(quantity_change)) FILTER (transaction_type = 'SALE') AS avg_sale_quantity,
       stddev_samp(abs(quantity_change)) FILTER (transaction_type = 'SALE') AS stddev_sale_quantity,
       max(timestamp) AS last_transaction_date
FROM tx WHERE timestamp >= TIMESTAMP '2024-01-01' GROUP BY sku, warehouse_id"""

SNAPSHOT = f"""
SELECT i.sku, i.warehouse_id,
       CASE WHEN i.quantity_on_hand = 0 THEN 'STOCKOUT'
            WHEN i.quantity_on_hand - i.quantity_reserved <= i.reorder_point THEN 'NEEDS_REORDER'
            WHEN s.total_sales_30d = 0 THEN 'NO_MOVEMENT' ELSE 'NORMAL' END AS action_required,
       i.inventory_status AS status, i.last_reorder_date, s.last_transaction_date,
       i.quantity_on_hand, i.quantity_reserved, i.reorder_point, i.reorder_quantity, CAST(i.unit_cost AS DOUBLE) AS unit_cost,
       i.quantity_on_hand * coalesce(CAST(i.unit_cost AS DOUBLE), 0) AS inventory_value,
       coalesce(s.sales_count_30d, 0) AS sales_count_30d, CAST(coalesce(s.total_sales_30d, 0) AS BIGINT) AS total_sales_30d,
       coalesce(s.avg_sale_quantity, 0) AS avg_sale_quantity, coalesce(s.stddev_sale_quantity, 0) AS stddev_sale_quantity,
       CAST(coalesce(s.total_sales_30d, 0) AS DOUBLE) / 30 AS daily_velocity
FROM ordered_items i LEFT JOIN ({SUMMARY}) s ON i.sku = s.sku AND i.warehouse_id = s.warehouse_id
WHERE i.inventory_status <> 'DISCONTINUED'"""


def snapshot_of(t: Tables):
    return snapshot.inventory_snapshot(t.ordered_items, t.tx, as_of=EVENTS_AS_OF)


def daily_rows(t: Tables):
    return snapshot.daily_snapshot_rows(snapshot_of(t), snapshot_date=EVENTS_AS_OF.date())


query("inventory_snapshot", f"""
SELECT * REPLACE (round(avg_sale_quantity, 6) AS avg_sale_quantity,
                  round(stddev_sale_quantity, 6) AS stddev_sale_quantity,
                  round(daily_velocity, 6) AS daily_velocity,
                  CAST(last_reorder_date AS VARCHAR) AS last_reorder_date,
                  CAST(last_transaction_date AS VARCHAR) AS last_transaction_date)
FROM ({SNAPSHOT})""", views="ordered_items tx")(snapshot_of)

query("tx_summary_30d", f"""
SELECT sku, warehouse_id, sales_count_30d, CAST(total_sales_30d AS BIGINT) AS total_sales_30d,
       round(avg_sale_quantity, 6) AS avg_sale_quantity,
       round(stddev_sale_quantity, 6) AS stddev_sale_quantity,
       CAST(last_transaction_date AS VARCHAR) AS last_transaction_date
FROM ({SUMMARY})""", views="tx")(lambda t: snapshot.sales_summary(t.tx, as_of=EVENTS_AS_OF))

query("action_required", f"""
SELECT action_required, count(*) AS items FROM ({SNAPSHOT}) GROUP BY action_required""",
      views="ordered_items tx")(
    lambda t: snapshot_of(t).groupBy("action_required").agg(F.count(F.lit(1)).alias("items"))
)

query("snapshot_counts", f"""
SELECT count(DISTINCT sku) AS total_skus, count(DISTINCT warehouse_id) AS total_warehouses,
       count(*) FILTER (action_required = 'STOCKOUT') AS stockout_count,
       count(*) FILTER (action_required = 'NEEDS_REORDER') AS reorder_count
FROM ({SNAPSHOT})""", views="ordered_items tx")(lambda t: snapshot.snapshot_counts(snapshot_of(t)))

query("warehouse_metrics", f"""
SELECT warehouse_id, count(DISTINCT sku) AS total_skus,
       count(*) FILTER (action_required = 'STOCKOUT') AS stockout_count,
       count(*) FILTER (action_required = 'NEEDS_REORDER') AS reorder_count,
       round(sum(inventory_value), 6) AS total_inventory_value,
       round(avg(CAST(CAST(daily_velocity AS DECIMAL(10,2)) AS DOUBLE)), 6) AS avg_velocity
FROM ({SNAPSHOT}) GROUP BY warehouse_id""", views="ordered_items tx")(
    lambda t: snapshot.warehouse_metrics(daily_rows(t), snapshot_date=EVENTS_AS_OF.date())
)

MOVEMENT_START = datetime(2024, 1, 20)

# Items that moved since the day, by their movements, and items that never moved; those that only moved
# before it are left out.
query("movement_stats", """
SELECT sku, warehouse_id, n AS transaction_count, CAST(sold AS BIGINT) AS total_sales, round(sold / n, 6) AS avg_sale_quantity
FROM items JOIN (SELECT sku, warehouse_id, count(*) AS n,
                        coalesce(sum(abs(quantity_change)) FILTER (transaction_type = 'SALE'), 0) AS sold
                 FROM tx WHERE timestamp >= TIMESTAMP '2024-01-20' GROUP BY ALL) m USING (sku, warehouse_id)
UNION ALL
SELECT sku, warehouse_id, 0, 0, 0.0 FROM items ANTI JOIN tx USING (sku, warehouse_id)""", views="items tx")(
    lambda t: snapshot.movement_stats(t.items, t.tx, start=MOVEMENT_START)
)

query("dead_stock", """
SELECT sku, warehouse_id, quantity_on_hand, quantity_reserved, quantity_in_transit, reorder_point, reorder_quantity,
       round(CAST(unit_cost AS DOUBLE), 6) AS unit_cost, inventory_status, CAST(last_stock_check AS VARCHAR) AS last_stock_check
FROM items LEFT JOIN (SELECT sku, warehouse_id, max(timestamp) AS moved FROM tx GROUP BY sku, warehouse_id) m USING (sku, warehouse_id)
WHERE quantity_on_hand > 0 AND inventory_status <> 'DISCONTINUED'
  AND (moved IS NULL OR moved < TIMESTAMP '2024-01-28')""", views="items tx")(
    lambda t: snapshot.dead_stock(t.items, t.tx, cutoff=datetime(2024, 1, 28))
)

query("reconcile_on_hand", """
SELECT i.sku, i.warehouse_id,
       CAST(i.quantity_on_hand
            + coalesce((SELECT sum(t.quantity_change) FROM tx t WHERE t.sku = i.sku
                        AND t.warehouse_id = i.warehouse_id AND t.transaction_type = 'RESTOCK'), 0)
            - coalesce((SELECT sum(abs(t.quantity_change)) FROM tx t WHERE t.sku = i.sku
                        AND t.warehouse_id = i.warehouse_id AND t.transaction_type = 'SALE'), 0)
            AS BIGINT) AS quantity_on_hand
FROM items i""", views="items tx")(
    lambda t: snapshot.reconcile_on_hand(t.items, t.tx).select(*KEY, "quantity_on_hand")
)

query("seed_expand", """
SELECT sku, warehouse_id, CAST(unnest(range(1, 6)) AS INT) AS n, 'SALE' AS transaction_type,
       TRUE AS quantity_in_range, TRUE AS time_in_range, TRUE AS reference_in_format
FROM items WHERE inventory_status = 'NORMAL'""",
      views="items")(
    lambda t: snapshot.seed_movements(
        t.items, per_item=5, kind="SALE", prefix="ORDER", as_of=EVENTS_AS_OF
    ).select(
        *KEY, "n", "transaction_type",
        F.col("quantity_change").between(-11, -1).alias("quantity_in_range"),
        F.col("timestamp").between(
            F.lit(EVENTS_AS_OF - timedelta(days=30)).cast("timestamp_ntz"), F.lit(EVENTS_AS_OF).cast("timestamp_ntz")
        ).alias("time_in_range"),
        F.col("reference_id").rlike(r"^ORDER-\d{6}$").alias("reference_in_format"),
    )
)


# -- catalog --------------------------------------------------------------------------------

query("product_with_category", """
SELECT p.id, p.sku, p.name, c.id AS category_id, c.name AS category_name,
       coalesce(c.name, 'Uncategorized') AS category_label
FROM catalog p LEFT JOIN categories c ON p.category_id = c.id""", views="catalog categories")(
    lambda t: catalog.product_with_category(t.catalog, t.categories).select(
        "id", "sku", "name", "category_id", "category_name", "category_label"
    )
)

query("category_with_parent", """
SELECT c.id, c.name, c.is_active, c.parent_category_id, p.name AS parent_category_name
FROM categories c LEFT JOIN categories p ON c.parent_category_id = p.id""", views="categories")(
    lambda t: catalog.category_with_parent(t.categories)
)


def with_bad_categories(t: Tables):
    """Every 13th product names a category that does not exist."""
    wrong = F.col("category_id") + F.when(F.col("id") % 13 == 0, 1000).otherwise(0)
    return t.catalog.withColumn("category_id", wrong)


query("product_fk_check", """
SELECT id, sku, category_id FROM (
  SELECT id, sku, category_id + CASE WHEN id % 13 = 0 THEN 1000 ELSE 0 END AS category_id FROM catalog) p
WHERE category_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM categories c WHERE c.id = p.category_id)
""", views="catalog categories")(
    lambda t: catalog.missing_category(with_bad_categories(t), t.categories).select(
        "id", "sku", "category_id"
    )
)

query("dimension_counts", """
SELECT 'active_products' AS metric, '' AS key, count(*) AS n FROM catalog WHERE is_active
UNION ALL SELECT 'products_in_category', CAST(category_id AS VARCHAR), count(*) FROM catalog
  WHERE category_id IS NOT NULL GROUP BY category_id
UNION ALL SELECT 'active_categories', '', count(*) FROM categories WHERE is_active
UNION ALL SELECT 'child_categories', CAST(parent_category_id AS VARCHAR), count(*) FROM categories
  WHERE parent_category_id IS NOT NULL GROUP BY parent_category_id
UNION ALL SELECT 'active_warehouses', '', count(*) FROM warehouses WHERE is_active""",
      views="catalog categories warehouses")(
    lambda t: catalog.dimension_counts(t.catalog, t.categories, t.warehouses)
)
