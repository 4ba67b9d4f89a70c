"""Filters, projections and lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from granary.functions import stock
from granary.operators import events as ev
from granary.operators import lookups as op
from granary.plans.registry import query
from granary.plans.views import EVENTS_AS_OF, Tables

ITEM = "sku, warehouse_id, quantity_on_hand, quantity_reserved, reorder_point, inventory_status"
_item = [c.strip() for c in ITEM.split(",")]
LOW = "quantity_on_hand - quantity_reserved <= reorder_point"


def _items(name: str, condition: str, rows):
    """A filter on the items, checked on the columns of ITEM."""
    query(name, f"SELECT {ITEM} FROM items WHERE {condition}", views="items")(
        lambda t: rows(t.items).select(*_item)
    )


_items("item_by_key", "sku = 'SKU-000042' AND warehouse_id = 'WH002'",
       lambda d: op.where_equal(d, sku="SKU-000042", warehouse_id="WH002"))
_items("items_by_warehouse", "warehouse_id = 'WH003'", lambda d: op.where_equal(d, warehouse_id="WH003"))
_items("items_by_sku", "sku = 'SKU-000042'", lambda d: op.where_equal(d, sku="SKU-000042"))
_items("items_by_status", "inventory_status = 'DISCONTINUED'",
       lambda d: op.where_equal(d, inventory_status="DISCONTINUED"))
_items("items_by_quantity", "quantity_on_hand = 0", lambda d: op.where_equal(d, quantity_on_hand=0))
_items("items_by_warehouse_quantity", "warehouse_id = 'WH001' AND quantity_on_hand = 0",
       lambda d: op.where_equal(d, warehouse_id="WH001", quantity_on_hand=0))
_items("low_stock_at_reorder", LOW, lambda d: op.low_stock(d))
_items("low_stock_threshold", "quantity_on_hand - quantity_reserved <= 10",
       lambda d: op.low_stock(d, threshold=10))
_items("low_stock_by_warehouse", f"warehouse_id = 'WH002' AND {LOW}",
       lambda d: op.low_stock(d, warehouse_id="WH002"))
_items("overstock_items", "quantity_on_hand > reorder_point * 3", lambda d: op.overstocked(d))
_items("stock_check_due",
       "last_stock_check < TIMESTAMP '2024-01-03 00:00:00' OR last_stock_check IS NULL",
       lambda d: op.stock_check_due(d, cutoff=datetime(2024, 1, 3)))
_items("items_with_reservations", "quantity_reserved > 0", lambda d: op.with_reservations(d))

RESPONSE = f"""
SELECT {ITEM}, quantity_in_transit, reorder_quantity, round(CAST(unit_cost AS DOUBLE), 6) AS unit_cost,
       CAST(last_stock_check AS VARCHAR) AS last_stock_check,
       quantity_on_hand - quantity_reserved AS available_quantity,
       quantity_on_hand + quantity_in_transit AS total_quantity,
       round(CAST(coalesce(unit_cost, 0) * quantity_on_hand AS DOUBLE), 6) AS current_value,
       {LOW} AS needs_reorder
FROM items"""
query("inventory_response", RESPONSE, views="items")(lambda t: op.inventory_response(t.items))
query("items_needing_reorder", RESPONSE + f" WHERE {LOW}", views="items")(
    lambda t: op.items_needing_reorder(t.items)
)

query("derive_status", f"""
SELECT {ITEM}, CASE WHEN quantity_on_hand = 0 THEN 'OUT_OF_STOCK' WHEN {LOW} THEN 'LOW_STOCK'
    WHEN quantity_on_hand > reorder_point * 3 THEN 'OVERSTOCK' ELSE 'NORMAL' END AS derived_status
FROM items""", views="items")(
    lambda t: op.with_derived_status(t.items).select(*_item, "derived_status")
)

# -- ledger ---------------------------------------------------------------------------------

TX = "id, sku, warehouse_id, quantity_change, transaction_type, CAST(timestamp AS VARCHAR) AS timestamp"


def _tx(name: str, condition: str, rows):
    query(name, f"SELECT {TX} FROM tx WHERE {condition}", views="tx")(lambda t: rows(t.tx))


_tx("tx_by_sku", "sku = 'SKU-000042'", lambda d: op.where_equal(d, sku="SKU-000042"))
_tx("tx_by_warehouse", "warehouse_id = 'WH003'", lambda d: op.where_equal(d, warehouse_id="WH003"))
_tx("tx_by_sku_warehouse", "sku = 'SKU-000042' AND warehouse_id = 'WH003'",
    lambda d: op.where_equal(d, sku="SKU-000042", warehouse_id="WH003"))
_tx("tx_date_range",
    "timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'",
    lambda d: op.in_date_range(d, datetime(2024, 1, 10), datetime(2024, 1, 12, 12)))

# -- catalog --------------------------------------------------------------------------------

PRODUCT = "id, sku, name, description, round(CAST(price AS DOUBLE), 6) AS price, category_id, is_active"
_product = ["id", "sku", "name", "description", "price", "category_id", "is_active"]


def _products(name: str, condition: str, rows, views: str = "catalog"):
    query(name, f"SELECT {PRODUCT} FROM catalog WHERE {condition}", views=views)(
        lambda t: rows(t.catalog).select(*_product)
    )


_products("products_active", "is_active", op.active)
_products("products_by_category", "category_id = 3", lambda d: op.where_equal(d, category_id=3))
_products("products_by_category_active", "category_id = 3 AND is_active",
          lambda d: op.where_equal(op.active(d), category_id=3))
_products("product_by_sku", "sku = 'SKU-000123'", lambda d: op.where_equal(d, sku="SKU-000123"))
_products("product_search", "is_active AND (lower(name) LIKE '%11%' OR lower(sku) LIKE '%11%')",
          lambda d: op.search_products(d, "11"))
_products("product_search_contains",
          "contains(lower(name), 'brand#2') OR contains(lower(sku), 'brand#2') "
          "OR contains(lower(description), 'brand#2')",
          lambda d: op.search_products_literal(d, "Brand#2"))

CATEGORY = "SELECT id, name, parent_category_id, is_active FROM categories WHERE "


def _categories(name: str, condition: str, rows):
    query(name, CATEGORY + condition, views="categories")(lambda t: rows(t.categories))


_categories("category_by_name", "name = 'ECONOMY'", lambda d: op.where_equal(d, name="ECONOMY"))
_categories("category_search", "is_active AND lower(name) LIKE '%o%'", lambda d: op.search_categories(d, "O"))
_categories("categories_active", "is_active", op.active)
_categories("categories_root", "parent_category_id IS NULL",
            lambda d: d.filter(F.col("parent_category_id").isNull()))
_categories("categories_children", "parent_category_id = 1",
            lambda d: op.where_equal(d, parent_category_id=1))

WAREHOUSE = "SELECT id, warehouse_id, name, country, is_active FROM warehouses WHERE "


def _warehouses(name: str, condition: str, rows):
    query(name, WAREHOUSE + condition, views="warehouses")(lambda t: rows(t.warehouses))


_warehouses("warehouse_by_id", "warehouse_id = 'WH007'", lambda d: op.where_equal(d, warehouse_id="WH007"))
_warehouses("warehouse_search",
            "is_active AND (lower(name) LIKE '%n_1%' OR lower(warehouse_id) LIKE '%n_1%')",
            lambda d: op.search_warehouses(d, "N_1"))
_warehouses("warehouses_active", "is_active", op.active)


@query("exists_sku", """
SELECT DISTINCT sku FROM tx WHERE sku IN (SELECT sku FROM products)""", views="tx products")
def _(t: Tables):
    return op.existing(t.tx.select("sku").distinct(), t.products, "sku")


@query("exists_name", """
SELECT DISTINCT p_type AS name FROM part WHERE p_type IN (SELECT name FROM categories WHERE parent_category_id IS NULL)
""", views="categories")
def _(t: Tables):
    roots = t.categories.filter(F.col("parent_category_id").isNull())
    return op.existing(t.part.select(F.col("p_type").alias("name")).distinct(), roots, "name")


@query("exists_warehouse", """
SELECT DISTINCT warehouse_id FROM tx WHERE warehouse_id IN (SELECT warehouse_id FROM warehouses)
""", views="tx warehouses")
def _(t: Tables):
    return op.existing(t.tx.select("warehouse_id").distinct(), t.warehouses, "warehouse_id")


# -- events ---------------------------------------------------------------------------------


def raw_json(t: Tables):
    """Events as JSON text, spelled in the ways producers differ, with some fields left out."""
    e = t.events
    kind = F.col("event_id") % 5
    text = F.col("event_id").cast("string")
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    record = F.to_json(F.struct(
        F.when(kind != 1, text).alias("eventId"),
        F.when(kind == 1, text).alias("id"),
        F.when(kind != 4, F.col("user_id").cast("string")).alias("sku"),
        F.when(kind < 2, F.lit("WH001")).alias("warehouse"),
        F.when(kind == 2, F.lit("WH002")).alias("warehouseId"),
        F.when(kind != 3, F.floor("value").cast("int")).alias("quantityChange"),
        F.when(kind != 0, F.col("event_type")).alias("eventType"),
        F.when(kind == 0, when)
        .when(kind == 1, F.concat(when, F.lit("Z")))
        .when(kind == 2, F.concat(when, F.lit("+02:00")))
        .when((kind == 3) & (F.col("event_id") % 2 == 0), F.lit("yesterday")).alias("timestamp"),
    ))
    return e.select(F.when(F.col("event_id") % 50 == 49, F.lit("{not json")).otherwise(record).alias("value"))


PARSED = """
SELECT CASE WHEN bad THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id,
       CASE WHEN bad OR k = 4 THEN '' ELSE CAST(user_id AS VARCHAR) END AS sku,
       CASE WHEN bad THEN '' WHEN k < 2 THEN 'WH001' WHEN k = 2 THEN 'WH002' ELSE '' END AS warehouse_id,
       CASE WHEN bad OR k = 3 THEN 0 ELSE CAST(floor(value) AS INT) END AS quantity_change,
       CASE WHEN bad OR k = 0 THEN 'UNKNOWN' ELSE event_type END AS event_type,
       CAST(CASE WHEN bad OR k = 4 OR (k = 3 AND event_id % 2 = 1) THEN TIMESTAMP '2024-01-31 00:00:00'
                 WHEN k = 3 THEN NULL WHEN k = 2 THEN ts - INTERVAL 2 HOUR ELSE ts END AS VARCHAR) AS timestamp,
       bad OR (k = 3 AND event_id % 2 = 0) AS malformed
FROM (SELECT *, event_id % 5 AS k, event_id % 50 = 49 AS bad FROM events) e"""

query("parse_event", PARSED)(
    lambda t: ev.parse_events(raw_json(t), received_at=EVENTS_AS_OF).drop("value")
)


@query("event_time_features", """
SELECT event_id, CAST(timestamp AS VARCHAR) AS timestamp, CAST(hour(timestamp) AS INT) AS hour,
       CAST(isodow(timestamp) - 1 AS INT) AS day_of_week, isodow(timestamp) >= 6 AS is_weekend
FROM stock_events""", views="stock_events")
def _(t: Tables):
    return ev.with_time_features(t.stock_events).select(
        "event_id", "timestamp", "hour", "day_of_week", "is_weekend"
    )


@query("reference_id_format", """
SELECT id, 'ORDER-' || lpad(CAST(id % 10000 AS VARCHAR), 6, '0') AS reference_id FROM tx""", views="tx")
def _(t: Tables):
    return t.tx.select("id", stock.reference_id("ORDER", F.col("id") % 10_000).alias("reference_id"))
