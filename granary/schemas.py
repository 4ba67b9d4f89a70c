"""Explicit schemas of the tables and streams. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["sku", "warehouse_id"]

_cost = T.DecimalType(10, 2)
_ts = T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


ITEMS = _struct(
    ("id", T.LongType()),
    ("sku", T.StringType()),
    ("warehouse_id", T.StringType()),
    ("quantity_on_hand", T.IntegerType()),
    ("quantity_reserved", T.IntegerType()),
    ("quantity_in_transit", T.IntegerType()),
    ("reorder_point", T.IntegerType()),
    ("reorder_quantity", T.IntegerType()),
    ("unit_cost", _cost),
    ("holding_cost_per_unit", _cost),
    ("stockout_cost_per_unit", _cost),
    ("inventory_status", T.StringType()),
    ("last_stock_check", _ts),
    ("last_reorder_date", _ts),
    ("created_at", _ts),
    ("updated_at", _ts),
    ("version", T.LongType()),
)

LEDGER = _struct(
    ("id", T.LongType()),
    ("sku", T.StringType()),
    ("warehouse_id", T.StringType()),
    ("quantity_change", T.IntegerType()),
    ("transaction_type", T.StringType()),
    ("timestamp", _ts),
    ("reference_id", T.StringType()),
    ("notes", T.StringType()),
    ("inventory_item_id", T.LongType()),
)

# The document-store copy of the ledger names the change "quantity".
LEDGER_DOCUMENT = _struct(
    ("sku", T.StringType()),
    ("warehouse_id", T.StringType()),
    ("quantity", T.IntegerType()),
    ("transaction_type", T.StringType()),
    ("timestamp", _ts),
)

PRODUCTS = _struct(
    ("id", T.LongType()),
    ("sku", T.StringType()),
    ("name", T.StringType()),
    ("description", T.StringType()),
    ("price", _cost),
    ("category_id", T.LongType()),
    ("is_active", T.BooleanType()),
    ("image_url", T.StringType()),
    ("unit_of_measure", T.StringType()),
    ("created_at", _ts),
    ("updated_at", _ts),
)

CATEGORIES = _struct(
    ("id", T.LongType()),
    ("name", T.StringType()),
    ("description", T.StringType()),
    ("parent_category_id", T.LongType()),
    ("is_active", T.BooleanType()),
)

WAREHOUSES = _struct(
    ("id", T.LongType()),
    ("warehouse_id", T.StringType()),
    ("name", T.StringType()),
    ("address", T.StringType()),
    ("city", T.StringType()),
    ("state", T.StringType()),
    ("country", T.StringType()),
    ("postal_code", T.StringType()),
    ("is_active", T.BooleanType()),
)

# Every spelling that producers use; operators/events.py folds them into one form.
EVENT_JSON = _struct(
    ("eventId", T.StringType()),
    ("id", T.StringType()),
    ("sku", T.StringType()),
    ("warehouse", T.StringType()),
    ("warehouseId", T.StringType()),
    ("quantityChange", T.IntegerType()),
    ("quantity", T.IntegerType()),
    ("eventType", T.StringType()),
    ("timestamp", T.StringType()),
    ("referenceId", T.StringType()),
)

EVENTS = _struct(
    ("event_id", T.StringType()),
    ("sku", T.StringType()),
    ("warehouse_id", T.StringType()),
    ("quantity_change", T.IntegerType()),
    ("event_type", T.StringType()),
    ("timestamp", _ts),
)

COMMANDS = _struct(
    ("id", T.LongType()),
    ("sku", T.StringType()),
    ("warehouse_id", T.StringType()),
    ("op", T.StringType()),
    ("quantity", T.IntegerType()),
    ("timestamp", _ts),
)

# The domains of the enumerated columns.
STATUSES = ["NORMAL", "LOW_STOCK", "OUT_OF_STOCK", "OVERSTOCK", "DISCONTINUED"]
TRANSACTION_TYPES = ["SALE", "RETURN", "ADJUSTMENT", "RESTOCK", "RESERVATION", "RELEASE"]
EVENT_TYPES = [
    "INVENTORY_UPDATED", "LOW_STOCK", "OUT_OF_STOCK", "RESTOCKED",
    "RESERVED", "RELEASED", "ADJUSTED",
]
