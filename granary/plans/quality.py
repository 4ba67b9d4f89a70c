"""Data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import quality as dq
from granary.plans.registry import query
from granary.plans.views import EVENTS_AS_OF, Tables
from granary.schemas import KEY


def _count(**rules: str) -> str:
    return ", ".join(f"count(CASE WHEN {rule} THEN 1 END) AS {name}" for name, rule in rules.items())


_inventory = dict(
    negative_inventory="quantity_on_hand < 0",
    over_reserved="quantity_reserved > quantity_on_hand",
    negative_reorder_point="reorder_point < 0",
    negative_reorder_quantity="reorder_quantity < 0",
    missing_sku="sku IS NULL OR sku = ''",
    missing_warehouse_id="warehouse_id IS NULL OR warehouse_id = ''",
    negative_unit_cost="unit_cost < 0",
)
_transactions = dict(
    missing_sku="sku IS NULL OR sku = ''",
    missing_warehouse_id="warehouse_id IS NULL OR warehouse_id = ''",
    zero_quantity_change="quantity_change = 0",
    missing_transaction_type="transaction_type IS NULL OR transaction_type = ''",
    missing_timestamp="timestamp IS NULL",
    future_timestamp="timestamp > TIMESTAMP '2024-01-31 00:00:00'",
)
_products = dict(
    missing_sku="sku IS NULL OR sku = ''",
    missing_name="name IS NULL OR name = ''",
    negative_price="price < 0",
    missing_category="category_id IS NULL",
)
INVENTORY = f"SELECT {_count(**_inventory)}, count(*) AS total_records FROM items WHERE inventory_status <> 'DISCONTINUED'"
TRANSACTIONS = f"""SELECT {_count(**_transactions)}, count(*) AS total_transactions FROM tx
WHERE timestamp >= TIMESTAMP '2024-01-01 00:00:00'"""
PRODUCTS = f"SELECT {_count(**_products)}, count(*) AS total_products FROM catalog WHERE is_active"

query("dq_inventory", INVENTORY, views="items")(lambda t: dq.check_inventory(t.items))
query("dq_transactions", TRANSACTIONS, views="tx")(
    lambda t: dq.check_transactions(t.tx, as_of=EVENTS_AS_OF)
)
query("dq_transactions_all", f"SELECT {_count(**_transactions)}, count(*) AS total_transactions FROM tx",
      views="tx")(lambda t: dq.check_transactions(t.tx, as_of=EVENTS_AS_OF, days=None))
query("dq_products", PRODUCTS, views="catalog")(lambda t: dq.check_products(t.catalog))

_gate = {k: _inventory[k] for k in dq.GATE_RULES}
_wide = {k: _inventory[k] for k in dq.WIDE_GATE_RULES}
query("dq_snapshot_gate",
      f"SELECT {_count(**_gate)} FROM items WHERE inventory_status <> 'DISCONTINUED'", views="items")(
    lambda t: dq.snapshot_gate(t.items)
)
query("dq_snapshot_gate_wide",
      f"SELECT {_count(**_wide)} FROM items WHERE inventory_status <> 'DISCONTINUED'", views="items")(
    lambda t: dq.snapshot_gate(t.items, wide=True)
)

# Label of each rule in the report.
_labels = {
    "negative_inventory": "Negative inventory", "over_reserved": "Over-reserved items",
    "negative_reorder_point": "Negative reorder points",
    "negative_reorder_quantity": "Negative reorder quantities", "missing_sku": "Missing SKUs",
    "missing_warehouse_id": "Missing warehouse IDs", "negative_unit_cost": "Negative unit costs",
    "zero_quantity_change": "Zero quantity changes",
    "missing_transaction_type": "Missing transaction types",
    "missing_timestamp": "Missing timestamps", "future_timestamp": "Future timestamps",
    "missing_name": "Missing names", "negative_price": "Negative prices",
    "missing_category": "Missing categories",
}


def _tidy(source: str, rules: dict, total: str, dataset: str, noun: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, {total} AS total_records, '{name}' AS \"check\", {name} AS failures, "
        f"'{_labels[name]}: ' || {name} || ' {noun}' AS text FROM ({source})"
        for name in rules
    )


CHECKS = " UNION ALL ".join([
    _tidy(INVENTORY, _inventory, "total_records", "inventory", "records"),
    _tidy(TRANSACTIONS, _transactions, "total_transactions", "transactions", "transactions"),
    _tidy(PRODUCTS, _products, "total_products", "products", "products"),
])


def checks(t: Tables):
    return dq.quality_checks(t.items, t.tx, t.catalog, as_of=EVENTS_AS_OF)


query("quality_union", CHECKS, views="items tx catalog")(checks)
query("dq_report", f"""
WITH c AS ({CHECKS}), s AS (
  SELECT dataset, max(total_records) AS total_records, count(CASE WHEN failures > 0 THEN 1 END) AS issue_count,
         coalesce(string_agg(CASE WHEN failures > 0 THEN text END, '; ' ORDER BY text), '') AS issues
  FROM c GROUP BY dataset),
u AS (SELECT * FROM s UNION ALL
      SELECT 'summary', CAST(sum(total_records) AS BIGINT), CAST(sum(issue_count) AS BIGINT), '' FROM s)
SELECT *, CASE WHEN issue_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM u""",
      views="items tx catalog")(lambda t: dq.quality_report(checks(t)))

_VIOLATIONS = {
    "sku_size_3_50": "length(sku) NOT BETWEEN 3 AND 50",
    "warehouse_size_2_20": "length(warehouse_id) NOT BETWEEN 2 AND 20",
    "on_hand_min_0": "quantity_on_hand IS NULL OR quantity_on_hand < 0",
    "reserved_min_0": "quantity_reserved IS NULL OR quantity_reserved < 0",
    "in_transit_min_0": "quantity_in_transit IS NULL OR quantity_in_transit < 0",
    "reorder_point_min_0": "reorder_point IS NULL OR reorder_point < 0",
    "reorder_quantity_min_0": "reorder_quantity IS NULL OR reorder_quantity < 0",
    "status_domain": "inventory_status NOT IN ('NORMAL', 'LOW_STOCK', 'OUT_OF_STOCK', 'OVERSTOCK', 'DISCONTINUED')",
}
_DAMAGED = """SELECT sku, warehouse_id, quantity_on_hand - quantity_reserved AS quantity_on_hand, quantity_reserved,
       CASE WHEN quantity_in_transit = 0 THEN NULL ELSE quantity_in_transit END AS quantity_in_transit,
       reorder_point - 5 AS reorder_point, reorder_quantity,
       CASE WHEN reorder_point = 0 THEN 'GONE' ELSE inventory_status END AS inventory_status FROM items"""


@query("dq_constraints", " UNION ALL ".join(
    f"SELECT sku, warehouse_id, '{name}' AS violation FROM ({_DAMAGED}) WHERE {rule}"
    for name, rule in _VIOLATIONS.items()
), views="items")
def _(t: Tables):
    zero = F.col("quantity_in_transit") == 0
    damaged = t.items.withColumns({
        "inventory_status": F.when(F.col("reorder_point") == 0, "GONE").otherwise(F.col("inventory_status")),
        "quantity_on_hand": F.col("quantity_on_hand") - F.col("quantity_reserved"),
        "quantity_in_transit": F.when(~zero, F.col("quantity_in_transit")),
        "reorder_point": F.col("reorder_point") - 5,
    })
    return dq.violations(damaged, dq.ITEM_CONSTRAINTS, identity=KEY)


query("dq_product_constraints", """
SELECT id, 'name_size_2_200' AS violation FROM catalog WHERE length(name) NOT BETWEEN 2 AND 200
UNION ALL SELECT id, 'price_min_0' FROM catalog WHERE price - 1000 < 0""", views="catalog")(
    lambda t: dq.violations(
        t.catalog.withColumn("price", F.col("price") - 1000), dq.PRODUCT_CONSTRAINTS, identity=["id"]
    )
)

query("dq_duplicates", """
SELECT sku, warehouse_id, count(*) AS occurrences FROM tx GROUP BY sku, warehouse_id HAVING count(*) > 1""",
      views="tx")(lambda t: dq.duplicates(t.tx))
