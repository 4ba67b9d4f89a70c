"""Stock commands, upserts and catalog changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import catalog, commands, rollups, upsert
from granary.operators import lookups as op
from granary.plans.registry import query
from granary.plans.views import Tables
from granary.schemas import KEY

# every command of a key in order, each step from the state the one before it left
REPLAY = """
WITH RECURSIVE numbered AS (
  SELECT c.*, row_number() OVER (PARTITION BY sku, warehouse_id ORDER BY timestamp, id) AS rn FROM commands c),
steps AS (
  SELECT CAST(NULL AS BIGINT) AS id, i.sku, i.warehouse_id, 0 AS rn,
         CAST(i.quantity_on_hand AS BIGINT) AS h, CAST(i.quantity_reserved AS BIGINT) AS r,
         CAST(i.quantity_in_transit AS BIGINT) AS tr, CAST(NULL AS VARCHAR) AS rejection FROM items i
  UNION ALL
  SELECT n.id, n.sku, n.warehouse_id, CAST(n.rn AS INT),
         s.h + CASE WHEN n.op IN ('ADJUST') AND s.h + n.quantity >= 0 THEN n.quantity
                    WHEN n.op = 'RECEIPT' THEN n.quantity
                    WHEN n.op = 'SALE' AND n.quantity <= s.h - s.r THEN -n.quantity ELSE 0 END,
         s.r + CASE WHEN n.op = 'RESERVE' AND n.quantity > 0 AND n.quantity <= s.h - s.r THEN n.quantity
                    WHEN n.op = 'RELEASE' AND n.quantity <= s.r THEN -n.quantity ELSE 0 END,
         s.tr - CASE WHEN n.op = 'RECEIPT' AND s.tr >= n.quantity THEN n.quantity ELSE 0 END,
         CASE WHEN n.op = 'ADJUST' AND s.h + n.quantity < 0 THEN 'NEGATIVE_INVENTORY'
              WHEN n.op = 'RESERVE' AND n.quantity <= 0 THEN 'QUANTITY_NOT_POSITIVE'
              WHEN n.op IN ('RESERVE', 'SALE') AND n.quantity > s.h - s.r THEN 'INSUFFICIENT_INVENTORY'
              WHEN n.op = 'RELEASE' AND n.quantity > s.r THEN 'RELEASE_EXCEEDS_RESERVED' END
  FROM steps s JOIN numbered n ON n.sku = s.sku AND n.warehouse_id = s.warehouse_id AND n.rn = s.rn + 1)"""

query("apply_commands", f"""
{REPLAY}
SELECT s.id, s.sku, s.warehouse_id, c.op, c.quantity, CAST(c.timestamp AS VARCHAR) AS timestamp, s.rejection,
       s.h AS on_hand_after, s.r AS reserved_after
FROM steps s JOIN commands c ON s.id = c.id""", views="commands items")(
    lambda t: commands.judge(t.items, t.commands)
)

query("items_after_commands", f"""
{REPLAY}, last AS (
  SELECT sku, warehouse_id, arg_max(h, rn) AS h, arg_max(r, rn) AS r, arg_max(tr, rn) AS tr,
         count(CASE WHEN rn > 0 AND rejection IS NULL THEN 1 END) AS applied FROM steps GROUP BY sku, warehouse_id)
SELECT i.sku, i.warehouse_id, CAST(h AS INT) AS quantity_on_hand, CAST(r AS INT) AS quantity_reserved,
       CAST(tr AS INT) AS quantity_in_transit, applied AS version,
       CASE WHEN applied = 0 THEN i.inventory_status WHEN h = 0 THEN 'OUT_OF_STOCK'
            WHEN h - r <= i.reorder_point THEN 'LOW_STOCK' WHEN h > 3 * i.reorder_point THEN 'OVERSTOCK'
            ELSE 'NORMAL' END AS inventory_status
FROM items i JOIN last l ON i.sku = l.sku AND i.warehouse_id = l.warehouse_id""", views="commands items")(
    lambda t: commands.items_after(t.items, t.commands).select(
        *KEY, "quantity_on_hand", "quantity_reserved", "quantity_in_transit", "version", "inventory_status"
    )
)


@query("bulk_adjust", f"""
{REPLAY.replace("FROM commands c)", "FROM commands c WHERE c.op = 'ADJUST')")}
SELECT s.id, s.sku, s.warehouse_id, s.rejection, s.h AS on_hand_after
FROM steps s WHERE s.rn > 0""", views="commands items")
def _(t: Tables):
    adjustments = op.where_equal(t.commands, op="ADJUST")
    return commands.judge(t.items, adjustments).select("id", *KEY, "rejection", "on_hand_after")


query("replay_ledger", """
SELECT t.id, t.sku, t.warehouse_id, CAST(t.timestamp AS VARCHAR) AS timestamp, t.quantity_change,
       CAST(i.quantity_on_hand + sum(t.quantity_change) OVER (
         PARTITION BY t.sku, t.warehouse_id ORDER BY t.timestamp, t.id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stock_after
FROM tx t JOIN items i ON t.sku = i.sku AND t.warehouse_id = i.warehouse_id""", views="tx items")(
    lambda t: commands.replay_ledger(t.items, t.tx)
)

query("ledger_from_commands", """
SELECT id, sku, warehouse_id, CASE WHEN op IN ('SALE', 'RESERVE') THEN -quantity ELSE quantity END AS quantity_change,
       CASE op WHEN 'SALE' THEN 'SALE' WHEN 'RESERVE' THEN 'RESERVATION' WHEN 'RELEASE' THEN 'RELEASE'
               WHEN 'RECEIPT' THEN 'RESTOCK' ELSE 'ADJUSTMENT' END AS transaction_type,
       CAST(timestamp AS VARCHAR) AS timestamp
FROM commands""", views="commands")(lambda t: commands.ledger_from_commands(t.commands))

query("events_from_commands", """
SELECT CAST(id AS VARCHAR) AS event_id, sku, warehouse_id,
       CASE WHEN op IN ('SALE', 'RESERVE') THEN -quantity ELSE quantity END AS quantity_change,
       CASE op WHEN 'RESERVE' THEN 'RESERVED' WHEN 'RELEASE' THEN 'RELEASED' WHEN 'RECEIPT' THEN 'RESTOCKED'
               ELSE 'INVENTORY_UPDATED' END AS event_type,
       CAST(timestamp AS VARCHAR) AS timestamp
FROM commands""", views="commands")(lambda t: commands.events_from_commands(t.commands))

# -- upserts --------------------------------------------------------------------------------

_STOCK = ["sku", "warehouse_id", "quantity_on_hand", "reorder_point"]


def new_levels(t: Tables):
    """Levels for two of the three kinds of keys, and for keys that are not there yet."""
    return t.items.filter(F.col("quantity_in_transit") % 3 > 0).select(
        F.when(F.col("quantity_in_transit") % 3 == 2, F.concat("sku", F.lit("-N")))
        .otherwise(F.col("sku")).alias("sku"),
        "warehouse_id",
        (F.col("quantity_on_hand") + 1000).alias("quantity_on_hand"),
        (F.col("reorder_point") + 500).alias("reorder_point"),
    )


_NEW = """SELECT CASE WHEN quantity_in_transit % 3 = 2 THEN sku || '-N' ELSE sku END AS sku, warehouse_id,
       quantity_on_hand + 1000 AS quantity_on_hand, reorder_point + 500 AS reorder_point
FROM items WHERE quantity_in_transit % 3 > 0"""

query("upsert_snapshot", f"""
SELECT coalesce(o.sku, n.sku) AS sku, coalesce(o.warehouse_id, n.warehouse_id) AS warehouse_id,
       coalesce(n.quantity_on_hand, o.quantity_on_hand) AS quantity_on_hand,
       coalesce(o.reorder_point, n.reorder_point) AS reorder_point
FROM items o FULL JOIN ({_NEW}) n ON o.sku = n.sku AND o.warehouse_id = n.warehouse_id""", views="items")(
    lambda t: upsert.upsert(t.items.select(_STOCK), new_levels(t), KEY, update=["quantity_on_hand"])
)

query("insert_ignore", f"""
SELECT sku, warehouse_id, quantity_on_hand, reorder_point FROM items
UNION ALL SELECT * FROM ({_NEW}) n
WHERE NOT EXISTS (SELECT 1 FROM items o WHERE o.sku = n.sku AND o.warehouse_id = n.warehouse_id)""",
      views="items")(lambda t: upsert.insert_ignore(t.items.select(_STOCK), new_levels(t), KEY))

query("update_reorder_point", f"""
SELECT o.sku, o.warehouse_id, o.quantity_on_hand, coalesce(n.reorder_point, o.reorder_point) AS reorder_point
FROM items o LEFT JOIN ({_NEW}) n ON o.sku = n.sku AND o.warehouse_id = n.warehouse_id""", views="items")(
    lambda t: upsert.update_columns(t.items.select(_STOCK), new_levels(t), KEY, ["reorder_point"])
)

_ROLL_KEY = ["aggregation_date", *KEY, "transaction_type"]


@query("upsert_rollups", """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS aggregation_date, sku, warehouse_id, transaction_type,
       CAST(sum(abs(quantity_change)) AS BIGINT) AS total_quantity, count(*) AS transaction_count
FROM tx GROUP BY CAST(timestamp AS DATE), sku, warehouse_id, transaction_type""", views="tx")
def _(t: Tables):
    """A table filled from part of the ledger, met by the rollup of all of it."""
    partial = rollups.daily_rollup(t.tx.filter(F.col("id") % 3 == 0))
    return upsert.upsert(partial, rollups.daily_rollup(t.tx), _ROLL_KEY)


query("soft_delete", """
SELECT id, sku, name, CASE WHEN category_id IS NULL THEN FALSE ELSE is_active END AS is_active FROM catalog""",
      views="catalog")(
    lambda t: upsert.soft_delete(
        t.catalog.select("id", "sku", "name", "is_active"),
        t.catalog.filter(F.col("category_id").isNull()), "id",
    )
)

# -- catalog changes ------------------------------------------------------------------------

_CATALOG = ["id", "sku", "name", "category_id", "is_active"]


def requests(t: Tables):
    """For every product one request; what is asked depends on its id."""
    kind = F.col("id") % 6
    return t.catalog.select(
        F.col("id").alias("request_id"),
        # 0, 1: create; 2: update of an unknown row; else update of the row itself
        F.when(kind < 2, F.lit(None)).when(kind == 2, F.col("id") + 10_000_000)
        .otherwise(F.col("id")).cast("bigint").alias("id"),
        # 0: a sku that is taken; 1, 3: a new one; else its own
        F.when(kind.isin(1, 3), F.concat("sku", F.lit("-B"))).otherwise(F.col("sku")).alias("sku"),
        F.upper("name").alias("name"),
        # 4: a category that does not exist
        F.when(kind == 4, F.lit(999)).otherwise(F.col("category_id")).cast("bigint").alias("category_id"),
        F.when(kind != 5, ~F.col("is_active")).alias("is_active"),
    )


query("catalog_upsert_judged", """
SELECT id AS request_id,
       CASE id % 6 WHEN 0 THEN 'DUPLICATE' WHEN 2 THEN 'NOT_FOUND' WHEN 4 THEN 'PARENT_NOT_FOUND' END AS rejection
FROM catalog""", views="catalog categories")(
    lambda t: catalog.judge_changes(
        t.catalog.select(_CATALOG), requests(t), unique="sku", parent="category_id", parents=t.categories
    ).select("request_id", "rejection")
)

query("catalog_upsert", """
SELECT id, CASE WHEN id % 6 = 3 THEN sku || '-B' ELSE sku END AS sku,
       CASE WHEN id % 6 IN (3, 5) THEN upper(name) ELSE name END AS name, category_id,
       CASE WHEN id % 6 = 3 THEN NOT is_active ELSE is_active END AS is_active
FROM catalog
UNION ALL
SELECT (SELECT max(id) FROM catalog) + id, sku || '-B', upper(name), category_id, NOT is_active
FROM catalog WHERE id % 6 = 1""", views="catalog categories")(
    lambda t: catalog.apply_changes(
        t.catalog.select(_CATALOG),
        catalog.judge_changes(
            t.catalog.select(_CATALOG), requests(t), unique="sku", parent="category_id", parents=t.categories
        ),
    )
)


def changes_of(view: str, unique: str, rest: list[str], parent: str | None) -> None:
    """Queries of one request per row of a catalog table, as `requests` makes them for products."""
    columns = ["id", unique, *rest, "is_active"]
    flipped = "3" if parent else "3, 4"
    no_parent = " WHEN 4 THEN 'PARENT_NOT_FOUND'" if parent else ""
    also = "".join(f", {c}" for c in rest)

    def asked(t: Tables):
        kind = F.col("id") % 6
        table = getattr(t, view)
        return table.select(
            F.col("id").alias("request_id"),
            F.when(kind < 2, F.lit(None)).when(kind == 2, F.col("id") + 10_000_000)
            .otherwise(F.col("id")).cast("bigint").alias("id"),
            F.when(kind.isin(1, 3), F.concat(unique, F.lit("-B"))).otherwise(F.col(unique)).alias(unique),
            *[F.when(kind == 4, F.lit(10**9)).otherwise(F.col(c)).cast("bigint").alias(c) if c == parent else F.col(c) for c in rest],
            F.when(kind != 5, ~F.col("is_active")).alias("is_active"),
        )

    def judged(t: Tables):
        table = getattr(t, view).select(columns)
        return catalog.judge_changes(table, asked(t), unique=unique, parent=parent, parents=getattr(t, view) if parent else None)

    query(f"{view}_upsert_judged", f"""
SELECT id AS request_id, CASE id % 6 WHEN 0 THEN 'DUPLICATE' WHEN 2 THEN 'NOT_FOUND'{no_parent} END AS rejection FROM {view}""",
          views=view)(lambda t: judged(t).select("request_id", "rejection"))
    query(f"{view}_upsert", f"""
SELECT id, CASE WHEN id % 6 = 3 THEN {unique} || '-B' ELSE {unique} END AS {unique}{also},
       CASE WHEN id % 6 IN ({flipped}) THEN NOT is_active ELSE is_active END AS is_active FROM {view}
UNION ALL
SELECT (SELECT max(id) FROM {view}) + id, {unique} || '-B'{also}, NOT is_active FROM {view} WHERE id % 6 = 1""", views=view)(
        lambda t: catalog.apply_changes(getattr(t, view).select(columns), judged(t))
    )


changes_of("categories", "name", ["parent_category_id"], "parent_category_id")
changes_of("warehouses", "warehouse_id", ["name", "country"], None)
