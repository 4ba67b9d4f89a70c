"""The daily stock snapshot and the joins of items with their movements.

The ledger is always reduced to one row per key before it meets the items, so a key that
holds a large share of the ledger is combined map-side and never skews a join.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import stock
from granary.functions.timing import at, days_before, midnight, on
from granary.schemas import KEY


def _sold() -> Column:
    return F.when(F.col("transaction_type") == "SALE", F.abs("quantity_change"))



def sales_summary(ledger: DataFrame, *, as_of: datetime, days: int = 30) -> DataFrame:
    """Per key: count, total, mean and sample deviation of the sales, and the last movement."""
    return (
        ledger.filter(F.col("timestamp") >= days_before(midnight(as_of), days))
        .groupBy(*KEY)
        .agg(
            F.count(_sold()).alias("sales_count_30d"),
            F.sum(F.coalesce(_sold(), F.lit(0))).alias("total_sales_30d"),
            F.avg(_sold()).alias("avg_sale_quantity"),
            F.stddev_samp(_sold()).alias("stddev_sale_quantity"),
            F.max("timestamp").alias("last_transaction_date"),
        )
    )


def inventory_snapshot(
    items: DataFrame, ledger: DataFrame, *, as_of: datetime, days: int = 30
) -> DataFrame:
    """What needs action in each warehouse today, for every item that is not discontinued."""
    summary = sales_summary(ledger, as_of=as_of, days=days)
    current = items.filter(stock.not_discontinued()).select(
        *KEY,
        "quantity_on_hand",
        "quantity_reserved",
        "reorder_point",
        "reorder_quantity",
        "unit_cost",
        "last_reorder_date",
        F.col("inventory_status").alias("status"),
        stock.stock_value().alias("inventory_value"),
    )
    joined = current.join(summary, KEY, "left")
    sales = F.col("total_sales_30d")
    return joined.withColumns({
        # before the fill below: NULL sales means "no movements at all"
        "action_required": stock.action_required(sales),
        "daily_velocity": F.coalesce(sales, F.lit(0)) / days,
    }).withColumns({
        "sales_count_30d": F.coalesce("sales_count_30d", F.lit(0)),
        "total_sales_30d": F.coalesce("total_sales_30d", F.lit(0)),
        "avg_sale_quantity": F.coalesce("avg_sale_quantity", F.lit(0.0)),
        "stddev_sale_quantity": F.coalesce("stddev_sale_quantity", F.lit(0.0)),
    })


def daily_snapshot_rows(snapshot: DataFrame, *, snapshot_date: date) -> DataFrame:
    """The snapshot in the shape of the dated snapshot table."""
    return snapshot.select(
        on(snapshot_date).alias("snapshot_date"),
        *KEY,
        "quantity_on_hand",
        "quantity_reserved",
        stock.available().alias("available_quantity"),
        "reorder_point",
        F.col("status").alias("inventory_status"),
        F.col("inventory_value").cast("decimal(20,2)").alias("inventory_value"),
        F.col("daily_velocity").cast("decimal(10,2)").alias("daily_velocity"),
        "action_required",
    )


def snapshot_counts(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(
        F.countDistinct("sku").alias("total_skus"),
        F.countDistinct("warehouse_id").alias("total_warehouses"),
        F.count_if(F.col("action_required") == "STOCKOUT").alias("stockout_count"),
        F.count_if(F.col("action_required") == "NEEDS_REORDER").alias("reorder_count"),
    )


def warehouse_metrics(daily: DataFrame, *, snapshot_date: date) -> DataFrame:
    """Per warehouse, for one date of the snapshot table."""
    return (
        daily.filter(F.col("snapshot_date") == on(snapshot_date))
        .groupBy("warehouse_id")
        .agg(
            F.countDistinct("sku").alias("total_skus"),
            F.count_if(F.col("action_required") == "STOCKOUT").alias("stockout_count"),
            F.count_if(F.col("action_required") == "NEEDS_REORDER").alias("reorder_count"),
            F.sum("inventory_value").alias("total_inventory_value"),
            F.avg("daily_velocity").alias("avg_velocity"),
        )
    )


def movement_stats(items: DataFrame, ledger: DataFrame, *, start: datetime) -> DataFrame:
    """Movements per item since `start`.

    An item without any ledger row is kept with zeros; an item whose rows are all older is
    dropped. The mean counts every movement that is not a sale as 0.
    """
    recent = (F.col("timestamp") >= at(start)) | F.col("timestamp").isNull()
    quantity = F.when(recent, F.coalesce(_sold(), F.lit(0)))
    per_key = ledger.groupBy(*KEY).agg(
        F.count_if(recent).alias("_rows"),
        F.count(F.when(recent, F.col("id"))).alias("transaction_count"),
        F.sum(quantity).alias("total_sales"),
        F.avg(quantity).alias("avg_sale_quantity"),
    )
    return (
        items.select(*KEY)
        .join(per_key, KEY, "left")
        .filter(F.col("_rows").isNull() | (F.col("_rows") > 0))
        .select(
            *KEY,
            F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
            F.coalesce("total_sales", F.lit(0)).alias("total_sales"),
            F.coalesce("avg_sale_quantity", F.lit(0.0)).alias("avg_sale_quantity"),
        )
    )


def dead_stock(items: DataFrame, ledger: DataFrame, *, cutoff: datetime) -> DataFrame:
    """Items with stock, not discontinued, that have not moved since the cutoff."""
    moved = ledger.filter(F.col("timestamp") >= at(cutoff)).select(*KEY).distinct()
    return (
        items.filter((F.col("quantity_on_hand") > 0) & stock.not_discontinued())
        .join(moved, KEY, "left_anti")
        .distinct()
    )


def reconcile_on_hand(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """On hand + restocked - sold, for the items that have movements; others keep theirs."""
    kind = F.col("transaction_type")
    moved = ledger.groupBy(*KEY).agg(
        F.sum(F.when(kind == "RESTOCK", F.col("quantity_change"))).alias("_restocked"),
        F.sum(_sold()).alias("_sold"),
    )
    change = F.coalesce("_restocked", F.lit(0)) - F.coalesce("_sold", F.lit(0))
    return (
        items.join(moved, KEY, "left")
        .withColumn("quantity_on_hand", F.col("quantity_on_hand") + change)
        .drop("_restocked", "_sold")
    )


def seed_movements(
    items: DataFrame, *, per_item: int, kind: str, prefix: str, as_of: datetime
) -> DataFrame:
    """`per_item` movements for every NORMAL item, spread over the 30 days before `as_of`.

    Quantities and times come from the key's hash, so a rerun gives the same rows.
    """
    salt = F.pmod(F.xxhash64(*KEY, "n", F.lit(kind)), F.lit(1_000_000_007))
    sold = kind == "SALE"
    size = (F.pmod(salt, F.lit(11)) + 1) if sold else (F.pmod(salt, F.lit(51)) + 20)
    return (
        items.filter(F.col("inventory_status") == "NORMAL")
        .select(*KEY, F.explode(F.sequence(F.lit(1), F.lit(per_item))).alias("n"))
        .select(
            *KEY,
            "n",
            (-size if sold else size).cast("int").alias("quantity_change"),
            F.lit(kind).alias("transaction_type"),
            (at(as_of) - F.make_dt_interval(secs=F.pmod(salt, F.lit(30 * 86_400)))).alias("timestamp"),
            stock.reference_id(prefix, F.pmod(salt, F.lit(10_000))).alias("reference_id"),
        )
    )
