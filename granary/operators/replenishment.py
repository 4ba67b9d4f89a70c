"""Reorder recommendations, purchase orders and plans from a forecast."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.stock import to_cents
from granary.functions.timing import at
from granary.operators.lookups import low_stock
from granary.schemas import KEY

# Fixed values of the purchase order and of the planning formulas.
SUPPLIER = "SUPPLIER_001"
UNIT_PRICE = 10.0
DELIVERY_DAYS = 7
DEFAULT_ORDER_QUANTITY = 100
LEAD_DAYS = 7
SAFETY_DAYS = 3
ORDERING_COST = 50.0
HOLDING_COST = 0.1
CONFIDENCE = 0.95


def recommendations(items: DataFrame) -> DataFrame:
    """Fill up to twice the reorder point once the stock is at or below it."""
    quantity, point = F.col("quantity_on_hand"), F.col("reorder_point")
    low = quantity <= point
    return items.select(
        *KEY,
        quantity.alias("current_quantity"),
        "reorder_point",
        F.when(low, point * 2 - quantity).otherwise(F.lit(0)).alias("recommended_quantity"),
        F.when(low, "HIGH").otherwise("LOW").alias("priority"),
    )


def purchase_orders(recommended: DataFrame, *, as_of: datetime) -> DataFrame:
    """One pending order per recommendation.

    The order id is a digest of key and day, so running a day again makes the same orders.
    """
    day = as_of.strftime("%Y-%m-%d")
    line = F.struct(
        F.col("sku"),
        F.col("recommended_quantity").alias("quantity"),
        F.lit(UNIT_PRICE).alias("unit_price"),
    )
    return recommended.select(
        F.sha2(F.concat_ws("|", *KEY, F.lit(day)), 256).alias("order_id"),
        F.lit(SUPPLIER).alias("supplier_id"),
        "warehouse_id",
        F.array(line).alias("items"),
        at(as_of).alias("order_date"),
        (at(as_of) + F.expr(f"INTERVAL {DELIVERY_DAYS} DAYS")).alias("expected_delivery_date"),
        F.lit("PENDING").alias("status"),
    )


def auto_reorder(items: DataFrame) -> DataFrame:
    """An order for every low item, by its own reorder quantity or the default."""
    return low_stock(items).select(
        *KEY,
        F.coalesce("reorder_quantity", F.lit(DEFAULT_ORDER_QUANTITY)).alias("quantity"),
        F.lit(True).alias("auto_generated"),
        F.lit("Low stock automation").alias("reason"),
    )


def _along(forecast: DataFrame) -> DataFrame:
    """Position and running demand along each key's horizon (one row per key and day)."""
    by_day = W.partitionBy(*KEY).orderBy("date")
    return forecast.withColumns({
        "_step": F.row_number().over(by_day),
        "_cumulative": F.sum("yhat").over(by_day.rowsBetween(W.unboundedPreceding, 0)),
    })


def _level() -> Column:
    return F.coalesce("current_inventory", F.lit(0))


def _stockout() -> dict[str, Column]:
    """First day the running demand reaches the stock, and how likely it is by its interval."""
    crossed = F.col("_cumulative") >= _level()
    width = F.col("yhat_upper") - F.col("yhat_lower")
    odds = F.when(
        width > 0,
        F.least(F.lit(0.5) + (F.col("_cumulative") - _level()) / width * 0.5, F.lit(1.0)),
    ).otherwise(F.lit(0.0))
    return {
        "stockout_date": F.min(F.when(crossed, F.col("date"))),
        "stockout_probability": F.min_by(odds, F.when(crossed, F.col("_step"))),
    }


def _whole(amount: Column) -> Column:
    """Cut toward zero; 9 decimals first, so that float noise cannot lose a whole unit."""
    exact = F.round(amount, 9)
    return F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact)).cast("int")


def _order() -> dict[str, Column]:
    """Reorder point from lead-time demand and safety stock; the larger of it and the EOQ."""
    step = F.col("_step")
    point = F.sum(F.when(step <= LEAD_DAYS, F.col("yhat"))) + F.sum(
        F.when(step <= SAFETY_DAYS, F.col("yhat_upper"))
    )
    mean = F.greatest(F.avg("yhat"), F.lit(0.0))
    lot = F.sqrt(mean * 2 * 365 * ORDERING_COST / HOLDING_COST)
    return {
        "reorder_point": _whole(point),
        "recommended_order_quantity": F.greatest(_whole(lot), _whole(point)),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def stockouts(forecast: DataFrame, stock: DataFrame) -> DataFrame:
    """The keys whose demand reaches their stock within the horizon: when, and how likely.

    `stock` has the keys and `current_inventory`; a key without stock counts as 0.
    """
    level = stock.select(*KEY, "current_inventory")
    return (
        _along(forecast).join(level, KEY, "left").groupBy(*KEY).agg(*_named(_stockout()))
        .filter(F.col("stockout_date").isNotNull())
    )


def order_plan(forecast: DataFrame) -> DataFrame:
    return _along(forecast).groupBy(*KEY).agg(*_named(_order()))


def replenishment_plan(forecast: DataFrame, stock: DataFrame) -> DataFrame:
    """One row per key: stock, stockout, reorder point and order quantity, in one pass."""
    level = stock.select(*KEY, "current_inventory")
    return (
        _along(forecast)
        .join(level, KEY, "left")
        .groupBy(*KEY)
        .agg(F.max(_level()).alias("current_inventory"), *_named({**_order(), **_stockout()}))
        .withColumns({
            "stockout_probability": to_cents(F.coalesce("stockout_probability", F.lit(0.0))),
            "confidence_level": F.lit(CONFIDENCE),
        })
    )


def with_points(plan: DataFrame, forecast: DataFrame) -> DataFrame:
    """Attach the forecast points, in date order: one per day of the horizon, so short."""
    point = F.struct(
        F.col("date"),
        to_cents(F.col("yhat")).alias("predicted_demand"),
        to_cents(F.col("yhat_lower")).alias("lower_bound"),
        to_cents(F.col("yhat_upper")).alias("upper_bound"),
        to_cents(F.col("trend")).alias("trend"),
        to_cents(F.col("seasonality")).alias("seasonality"),
    )
    points = forecast.groupBy(*KEY).agg(F.sort_array(F.collect_list(point)).alias("predictions"))
    return plan.join(points, KEY, "left")
