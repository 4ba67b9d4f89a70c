"""Velocity, turnover, value and status reports, for every key at once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import stock
from granary.functions.timing import at, days_before
from granary.operators.lookups import active, in_date_range, low_stock
from granary.schemas import KEY


def _kind() -> Column:
    return F.col("transaction_type")


def _moved() -> Column:
    return F.abs("quantity_change")


# Days of each named period; any other name means a month.
PERIOD_DAYS = {"WEEK": 7, "MONTH": 30, "QUARTER": 90}


def _for_keys(result: DataFrame, keys: DataFrame | None) -> DataFrame:
    """All keys of `keys`, also those without a row in `result`."""
    return result if keys is None else keys.select(*KEY).distinct().join(result, KEY, "left")


def velocity(
    ledger: DataFrame, *, as_of: datetime, period_days: int = 30, keys: DataFrame | None = None
) -> DataFrame:
    """Units moved per day: absolute quantities of sales and returns added up."""
    window = in_date_range(ledger, as_of - timedelta(days=period_days), as_of)
    per_key = window.filter(_kind().isin("SALE", "RETURN")).groupBy(*KEY).agg(
        F.sum(_moved()).alias("total_quantity"), F.count(F.lit(1)).alias("transaction_count")
    )
    total = F.coalesce("total_quantity", F.lit(0))
    per_day = total / period_days if period_days > 0 else F.lit(0.0)
    return _for_keys(per_key, keys).select(
        *KEY,
        F.lit(period_days).alias("period_days"),
        total.alias("total_quantity"),
        stock.to_cents(per_day).alias("velocity"),
        F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
        stock.velocity_class(per_day).alias("trend"),
    )


def net_velocity(
    ledger: DataFrame, *, as_of: datetime, period_days: int = 30, keys: DataFrame | None = None
) -> DataFrame:
    """Units per day over 7 and 30 days with returns set off against sales, and the trend."""
    window = in_date_range(ledger, as_of - timedelta(days=30), as_of)
    in_week = F.col("timestamp") >= days_before(as_of, 7)
    per_key = window.filter(_kind().isin("SALE", "RETURN")).groupBy(*KEY).agg(
        F.abs(F.sum(F.when(in_week, F.col("quantity_change")))).alias("_week"),
        F.abs(F.sum("quantity_change")).alias("_month"),
    )
    week = F.coalesce("_week", F.lit(0)) / 7
    month = F.coalesce("_month", F.lit(0)) / 30
    return (
        _for_keys(per_key, keys)
        .select(
            *KEY,
            stock.to_cents(week).alias("velocity_7d"),
            stock.to_cents(month).alias("velocity_30d"),
            stock.to_cents(month * min(period_days, 30)).alias("total_sales"),
            stock.to_cents(month if period_days >= 30 else week).alias("average_daily_sales"),
            F.lit(period_days).alias("period_days"),
        )
        .withColumn(
            "trend_direction", stock.trend_direction(F.col("velocity_7d"), F.col("velocity_30d"))
        )
    )


def period_velocity_net(ledger: DataFrame, *, as_of: datetime, days: int) -> DataFrame:
    """One period of `net_velocity`, unrounded."""
    window = in_date_range(ledger, as_of - timedelta(days=days), as_of)
    return window.filter(_kind().isin("SALE", "RETURN")).groupBy(*KEY).agg(
        (F.abs(F.sum("quantity_change")) / days if days > 0 else F.lit(0.0)).alias("velocity"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


def _sales(ledger: DataFrame, as_of: datetime, days: int) -> DataFrame:
    window = in_date_range(ledger, as_of - timedelta(days=days), as_of)
    return window.filter(_kind() == "SALE").groupBy(*KEY).agg(
        F.sum(_moved()).alias("total_sales"), F.count(F.lit(1)).alias("transaction_count")
    )


def turnover(
    items: DataFrame, ledger: DataFrame, *, as_of: datetime, period_days: int = 30
) -> DataFrame:
    """Sales over stock on hand, and the days one turnover takes."""
    sales = F.coalesce("total_sales", F.lit(0))
    rate = stock.ratio(sales, F.col("quantity_on_hand"))
    days = stock.ratio(F.lit(float(period_days)), rate)
    return (
        items.select(*KEY, "quantity_on_hand")
        .join(_sales(ledger, as_of, period_days), KEY, "left")
        .select(
            *KEY,
            F.lit(period_days).alias("period_days"),
            sales.alias("total_sales"),
            F.col("quantity_on_hand").cast("double").alias("average_inventory"),
            stock.to_cents(rate).alias("turnover_rate"),
            stock.to_cents(days).alias("days_to_turnover"),
        )
    )


def sales_trends(
    ledger: DataFrame, *, as_of: datetime, period: str = "MONTH", keys: DataFrame | None = None
) -> DataFrame:
    days = PERIOD_DAYS.get(period.upper(), PERIOD_DAYS["MONTH"])
    total = F.coalesce("total_sales", F.lit(0))
    count = F.coalesce("transaction_count", F.lit(0))
    mean = F.when(count > 0, F.expr("total_sales div transaction_count")).otherwise(F.lit(0))
    return _for_keys(_sales(ledger, as_of, days), keys).select(
        *KEY,
        F.lit(period).alias("period"),
        F.lit(days).alias("period_days"),
        total.alias("total_sales"),
        count.alias("transaction_count"),
        mean.alias("average_sale_quantity"),
    )


def low_stock_report(items: DataFrame, *, threshold: int | None = None) -> DataFrame:
    """The low items as rows, each with the number of low items.

    The count is a scalar subquery, so no list of items is ever gathered in one place.
    """
    low = low_stock(items, threshold=threshold)
    count = low.agg(F.count(F.lit(1)))
    return low.select(
        F.lit("reorder_point" if threshold is None else str(threshold)).alias("threshold"),
        count.scalar().alias("low_stock_count"),
        *KEY,
        "quantity_on_hand",
        "quantity_reserved",
        stock.available().alias("available_quantity"),
        "reorder_point",
        "inventory_status",
    )


def warehouse_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("warehouse_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(stock.needs_reorder()).alias("low_stock_count"),
        F.count_if(F.col("inventory_status") == "OUT_OF_STOCK").alias("out_of_stock_count"),
        F.sum(stock.stock_value()).alias("total_value"),
    )


def status_summary(items: DataFrame) -> DataFrame:
    """Tidy rows: one per status, then the totals, from a single pass over the items."""
    counts = items.groupBy("inventory_status").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(stock.needs_reorder()).alias("low"),
        F.count_if(stock.is_overstocked()).alias("over"),
    )
    status = F.col("inventory_status")
    # a handful of rows by now: one per status
    return (
        counts.select(
            F.explode(F.array(
                F.struct(
                    F.concat(F.lit("status:"), F.coalesce(status, F.lit("(none)"))).alias("metric"),
                    F.col("items").alias("n"),
                ),
                F.struct(F.lit("total_items").alias("metric"), F.col("items").alias("n")),
                F.struct(F.lit("low_stock_items").alias("metric"), F.col("low").alias("n")),
                F.struct(F.lit("overstock_items").alias("metric"), F.col("over").alias("n")),
            )).alias("row")
        )
        .groupBy(F.col("row.metric").alias("metric"))
        .agg(F.sum("row.n").alias("n"))
    )


def inventory_value(items: DataFrame) -> DataFrame:
    return items.groupBy("warehouse_id").agg(F.sum(stock.stock_value()).alias("total_value"))


def dashboard_stats(
    products: DataFrame, items: DataFrame, warehouses: DataFrame, *, low_threshold: int = 20
) -> DataFrame:
    """One row of headline numbers; the price total assumes ten units of each product."""

    def scalar(df: DataFrame, value: Column) -> Column:
        return df.agg(value).scalar()

    return active(products).agg(
        F.count(F.lit(1)).alias("total_products"),
        F.sum(F.coalesce("price", F.lit(0).cast("decimal(10,2)")) * 10).alias("total_value"),
    ).withColumns({
        "low_stock_items": scalar(low_stock(items, threshold=low_threshold), F.count(F.lit(1))),
        "total_warehouses": scalar(active(warehouses), F.count(F.lit(1))),
    })


def low_stock_alerts(items: DataFrame) -> DataFrame:
    """Items out of stock or at their reorder point, most urgent first."""
    wanted = stock.not_discontinued() & ((F.col("quantity_on_hand") == 0) | stock.needs_reorder())
    urgency = F.when(F.col("priority") == "URGENT", 1).when(F.col("priority") == "HIGH", 2).otherwise(3)
    return (
        items.filter(wanted)
        .select(
            *KEY,
            "quantity_on_hand",
            "quantity_reserved",
            stock.available().alias("available_quantity"),
            "reorder_point",
            "reorder_quantity",
            "inventory_status",
            "unit_cost",
            stock.low_stock_priority().alias("priority"),
        )
        .orderBy(urgency, "warehouse_id", "sku")
    )


def alert_counts(items: DataFrame) -> DataFrame:
    alerts = low_stock_alerts(items)
    return alerts.agg(
        F.count(F.lit(1)).alias("total_low_stock_items"),
        F.count_if(F.col("priority") == "URGENT").alias("urgent_count"),
        F.count_if(F.col("priority") == "HIGH").alias("high_priority_count"),
    )


def alert_summary(items: DataFrame, *, first: int = 10) -> DataFrame:
    """The most urgent items, each with the totals of all alerts."""
    names = ["total_low_stock_items", "urgent_count", "high_priority_count"]
    totals = alert_counts(items).select(F.struct(*names)).scalar()
    # one projection above the sort and limit, so that they stay a top-k
    return low_stock_alerts(items).limit(first).select(
        *KEY,
        "quantity_on_hand",
        "available_quantity",
        "reorder_point",
        "priority",
        *[totals.getField(n).alias(n) for n in names],
    )


def top_moving(velocities: DataFrame, k: int, *, score: str = "velocity") -> DataFrame:
    """The k fastest keys; equal scores in key order."""
    return velocities.orderBy(F.col(score).desc(), *KEY).limit(k)
