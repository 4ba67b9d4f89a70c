"""Column expressions for stock levels, alerts and replenishment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ON_HAND = "quantity_on_hand"
RESERVED = "quantity_reserved"


def available() -> Column:
    return F.col(ON_HAND) - F.col(RESERVED)


def total_quantity() -> Column:
    return F.col(ON_HAND) + F.col("quantity_in_transit")


def needs_reorder() -> Column:
    return available() <= F.col("reorder_point")


def is_overstocked() -> Column:
    return F.col(ON_HAND) > F.col("reorder_point") * 3


def stock_value() -> Column:
    """Value of the stock on hand; an item without a cost is worth 0."""
    return F.coalesce(F.col("unit_cost"), F.lit(0).cast("decimal(10,2)")) * F.col(ON_HAND)


def not_discontinued() -> Column:
    """SQL inequality: a NULL status does not pass either."""
    return F.col("inventory_status") != "DISCONTINUED"


def derived_status() -> Column:
    return (
        F.when(F.col(ON_HAND) == 0, "OUT_OF_STOCK")
        .when(needs_reorder(), "LOW_STOCK")
        .when(is_overstocked(), "OVERSTOCK")
        .otherwise("NORMAL")
    )


def action_required(sales_30d: Column) -> Column:
    """`sales_30d` must be the joined value before NULLs are filled: an item without any
    ledger row in the window is NORMAL, one with rows but no sale is NO_MOVEMENT."""
    return (
        F.when(F.col(ON_HAND) == 0, "STOCKOUT")
        .when(needs_reorder(), "NEEDS_REORDER")
        .when(sales_30d == 0, "NO_MOVEMENT")
        .otherwise("NORMAL")
    )


def low_stock_priority() -> Column:
    return (
        F.when(F.col(ON_HAND) == 0, "URGENT").when(needs_reorder(), "HIGH").otherwise("NORMAL")
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, or 0 unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def to_cents(value: Column) -> Column:
    """Two decimals: nearest whole number of hundredths, halves up, on the binary product.

    F.round works on the decimal spelling and would make 2.175 (stored as 2.17499…) 2.18.
    """
    return F.floor(value * 100.0 + 0.5) / 100.0


def velocity_class(velocity: Column) -> Column:
    return F.when(velocity > 10, "HIGH").when(velocity > 5, "MEDIUM").otherwise("LOW")


def trend_direction(velocity_7d: Column, velocity_30d: Column) -> Column:
    return (
        F.when(velocity_7d > velocity_30d * 1.1, "increasing")
        .when(velocity_7d < velocity_30d * 0.9, "decreasing")
        .otherwise("stable")
    )


# Weight of each sign of a coming stockout.
FAST_MOVING_WEIGHT = 0.3
VOLATILE_WEIGHT = 0.2
FALLING_WEIGHT = 0.2
SEASONAL_WEIGHT = 0.3
HIGH_RISK = 0.7


def stockout_risk(
    velocity_30d: Column, volatility: Column, trend: Column, seasonality: Column
) -> Column:
    """0 to 1: the weights of the signs that are present, added up."""
    signs = [
        (velocity_30d > 50, FAST_MOVING_WEIGHT),
        (volatility > velocity_30d * 0.5, VOLATILE_WEIGHT),
        (trend < 0, FALLING_WEIGHT),
        (seasonality > 1.5, SEASONAL_WEIGHT),
    ]
    total = F.lit(0.0)
    for sign, weight in signs:
        total = total + F.when(sign, F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(F.least(total, F.lit(1.0)), 6)


def reorder_quantity(velocity: Column, volatility: Column, risk: Column, lead_days: int = 7) -> Column:
    """Demand over the lead time plus safety stock, whole units, never negative."""
    safety = volatility * F.sqrt(F.lit(float(lead_days))) * (F.lit(1.5) + risk)
    # 9 decimals: an exact whole number must not fall below itself through float noise.
    return F.greatest(
        F.floor(F.round(velocity * lead_days + safety, 9)), F.lit(0)
    ).cast("int")


def reference_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.lpad(number.cast("string"), 6, "0"))
