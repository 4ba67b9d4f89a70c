"""Daily series per (sku, warehouse) and the windows over them.

The ledger is first summed to one row per key and day, with map-side combine. A key then
has at most one row per day of history, so a window over a key is small whatever
share of the ledger the key holds.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from granary.functions import stock
from granary.functions.timing import days_before, on_circle, sunday_first_dow
from granary.schemas import KEY
from granary.session import materialized


def _moved(kind: str) -> Column:
    return F.sum(F.when(F.col("transaction_type") == kind, F.abs("quantity_change")).otherwise(F.lit(0)))


def by_day() -> WindowSpec:
    return W.partitionBy(*KEY).orderBy("date")


def latest_first() -> WindowSpec:
    return W.partitionBy(*KEY).orderBy(F.col("date").desc())


def daily_sales(ledger: DataFrame, *, as_of: datetime, days: int = 90) -> DataFrame:
    """Units sold and number of movements per key and active day."""
    return (
        ledger.filter(F.col("timestamp") >= days_before(as_of, days))
        .groupBy(*KEY, F.to_date("timestamp").alias("date"))
        .agg(_moved("SALE").alias("daily_sales"), F.count(F.lit(1)).alias("transaction_count"))
    )


def daily_net_demand(ledger: DataFrame) -> DataFrame:
    """Sales less returns per key and day, as a positive number, with the day as text."""
    return (
        ledger.filter(F.col("transaction_type").isin("SALE", "RETURN"))
        .groupBy(*KEY, F.to_date("timestamp").alias("day"))
        .agg(
            F.abs(F.sum("quantity_change")).alias("demand"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
        .withColumn("day", F.col("day").cast("string"))  # after the sums: one per day, not per row
    )


# -- demand features of the stream job -------------------------------------------------


def demand_features(history: DataFrame) -> DataFrame:
    """Velocity, volatility, trend and seasonality from the active days of each key."""
    ranked = history.withColumn("_back", F.row_number().over(latest_first()))
    sales, back = F.col("daily_sales"), F.col("_back")
    means = ranked.groupBy(*KEY).agg(
        F.count(sales).alias("_days"),
        F.avg(F.when(back <= 7, sales)).alias("velocity_7d"),
        F.avg(F.when(back <= 30, sales)).alias("velocity_30d"),
        F.stddev_samp(sales).alias("_deviation"),
        F.regr_slope(sales, -back).alias("_slope"),
    )
    days, v7, v30 = F.col("_days"), F.col("velocity_7d"), F.col("velocity_30d")
    return means.select(
        *KEY,
        "velocity_7d",
        "velocity_30d",
        F.when(days > 1, F.col("_deviation")).otherwise(F.lit(0.0)).alias("volatility"),
        F.when(days > 7, F.col("_slope")).otherwise(F.lit(0.0)).alias("trend"),
        F.when((days > 30) & (v30 > 0), v7 / v30).otherwise(F.lit(1.0)).alias("seasonality_index"),
    )


def with_risk_and_reorder(features: DataFrame) -> DataFrame:
    f = F.col
    # rounded before the comparisons, so that float noise around a threshold cannot flip one
    r = {c: F.round(f(c), 9) for c in ("velocity_30d", "volatility", "trend", "seasonality_index")}
    return features.withColumn("stockout_risk", stock.stockout_risk(**{
        "velocity_30d": r["velocity_30d"],
        "volatility": r["volatility"],
        "trend": r["trend"],
        "seasonality": r["seasonality_index"],
    })).withColumn(
        "reorder_recommendation",
        stock.reorder_quantity(f("velocity_30d"), f("volatility"), f("stockout_risk")),
    )


def processed_metrics(
    touched: DataFrame, ledger: DataFrame, *, as_of: datetime, days: int = 90
) -> DataFrame:
    """Metrics of every touched key, one row each; a key without history gets the defaults.

    The ledger is summed to days before it meets the keys, so no key brings its movements to the join.
    """
    return metrics_from_days(touched, daily_sales(ledger, as_of=as_of, days=days))


def metrics_from_days(touched: DataFrame, daily: DataFrame) -> DataFrame:
    """`processed_metrics` out of the days of `daily_sales`."""
    features = demand_features(touched.select(*KEY).distinct().join(daily, KEY, "left"))
    filled = features.fillna(
        {"velocity_7d": 0.0, "velocity_30d": 0.0, "volatility": 0.0, "trend": 0.0,
         "seasonality_index": 1.0}
    )
    return with_risk_and_reorder(filled)


def high_risk_alerts(metrics: DataFrame, *, above: float = stock.HIGH_RISK) -> DataFrame:
    return metrics.filter(F.col("stockout_risk") > above).select(
        F.lit("HIGH_STOCKOUT_RISK").alias("type"),
        *KEY,
        F.col("stockout_risk").alias("risk_score"),
        F.col("reorder_recommendation").alias("recommended_reorder"),
        "velocity_30d",
        "volatility",
    )


# -- training features -------------------------------------------------------------------


def training_daily(
    ledger: DataFrame, items: DataFrame, *, as_of: datetime, days: int = 365
) -> DataFrame:
    """One row per key and day with the item's levels; keys without an item are left out."""
    daily = (
        ledger.filter(F.col("timestamp") >= days_before(as_of, days))
        .groupBy(*KEY, F.to_date("timestamp").alias("date"))
        .agg(
            _moved("SALE").alias("daily_sales"),
            _moved("RESTOCK").alias("daily_receipts"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
    )
    levels = items.select(
        *KEY, "reorder_point", "unit_cost", F.col("quantity_on_hand").cast("double").alias("avg_inventory")
    )
    return daily.join(levels, KEY, "inner").withColumns({
        "day_of_week": sunday_first_dow(F.col("date")),
        "month": F.month("date"),
    })


def with_lags(daily: DataFrame, lags: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    return daily.withColumns(
        {f"sales_lag_{n}": F.lag("daily_sales", n).over(by_day()) for n in lags}
    )


def with_moving_stats(daily: DataFrame, *, short: int = 8, long: int = 31) -> DataFrame:
    """Means over `short` and `long` rows and the deviation over `long`, current row included.

    The columns are named for 7 and 30 rows *before* the current one, hence 8 and 31.
    """
    near, far = by_day().rowsBetween(1 - short, 0), by_day().rowsBetween(1 - long, 0)
    return daily.withColumns({
        "sales_ma_7": F.avg("daily_sales").over(near),
        "sales_ma_30": F.avg("daily_sales").over(far),
        "sales_std_30": F.stddev_samp("daily_sales").over(far),
    })


def training_frame(
    ledger: DataFrame, items: DataFrame, *, as_of: datetime, days: int = 365, keep_days: int = 300
) -> DataFrame:
    """Daily rows with lags and moving statistics; the first days only feed the windows."""
    daily = training_daily(ledger, items, as_of=as_of, days=days)
    return with_moving_stats(with_lags(daily)).filter(
        F.col("date") >= days_before(as_of, keep_days)
    )


def with_cycles(daily: DataFrame) -> DataFrame:
    day_sin, day_cos = on_circle(F.col("day_of_week"), 7)
    month_sin, month_cos = on_circle(F.col("month"), 12)
    return daily.withColumns(
        {"day_sin": day_sin, "day_cos": day_cos, "month_sin": month_sin, "month_cos": month_cos}
    )


def with_stock_ratios(frame: DataFrame) -> DataFrame:
    """Ratios against demand; every denominator is one more than its column."""
    f, cost = F.col, F.col("unit_cost").cast("double")
    return frame.withColumns({
        "inventory_ratio": f("avg_inventory") / (f("sales_ma_7") + 1),
        "stockout_risk": (f("reorder_point") - f("avg_inventory")) / (f("sales_ma_7") + 1),
        "value_per_transaction": f("daily_sales") * cost / (f("transaction_count") + 1),
        "cv_30": f("sales_std_30") / (f("sales_ma_30") + 1),
        "velocity_value": f("sales_ma_7") * cost,
    })


def with_next_day_target(frame: DataFrame) -> DataFrame:
    """Sales of the key's next active day; the last row of a key has none and is dropped."""
    return frame.withColumn("target", F.lead("daily_sales", 1).over(by_day())).filter(
        F.col("target").isNotNull()
    )


# -- feature store ------------------------------------------------------------------------


def velocity_features(frame: DataFrame) -> DataFrame:
    week = by_day().rowsBetween(-6, 0)
    before = F.lag("sales_ma_7", 7).over(by_day())
    full_week = F.count("daily_sales").over(week) == 7
    return frame.withColumns({
        "velocity_1d": F.col("daily_sales"),
        "velocity_7d_ma": F.coalesce("sales_ma_7", F.lit(0.0)),
        "velocity_30d_ma": F.coalesce("sales_ma_30", F.lit(0.0)),
        "velocity_trend_7d": F.coalesce((F.col("sales_ma_7") - before) / (before + 1), F.lit(0.0)),
        "velocity_std_7d": F.coalesce(
            F.when(full_week, F.stddev_samp("daily_sales").over(week)), F.lit(0.0)
        ),
    })


def group_means(frame: DataFrame) -> DataFrame:
    """Mean sales of the key, of its weekday and of its month, on every row."""
    sales = F.avg("daily_sales")
    return frame.withColumns({
        "dow_mean": sales.over(W.partitionBy(*KEY, "day_of_week")),
        "month_mean": sales.over(W.partitionBy(*KEY, "month")),
        "overall_mean": sales.over(W.partitionBy(*KEY)),
    })


def seasonality_features(frame: DataFrame) -> DataFrame:
    overall = F.col("overall_mean") + 1
    return group_means(frame).withColumns({
        "dow_seasonality_index": F.col("dow_mean") / overall,
        "month_seasonality_index": F.col("month_mean") / overall,
        "days_to_holiday": F.lit(30),  # fixed value
    }).drop("dow_mean", "month_mean", "overall_mean")


def inventory_health(frame: DataFrame) -> DataFrame:
    supply = F.col("avg_inventory") / (F.col("sales_ma_7") + 1)
    return frame.withColumns({
        "days_of_supply": supply,
        "stockout_probability": F.lit(1.0) / (F.lit(1.0) + F.exp(supply - 7)),
        "overstock_flag": (supply > 60).cast("int"),
        "inventory_turnover": F.col("sales_ma_30") * 365 / (F.col("avg_inventory") + 1),
    })


FEATURE_STORE_COLUMNS = [
    "velocity_1d", "velocity_7d_ma", "velocity_30d_ma", "velocity_trend_7d", "velocity_std_7d",
    "dow_seasonality_index", "month_seasonality_index", "days_to_holiday",
    "days_of_supply", "stockout_probability", "overstock_flag", "inventory_turnover",
]


def with_features(frame: DataFrame) -> DataFrame:
    """A training frame with all features added."""
    return inventory_health(seasonality_features(velocity_features(frame)))


def feature_store(frame: DataFrame) -> DataFrame:
    """All features of a training frame, keyed by sku, warehouse and date."""
    return with_features(frame).select(*KEY, "date", *FEATURE_STORE_COLUMNS)


def feature_metadata(features: DataFrame, columns: list[str]) -> DataFrame:
    """Type, share of NULLs and number of distinct values of each column.

    Missing values are counted in one pass without a shuffle of rows. Distinct ones take a pass per column: all in one
    aggregate would turn every row into one for each column before the shuffle.
    """
    features = materialized(features.select(*columns))
    types = dict(features.dtypes)
    missing = features.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cell = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(types[c]).alias("data_type"), F.col(c).alias("missing")) for c in columns
    ])).alias("cell")
    different = [features.agg(F.lit(c).alias("feature"), F.count_distinct(c).alias("unique_values")) for c in columns]
    return missing.select("_rows", cell).select("_rows", "cell.*").join(reduce(DataFrame.unionAll, different), "feature").select(
        "feature", (F.col("missing") * 100.0 / F.col("_rows")).alias("null_percentage"), "unique_values", "data_type",
    )


def seasonality_strength(daily: DataFrame, *, value: str, day: str, period: int = 7) -> DataFrame:
    """Raw autocorrelation at one lag over that at lag 0; above 0.3 counts as seasonal.

    A key with fewer than two periods is not tested: not detected, no strength.
    """
    y = F.col(value).cast("double")
    lagged = daily.withColumn(
        "_lagged", F.lag(y, period).over(W.partitionBy(*KEY).orderBy(day))
    )
    sums = lagged.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(y * F.col("_lagged")).alias("_at_lag"),
        F.sum(y * y).alias("_at_zero"),
    )
    strength = F.when(
        F.col("_n") >= 2 * period,
        F.when(F.col("_at_zero") > 0, F.col("_at_lag") / F.col("_at_zero")).otherwise(F.lit(0.0)),
    )
    return sums.select(
        *KEY,
        F.coalesce(strength > 0.3, F.lit(False)).alias("detected"),
        strength.alias("strength"),
        F.lit(period).alias("period"),
    )
