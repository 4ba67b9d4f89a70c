"""A made-up demand series with a trend, busy Fridays and Saturdays, and a busy year's end.

Input for tests of the forecaster, where the true pattern must be known.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.timing import on


def synthetic_demand(
    spark: SparkSession, *, skus: int = 5, warehouses: int = 4, days: int = 300, end: date, seed: int = 42
) -> DataFrame:
    """Daily sales per key, the same for the same arguments."""
    n = skus * warehouses * days
    key = F.floor(F.col("id") / days)
    step = (F.col("id") % days).cast("int")
    frame = spark.range(0, n, 1, 1).select(
        F.concat(F.lit("SKU-"), F.lpad((key / warehouses).cast("int").cast("string"), 3, "0")).alias("sku"),
        F.concat(F.lit("WH"), F.lpad((key % warehouses + 1).cast("string"), 3, "0")).alias("warehouse_id"),
        F.date_sub(on(end), F.lit(days - 1) - step).alias("date"),
        step.alias("step"),
        (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(80)) + 20).alias("base"),
        F.randn(seed).alias("noise"),
    )
    weekly = F.when(F.weekday("date").isin(4, 5), 1.2).otherwise(0.9)
    yearly = F.when(F.month("date").isin(11, 12), 1.3).otherwise(1.0)
    level = F.col("base") * (1 + 0.1 * F.col("step") / days) * weekly * yearly
    return frame.select(
        "sku", "warehouse_id", "date",
        F.greatest(F.floor(level + F.col("noise") * F.col("base") * 0.2), F.lit(0)).alias("daily_sales"),
    )
