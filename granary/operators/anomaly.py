"""Unusual stock movements: distance from the recent mean in standard deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import with_trailing
from granary.schemas import KEY

# Length of the history and the two thresholds.
HISTORY = 100
HIGH_Z = 3.0
CRITICAL_Z = 5.0

ANOMALY = (
    "id bigint, sku string, warehouse_id string, anomaly_type string, severity string, current_value double, "
    "expected_value double, deviation double, timestamp timestamp_ntz, message string"
)


def severity(z: Column, *, critical: float = CRITICAL_Z) -> Column:
    return F.when(z > critical, "CRITICAL").otherwise("HIGH")


def volume_anomalies(
    ledger: DataFrame,
    *,
    threshold: float = HIGH_Z,
    critical: float = CRITICAL_Z,
    history: int = HISTORY,
    block: int = 50_000,
    slices: int | None = None,
) -> DataFrame:
    """Movements further than `threshold` population deviations from the mean of the last
    `history` movements of their key, the movement itself included."""
    trailing = with_trailing(
        ledger.select("id", *KEY, "quantity_change", "timestamp"),
        KEY,
        ["timestamp", "id"],
        F.col("quantity_change"),
        rows=history,
        block=block,
        slices=slices,
    )
    n, s1, s2 = F.col("_n"), F.col("_s1"), F.col("_s2")
    exact_s1 = s1.cast("decimal(19,0)")
    spread = F.sqrt((n * s2 - exact_s1 * exact_s1).cast("double"))  # n times the deviation
    z = F.when(spread > 0, F.abs(n * F.col("quantity_change") - s1) / spread).otherwise(F.lit(0.0))
    return (
        trailing.withColumn("deviation", z)
        .filter(F.col("deviation") > threshold)
        .select(
            "id",
            *KEY,
            F.lit("VOLUME_ANOMALY").alias("anomaly_type"),
            severity(F.col("deviation"), critical=critical).alias("severity"),
            F.col("quantity_change").cast("double").alias("current_value"),
            (s1 / n).alias("expected_value"),
            "deviation",
            "timestamp",
            F.concat(
                F.lit("Unusual inventory change detected: "), F.col("quantity_change").cast("string")
            ).alias("message"),
        )
    )


def alert_messages(anomalies: DataFrame) -> DataFrame:
    """Text for the critical ones."""
    return anomalies.filter(F.col("severity") == "CRITICAL").select(
        *KEY,
        "timestamp",
        F.concat(
            F.lit("ALERT: "), F.col("anomaly_type"),
            F.lit(" detected for SKU "), F.col("sku"),
            F.lit(" at "), F.col("warehouse_id"),
        ).alias("alert"),
    )
