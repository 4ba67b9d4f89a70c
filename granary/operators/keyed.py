"""Latest-value views per key, as aggregates over the event or ledger history."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import stock
from granary.functions.timing import at
from granary.operators.upsert import latest_per_key
from granary.schemas import KEY

# How long each view stays fresh.
TTL = {
    "inventory_cache": timedelta(minutes=5),
    "inventory_hash": timedelta(minutes=10),
    "default": timedelta(minutes=10),
    "products": timedelta(minutes=30),
    "categories": timedelta(hours=1),
    "warehouses": timedelta(hours=1),
    "velocity": timedelta(hours=1),
    "metrics": timedelta(hours=1),
    "access_count": timedelta(hours=24),
    "events": timedelta(hours=1),
    "low_stock_alert": timedelta(hours=24),
}


def fresh(df: DataFrame, *, as_of: datetime, ttl: timedelta, by: str = "timestamp") -> DataFrame:
    """Rows not yet expired at `as_of`."""
    return df.filter(F.col(by) > at(as_of - ttl))


def latest_inventory(versions: DataFrame, *, order: list[str]) -> DataFrame:
    """Current levels and status per key out of a log of item versions."""
    return latest_per_key(
        versions.select(
            *KEY, *order,
            "quantity_on_hand", "quantity_reserved",
            stock.available().alias("quantity_available"),
            F.col("inventory_status").alias("status"),
        ),
        KEY, order,
    )


def latest_event(events: DataFrame) -> DataFrame:
    """The last event of each key, ties by event id."""
    return latest_per_key(events, KEY, ["timestamp", "event_id"])


def reserved_counter(events: DataFrame) -> DataFrame:
    """Reserved less released, by absolute quantity, for the keys that have either."""
    kind, size = F.col("event_type"), F.abs("quantity_change")
    return (
        events.filter(kind.isin("RESERVED", "RELEASED"))
        .groupBy(*KEY)
        .agg(F.sum(F.when(kind == "RESERVED", size).otherwise(-size)).alias("reserved"))
    )


def low_stock_set(events: DataFrame) -> DataFrame:
    """Keys that were ever reported low, whichever name the producer used."""
    return (
        events.filter(F.col("event_type").isin("LOW_STOCK", "LOW_STOCK_ALERT")).select(*KEY).distinct()
    )


def latest_metrics(metrics: DataFrame, *, ttl: timedelta = TTL["metrics"]) -> DataFrame:
    """The newest metrics of each key and when they expire."""
    seconds = int(ttl.total_seconds())
    newest = latest_per_key(
        metrics.select(*KEY, "processed_at", "velocity_7d", "velocity_30d", "stockout_risk"),
        KEY, ["processed_at"],
    )
    return newest.withColumn(
        "expires_at", F.col("processed_at") + F.expr(f"INTERVAL {seconds} SECONDS")
    )


def velocity_rankings(scores: DataFrame, *, k: int, per_warehouse: bool = False) -> DataFrame:
    """The k highest scores, over all or in each warehouse; equal scores in key order.

    Per warehouse, each task first keeps its own best k rows (Spark cuts the window there), so
    a warehouse with most of the keys does not arrive whole in one task.
    """
    if not per_warehouse:
        return scores.orderBy(F.col("score").desc(), *KEY).limit(k)
    rank = F.row_number().over(
        W.partitionBy("warehouse_id").orderBy(F.col("score").desc(), F.col("sku"))
    )
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Least hashes that a sketch keeps: a standard error of 1 / sqrt(SKETCH - 2).
SKETCH = 1024
#: Hashes lie below 2 ** 60.
_SPAN = float(1 << 60)


def _least(hashes: DataFrame, by: list[str], size: int) -> DataFrame:
    """One sorted array `sketch` per group of its `size` least distinct hashes. Tasks cut to that size before the shuffle."""
    place = F.row_number().over(W.partitionBy(*by).orderBy("hash"))
    few = hashes.select(*by, "hash").distinct().withColumn("_place", place).filter(F.col("_place") <= size)
    return few.groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))


def hot_item_sketches(touched: DataFrame, *, by: str, size: int = SKETCH) -> DataFrame:
    """(by, sketch): the least hashes of each group's skus, to keep and to merge later. The union of sketches, cut to the
    size again, is the sketch of the union."""
    value = F.conv(F.substring(F.md5("sku"), 1, 15), 16, 10).cast("bigint")
    return _least(touched.filter("sku is not null").select(by, value.alias("hash")), [by], size)


def merge_hot_items(sketches: DataFrame, *, size: int = SKETCH) -> DataFrame:
    """One sketch out of many."""
    every = sketches.select(F.lit(0).alias("_all"), F.explode("sketch").alias("hash"))
    return _least(every, ["_all"], size).select("sketch")


def with_estimate(sketches: DataFrame, *, size: int = SKETCH) -> DataFrame:
    """Add `hot_items`, the estimated number of distinct skus, exact below the sketch's size, and `standard_error`, as a
    share of it."""
    full = F.size("sketch") >= size
    estimate = F.lit(float(size - 1)) / (F.element_at("sketch", -1).cast("double") / F.lit(_SPAN))
    return sketches.withColumns({
        "hot_items": F.when(full, estimate).otherwise(F.size("sketch").cast("double")),
        "standard_error": F.when(full, F.lit(1 / (size - 2) ** 0.5)).otherwise(F.lit(0.0)),
    })


def distinct_hot_items(touched: DataFrame, *, size: int = SKETCH) -> DataFrame:
    """(hot_items, standard_error) of all rows, by way of one sketch per warehouse."""
    parts = hot_item_sketches(touched, by="warehouse_id", size=size)
    return with_estimate(merge_hot_items(parts, size=size), size=size).drop("sketch")


def access_counts(
    touched: DataFrame, *, as_of: datetime, ttl: timedelta = TTL["access_count"]
) -> DataFrame:
    return fresh(touched, as_of=as_of, ttl=ttl).groupBy("sku").agg(
        F.count(F.lit(1)).alias("access_count")
    )
