"""Daily and weekly rollups of the ledger."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.timing import at, on
from granary.schemas import KEY


def _midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day)


def _days(ledger: DataFrame, first: date, last: date) -> DataFrame:
    """Rows of whole days, as a range on the raw timestamp so that the scan can skip."""
    ts = F.col("timestamp")
    return ledger.filter((ts >= at(_midnight(first))) & (ts < at(_midnight(last + timedelta(days=1)))))


def daily_rollup(
    ledger: DataFrame, *, first: date | None = None, last: date | None = None
) -> DataFrame:
    """Day x sku x warehouse x type: total moved and number of movements.

    With no dates the whole ledger is rolled up; `first` alone means that single day.
    """
    if first is not None:
        ledger = _days(ledger, first, last or first)
    return ledger.groupBy(
        F.to_date("timestamp").alias("aggregation_date"), *KEY, "transaction_type"
    ).agg(
        F.sum(F.abs("quantity_change")).alias("total_quantity"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


def previous_week(as_of: datetime) -> date:
    """Monday of the week before the one that holds `as_of`."""
    day = as_of.date()
    return day - timedelta(days=day.weekday() + 7)


def weekly_rollup(ledger: DataFrame, *, week_start: date) -> DataFrame:
    """One Monday-to-Sunday week; the daily mean is over the days that had movements."""
    return _weeks(daily_rollup(ledger, first=week_start, last=week_start + timedelta(days=6)))


def weekly_rollup_all(ledger: DataFrame) -> DataFrame:
    """Every week of the ledger, for a first fill of the weekly table."""
    return _weeks(daily_rollup(ledger))


def _weeks(daily: DataFrame) -> DataFrame:
    week = F.date_sub("aggregation_date", F.weekday("aggregation_date"))
    return daily.groupBy(week.alias("week_start_date"), *KEY, "transaction_type").agg(
        F.sum("total_quantity").alias("total_quantity"),
        F.sum("transaction_count").alias("transaction_count"),
        F.avg("total_quantity").alias("avg_daily_quantity"),
    )
