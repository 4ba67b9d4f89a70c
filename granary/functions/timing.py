"""Time literals and calendar expressions on zone-less timestamps."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(moment: datetime) -> Column:
    """A zone-less timestamp literal; folds to a constant, so it reaches the scan."""
    return F.lit(moment.isoformat(" ", "microseconds")).cast("timestamp_ntz")


def on(day: date) -> Column:
    return F.lit(day.strftime("%Y-%m-%d")).cast("date")


def days_before(moment: datetime, days: int) -> Column:
    return at(moment - timedelta(days=days))


def midnight(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def utc_wall_clock(text: str) -> Column:
    """ISO-8601 text to a zone-less UTC timestamp; NULL when it cannot be read.

    Text with an offset is an instant and is moved to UTC; text without one is taken as is.
    """
    zoned = F.col(text).rlike(r"(Z|[+-]\d\d:?\d\d)$")
    instant = F.expr(
        "convert_timezone(current_timezone(), 'UTC', "
        f"CAST(try_cast(`{text}` AS TIMESTAMP) AS TIMESTAMP_NTZ))"
    )
    return F.when(zoned, instant).otherwise(F.expr(f"try_cast(`{text}` AS TIMESTAMP_NTZ)"))


def sunday_first_dow(day: Column) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(day) - 1


def hour_dow_weekend(ts: Column) -> dict[str, Column]:
    """Hour, day of week with Monday = 0, and whether it is Saturday or Sunday."""
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "is_weekend": F.weekday(ts) >= 5,
    }


def on_circle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a cyclic value."""
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


# Watermarks and windows need an instant; wall clocks here are UTC. Adding the distance from
# the epoch is exact in any session time zone, which a cast would not be.
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_EPOCH_INSTANT = "TIMESTAMP '1970-01-01 00:00:00Z'"


def as_instant(wall_clock: str) -> Column:
    return F.expr(f"{_EPOCH_INSTANT} + (`{wall_clock}` - {_EPOCH})")


def as_wall_clock(instant: str) -> Column:
    return F.expr(f"{_EPOCH} + ({instant} - {_EPOCH_INSTANT})")
