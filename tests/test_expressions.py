"""Boundaries of the formulas."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from granary.functions import stock, text, timing


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("on_hand", "reserved", "point", "status"),
    [
        (0, 0, 0, "OUT_OF_STOCK"), (0, 0, 9, "OUT_OF_STOCK"), (30, 10, 20, "LOW_STOCK"),
        (31, 10, 20, "NORMAL"), (60, 0, 20, "NORMAL"), (61, 0, 20, "OVERSTOCK"), (61, 50, 20, "LOW_STOCK"),
    ],
)
def test_status_order(spark, on_hand, reserved, point, status):
    got = one(
        spark, stock.derived_status(), quantity_on_hand=("int", on_hand),
        quantity_reserved=("int", reserved), reorder_point=("int", point),
    )
    assert got == status


@pytest.mark.parametrize(
    ("sales", "action"), [(None, "NORMAL"), (0, "NO_MOVEMENT"), (1, "NORMAL")]
)
def test_no_movement_needs_rows(spark, sales, action):
    got = one(
        spark, stock.action_required(F.col("s")), s=("int", sales), quantity_on_hand=("int", 50),
        quantity_reserved=("int", 0), reorder_point=("int", 5),
    )
    assert got == action


@pytest.mark.parametrize(
    ("v30", "volatility", "trend", "season", "risk"),
    [
        (50.0, 25.0, 0.0, 1.5, 0.0), (50.1, 0.0, 0.0, 1.0, 0.3), (10.0, 5.1, 0.0, 1.0, 0.2),
        (10.0, 0.0, -0.1, 1.0, 0.2), (10.0, 0.0, 0.0, 1.51, 0.3), (60.0, 40.0, -1.0, 2.0, 1.0),
        (60.0, 40.0, -1.0, 1.0, 0.7),
    ],
)
def test_risk_thresholds(spark, v30, volatility, trend, season, risk):
    got = one(
        spark, stock.stockout_risk(F.col("a"), F.col("b"), F.col("c"), F.col("d")),
        a=("double", v30), b=("double", volatility), c=("double", trend), d=("double", season),
    )
    assert got == pytest.approx(risk)


def test_reorder_quantity_cuts_and_never_negative(spark):
    def quantity(v, s, r):
        return one(
            spark, stock.reorder_quantity(F.col("v"), F.col("s"), F.col("r")),
            v=("double", v), s=("double", s), r=("double", r),
        )

    assert quantity(10.0, 0.0, 0.0) == 70
    assert quantity(10.0, 2.0, 0.5) == int(70 + 2 * 7**0.5 * 2.0)
    assert quantity(-10.0, 0.0, 0.0) == 0


@pytest.mark.parametrize(("v", "name"), [(10.0, "MEDIUM"), (10.01, "HIGH"), (5.0, "LOW"), (5.01, "MEDIUM")])
def test_velocity_class(spark, v, name):
    assert one(spark, stock.velocity_class(F.col("v")), v=("double", v)) == name


@pytest.mark.parametrize(
    ("v7", "v30", "name"), [(1.1, 1.0, "stable"), (1.2, 1.0, "increasing"), (0.89, 1.0, "decreasing"), (0.0, 0.0, "stable")]
)
def test_trend_direction(spark, v7, v30, name):
    got = one(spark, stock.trend_direction(F.col("a"), F.col("b")), a=("double", v7), b=("double", v30))
    assert got == name


def test_like_has_wildcards_and_contains_has_none(spark):
    names = spark.createDataFrame([("a_b",), ("axb",), (None,)], "name string")
    assert names.filter(text.matches_any("A_B", "name")).count() == 2
    assert names.filter(text.contains_any("A_B", "name")).count() == 1


@pytest.mark.parametrize(
    ("value", "hour"),
    [("2024-01-01T10:00:00", 10), ("2024-01-01T10:00:00Z", 10), ("2024-01-01T10:00:00+02:00", 8), ("soon", None)],
)
def test_wall_clock_in_any_session_zone(spark, value, hour):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = one(spark, timing.utc_wall_clock("t"), t=("string", value))
            assert got == (None if hour is None else datetime(2024, 1, 1, hour))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_instants_round_trip_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            # an hour that New York skips
            row = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.000123' AS t")
            back = row.select(timing.as_instant("t").alias("i")).select(timing.as_wall_clock("i"))
            assert back.first()[0] == datetime(2024, 3, 10, 2, 30, 0, 123)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sunday(spark):
    sunday = spark.sql("SELECT DATE '2024-01-07' AS d")
    assert sunday.select(timing.sunday_first_dow(F.col("d"))).first()[0] == 0
    parts = timing.hour_dow_weekend(F.col("d").cast("timestamp_ntz"))
    assert tuple(sunday.select(*parts.values()).first()) == (0, 6, True)
