"""Semantics that the given tables do not reach: NULLs, empty sides, boundaries, reruns."""

from __future__ import annotations

import glob
import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators import (
    anomaly, catalog, events, keyed, lookups, quality, replenishment, reports, rollups, series, snapshot, upsert,
)
from granary.schemas import KEY
from granary.session import fresh_dir
from granary.sources import sinks, tables
from tests.conftest import as_set

NOW = datetime(2024, 1, 31)


# -- snapshot -------------------------------------------------------------------------------


def test_snapshot_actions(spark, items, ledger):
    stock = items(
        {"sku": "EMPTY", "quantity_on_hand": 0},
        {"sku": "LOW", "quantity_on_hand": 30},
        {"sku": "QUIET"}, {"sku": "SOLD"}, {"sku": "UNSEEN"},
        {"sku": "GONE", "inventory_status": "DISCONTINUED"}, {"sku": "BLANK", "inventory_status": None},
    )
    log = ledger([
        (1, "QUIET", "W1", 5, "RESTOCK", "2024-01-20"), (2, "SOLD", "W1", -60, "SALE", "2024-01-20"),
        (3, "SOLD", "W1", -30, "SALE", "2024-01-01T00:00:00"), (4, "SOLD", "W1", -99, "SALE", "2023-12-31T23:59:59"),
    ])
    got = snapshot.inventory_snapshot(stock, log, as_of=NOW)
    assert dict(got.select("sku", "action_required").collect()) == {
        "EMPTY": "STOCKOUT", "LOW": "NEEDS_REORDER", "QUIET": "NO_MOVEMENT", "SOLD": "NORMAL", "UNSEEN": "NORMAL",
    }
    sold = got.filter("sku = 'SOLD'").first()
    assert (sold.sales_count_30d, sold.total_sales_30d, sold.daily_velocity) == (2, 90, 3.0)
    assert sold.stddev_sale_quantity == pytest.approx(21.2132, abs=1e-4)


def test_movement_stats_keeps_untouched_and_drops_old(spark, items, ledger):
    stock = items({"sku": "NONE"}, {"sku": "OLD"}, {"sku": "NEW"}, {"sku": "BOTH"}, {"sku": "TIMELESS"})
    log = ledger([
        (1, "OLD", "W1", -5, "SALE", "2024-01-01"), (2, "NEW", "W1", -4, "SALE", "2024-01-25"),
        (3, "NEW", "W1", 9, "RESTOCK", "2024-01-26"), (4, "BOTH", "W1", -3, "SALE", "2024-01-01"),
        (5, "BOTH", "W1", -6, "SALE", "2024-01-25"), (6, "TIMELESS", "W1", -2, "SALE", None),
    ])
    got = snapshot.movement_stats(stock, log, start=datetime(2024, 1, 20))
    assert as_set(got, "sku", "transaction_count", "total_sales", "avg_sale_quantity") == {
        ("NONE", 0, 0, 0.0), ("NEW", 2, 4, 2.0), ("BOTH", 1, 6, 6.0), ("TIMELESS", 1, 2, 2.0),
    }


def test_dead_stock(spark, items, ledger):
    stock = items(
        {"sku": "IDLE"}, {"sku": "BUSY"}, {"sku": "EMPTY", "quantity_on_hand": 0},
        {"sku": "GONE", "inventory_status": "DISCONTINUED"}, {"sku": "BLANK", "inventory_status": None},
    )
    log = ledger([(1, "BUSY", "W1", -1, "SALE", "2024-01-28"), (2, "IDLE", "W1", -1, "SALE", "2024-01-27T23:59:59")])
    assert as_set(snapshot.dead_stock(stock, log, cutoff=datetime(2024, 1, 28)), "sku") == {("IDLE",)}


def test_seed_is_the_same_again(spark, items):
    def make():
        return as_set(
            snapshot.seed_movements(items({}), per_item=5, kind="SALE", prefix="ORDER", as_of=NOW),
            "n", "quantity_change", "timestamp", "reference_id",
        )

    rows = make()
    assert rows == make() and len(rows) == 5
    for _, q, t, ref in rows:
        assert -11 <= q <= -1 and NOW - timedelta(days=30) < t <= NOW and len(ref) == len("ORDER-000000")


# -- rollups --------------------------------------------------------------------------------


def test_week_is_monday_to_sunday_and_mean_over_active_days(ledger):
    log = ledger([
        (1, "A", "W", -5, "SALE", "2024-01-21T23:59:59"), (2, "A", "W", -6, "SALE", "2024-01-22"),
        (3, "A", "W", -2, "SALE", "2024-01-22T10:00:00"), (4, "A", "W", -4, "SALE", "2024-01-28T23:59:59.999999"),
        (5, "A", "W", -7, "SALE", "2024-01-29"),
    ])
    assert rollups.previous_week(NOW) == date(2024, 1, 22)
    row = rollups.weekly_rollup(log, week_start=date(2024, 1, 22)).first()
    assert (row.total_quantity, row.transaction_count, row.avg_daily_quantity) == (12, 3, 6.0)
    every = rollups.weekly_rollup_all(log)
    assert as_set(every, "week_start_date", "total_quantity") == {
        (date(2024, 1, 15), 5), (date(2024, 1, 22), 12), (date(2024, 1, 29), 7),
    }


# -- reports --------------------------------------------------------------------------------


def test_halves_round_on_the_stored_value(spark, items, ledger):
    stock = items({"quantity_on_hand": 40})
    log = ledger([(1, "AAA", "W1", -87, "SALE", "2024-01-20")])
    assert reports.turnover(stock, log, as_of=NOW).first().turnover_rate == 2.17  # 2.175 is stored below


def test_returns_add_or_set_off(spark, items, ledger):
    log = ledger([(1, "AAA", "W1", -90, "SALE", "2024-01-20"), (2, "AAA", "W1", 30, "RETURN", "2024-01-21")])
    assert reports.velocity(log, as_of=NOW).first().velocity == 4.0
    assert reports.net_velocity(log, as_of=NOW).first().velocity_30d == 2.0


def test_keys_without_movements_get_zeros(spark, items, ledger):
    log = ledger([])
    row = reports.velocity(log, as_of=NOW, keys=items({})).first()
    assert (row.total_quantity, row.velocity, row.transaction_count, row.trend) == (0, 0.0, 0, "LOW")
    assert reports.turnover(items({}), log, as_of=NOW).first().days_to_turnover == 0.0
    assert reports.sales_trends(log, as_of=NOW, period="year", keys=items({})).first().period_days == 30


def test_warehouse_summary_and_value(items):
    stock = items(
        {"sku": "A", "quantity_on_hand": 2, "unit_cost": __import__("decimal").Decimal("1.25")},
        {"sku": "B", "inventory_status": "OUT_OF_STOCK"},
    )
    row = reports.warehouse_summary(stock).first()
    assert (row.total_items, row.low_stock_count, row.out_of_stock_count, float(row.total_value)) == (2, 1, 1, 2.5)


def test_low_stock_report_counts_whole_list(items):
    stock = items(*[{"sku": f"S{i}", "quantity_on_hand": i} for i in range(50)])
    got = reports.low_stock_report(stock, threshold=10)
    assert as_set(got, "low_stock_count", "threshold") == {(21, "10")} and got.count() == 21


# -- series ---------------------------------------------------------------------------------


def history(ledger, days, sales=lambda n: n):
    first = NOW - timedelta(days=days)
    rows = [(n, "A", "W", -sales(n), "SALE", (first + timedelta(days=n)).isoformat()) for n in range(days)]
    return series.daily_sales(ledger(rows), as_of=NOW)


@pytest.mark.parametrize(
    ("days", "trend", "season"), [(1, 0.0, 1.0), (7, 0.0, 1.0), (8, 1.0, 1.0), (30, 1.0, 1.0), (31, 1.0, 27 / 15.5)]
)
def test_branches_by_length_of_history(ledger, days, trend, season):
    row = series.demand_features(history(ledger, days)).first()
    assert row.trend == pytest.approx(trend)
    assert row.seasonality_index == pytest.approx(season)
    assert (row.volatility == 0.0) == (days == 1)
    assert row.velocity_7d == pytest.approx(sum(range(days)[-7:]) / min(days, 7))


def test_metrics_of_keys_without_history(spark, ledger):
    touched = spark.createDataFrame([("A", "W"), ("A", "W"), ("B", "W")], "sku string, warehouse_id string")
    log = ledger([(1, "A", "W", -5, "SALE", "2024-01-30"), (2, "C", "W", -5, "SALE", "2024-01-30")])
    got = series.processed_metrics(touched, log, as_of=NOW)
    assert as_set(got, "sku", "velocity_30d", "seasonality_index", "stockout_risk", "reorder_recommendation") == {
        ("A", 5.0, 1.0, 0.0, 35), ("B", 0.0, 1.0, 0.0, 0),
    }


def test_moving_mean_has_eight_rows(ledger):
    rows = series.with_moving_stats(history(ledger, 20)).orderBy("date").collect()
    assert rows[-1].sales_ma_7 == pytest.approx(sum(range(12, 20)) / 8)
    assert rows[0].sales_std_30 is None


def test_features_do_not_leak_across_keys(spark, ledger):
    rows = [
        (n, s, "W", -q, "SALE", (datetime(2024, 1, 1) + timedelta(days=n)).isoformat())
        for s, q in (("A", 1), ("B", 100)) for n in range(10)
    ]
    frame = series.with_moving_stats(series.daily_sales(ledger(rows), as_of=NOW)).withColumns(
        {"avg_inventory": F.lit(1.0), "day_of_week": F.lit(0), "month": F.lit(1)}
    )
    got = series.feature_store(frame)
    assert as_set(got, "velocity_trend_7d") == {(0.0,)}
    assert got.filter("velocity_std_7d <> 0").count() == 0


def test_seasonality_needs_two_periods(spark):
    def strength(values):
        rows = [("A", "W", date(2024, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "sku string, warehouse_id string, day date, y double")
        return tuple(series.seasonality_strength(df, value="y", day="day").first()[2:4])

    assert strength([1] * 13) == (False, None)
    assert strength([1] * 14) == (True, 0.5)
    assert strength([0] * 14) == (False, 0.0)


def test_metadata_counts_nulls_and_values(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (3, 2.0), (4, None)], "a int, b double")
    got = series.feature_metadata(df, ["a", "b"])
    assert as_set(got, "feature", "null_percentage", "unique_values", "data_type") == {
        ("a", 0.0, 3, "int"), ("b", 50.0, 1, "double"),
    }


# -- anomalies ------------------------------------------------------------------------------


def spike(ledger, quiet, value):
    rows = [(n, "A", "W", 10, "SALE", (datetime(2024, 1, 1) + timedelta(hours=n)).isoformat()) for n in range(quiet)]
    return ledger([*rows, (quiet, "A", "W", value, "SALE", "2024-01-30")])


@pytest.mark.parametrize(("quiet", "severity"), [(9, None), (10, "HIGH"), (25, "HIGH"), (26, "CRITICAL")])
def test_one_spike_in_a_flat_history(ledger, quiet, severity):
    # one value among n equal ones is sqrt(n) deviations away
    got = [r.severity for r in anomaly.volume_anomalies(spike(ledger, quiet, 500)).collect()]
    assert got == ([severity] if severity else [])


def test_flat_history_has_no_deviation(ledger):
    assert anomaly.volume_anomalies(spike(ledger, 50, 10)).count() == 0
    found = anomaly.volume_anomalies(spike(ledger, 50, -500))
    assert anomaly.alert_messages(found).first().alert == "ALERT: VOLUME_ANOMALY detected for SKU A at W"


# -- events ---------------------------------------------------------------------------------


def test_malformed_events_are_set_apart(spark):
    lines = ['{"sku":"A","warehouseId":"W","quantity":3,"id":7}', "{oops", "", "[1]",
             '{"sku":"A","timestamp":"soon"}', '{"sku":"A","eventType":"SOLD","timestamp":"2024-01-02T03:04:05Z"}']
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = events.split_malformed(events.parse_events(raw, received_at=NOW))
    assert as_set(good, "event_id", "warehouse_id", "quantity_change", "event_type", "timestamp") == {
        ("7", "W", 3, "UNKNOWN", NOW), ("", "", 0, "SOLD", datetime(2024, 1, 2, 3, 4, 5)),
    }
    assert as_set(bad, "value") == {("{oops",), ("",), ("[1]",), ('{"sku":"A","timestamp":"soon"}',)}


def test_indexed_at_is_kept_where_present(spark):
    df = spark.createDataFrame(
        [("RESERVED", datetime(2020, 1, 1)), ("whatever", None)], "event_type string, indexed_at timestamp_ntz"
    )
    got = events.with_index_name(df, indexed_at=F.lit(NOW.isoformat()).cast("timestamp_ntz"))
    assert as_set(got, "index_name", "indexed_at") == {
        ("inventory-reservations", datetime(2020, 1, 1)), ("inventory-events", NOW),
    }


# -- keyed views ----------------------------------------------------------------------------


def test_latest_prefers_the_later_id_on_a_tie(spark):
    rows = [("A", "W", datetime(2024, 1, 1), 1, "x"), ("A", "W", datetime(2024, 1, 1), 2, None)]
    df = spark.createDataFrame(rows, "sku string, warehouse_id string, at timestamp_ntz, id long, v string")
    assert upsert.latest_per_key(df, KEY, ["at", "id"]).first().v is None


def test_expiry_is_open_at_the_old_end(spark):
    df = spark.createDataFrame([(NOW - timedelta(hours=1),), (NOW - timedelta(minutes=59),)], "timestamp timestamp_ntz")
    assert keyed.fresh(df, as_of=NOW, ttl=keyed.TTL["metrics"]).count() == 1


def test_distinct_estimates_are_close_and_merge(spark):
    df = spark.range(100_000).select(
        F.concat(F.lit("S"), F.col("id") % 20_000).alias("sku"), (F.col("id") % 7).alias("day"),
        F.concat(F.lit("W"), F.col("id") % 3).alias("warehouse_id"),
    )
    got = keyed.distinct_hot_items(df).first()
    assert got.hot_items == pytest.approx(20_000, rel=3 * got.standard_error) and got.standard_error < 0.04
    merged = keyed.with_estimate(keyed.merge_hot_items(keyed.hot_item_sketches(df, by="day"))).first()
    assert merged.hot_items == got.hot_items


# -- upserts --------------------------------------------------------------------------------


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, a string, b string")


def test_upsert_can_set_null_and_keep_columns(spark):
    old = table(spark, (1, "x", "p"), (2, "y", "q"))
    new = table(spark, (2, None, "r"), (3, "z", "s"))
    assert as_set(upsert.upsert(old, new, ["k"], update=["a"]), "k", "a", "b") == {
        (1, "x", "p"), (2, None, "q"), (3, "z", "s"),
    }
    twice = upsert.upsert(upsert.upsert(old, new, ["k"]), new, ["k"])
    assert as_set(twice, "k", "a", "b") == {(1, "x", "p"), (2, None, "r"), (3, "z", "s")}


def test_partition_upsert_is_idempotent_and_leaves_other_days(spark):
    def rows(*r):
        return spark.createDataFrame(
            [(date(2024, 1, d), s, q) for d, s, q in r], "day date, sku string, quantity int"
        )

    path = fresh_dir(spark, "test-upsert")
    sinks.write_partitions(rows((1, "A", 1), (2, "A", 1), (2, "B", 1)), path, ["day"])
    batch = rows((2, "A", 9), (2, "C", 9), (3, "A", 9))
    for _ in range(2):
        sinks.upsert_partitions(spark, path, batch, schema=batch.schema, keys=["day", "sku"], by="day")
    got = spark.read.schema(batch.schema).parquet(path)
    assert as_set(got, "day", "sku", "quantity") == {
        (date(2024, 1, 1), "A", 1), (date(2024, 1, 2), "A", 9), (date(2024, 1, 2), "B", 1),
        (date(2024, 1, 2), "C", 9), (date(2024, 1, 3), "A", 9),
    }


def test_archive_of_one_run_replaces_itself(spark):
    path = fresh_dir(spark, "test-archive")
    df = spark.createDataFrame([("A", "W", 1.0)], "sku string, warehouse_id string, velocity_7d double")
    for _ in range(2):
        sinks.archive_metrics(df, path, processed_at=NOW)
    assert spark.read.parquet(path).count() == 1


# -- catalog --------------------------------------------------------------------------------

PRODUCT = "id long, sku string, name string, category_id long, is_active boolean"


def test_catalog_requests(spark):
    products = spark.createDataFrame([(1, "AAA", "a", 7, True), (2, "BBB", "b", None, False)], PRODUCT)
    categories = spark.createDataFrame([(7,)], "id long")
    asked = spark.createDataFrame(
        [
            (1, None, "CCC", "c", None, None),  # new, active by default
            (2, None, "AAA", "x", None, None),  # taken
            (3, 1, "AAA", "renamed", None, None),  # own sku, category removed, flag kept
            (4, 2, "AAA", "x", None, True),  # another's sku
            (5, 9, "DDD", "x", None, True),  # unknown row
            (6, None, "EEE", "x", 8, True),  # unknown category
            (7, None, "CCC", "x", None, None),  # second request for a new sku
        ],
        "request_id long, " + PRODUCT,
    )
    judged = catalog.judge_changes(products, asked, unique="sku", parent="category_id", parents=categories)
    assert as_set(judged, "request_id", "rejection") == {
        (1, None), (2, "DUPLICATE"), (3, None), (4, "DUPLICATE"), (5, "NOT_FOUND"), (6, "PARENT_NOT_FOUND"),
        (7, "DUPLICATE"),
    }
    assert as_set(catalog.apply_changes(products, judged), "id", "sku", "name", "category_id", "is_active") == {
        (1, "AAA", "renamed", None, True), (2, "BBB", "b", None, False), (3, "CCC", "c", None, True),
    }


def test_catalog_requests_in_order(spark):
    """Each request sees what those before it have left; a plain replay is the measure."""
    rng = random.Random(4)
    values = ["AAA", "BBB", "CCC", "DDD", "EEE"]
    for seed in range(4):
        rng = random.Random(seed)
        table = [(i, v, f"n{i}", rng.choice([7, None]), True) for i, v in enumerate(values[:3], 1)]
        asked = [
            (n, rng.choice([None, 1, 2, 3, 9]), rng.choice(values), f"r{n}", rng.choice([7, 7, None, 8]), rng.choice([True, False, None]))
            for n in range(1, 40)
        ]
        owner, rows, want = {r[1]: r[0] for r in table}, {r[0]: list(r) for r in table}, {}
        for n, i, value, name, category, active in asked:
            if i is not None and i not in rows:
                want[n] = "NOT_FOUND"
            elif value in owner and owner[value] != i:
                want[n] = "DUPLICATE"
            elif category == 8:
                want[n] = "PARENT_NOT_FOUND"
            else:
                want[n] = None
                key = i if i is not None else 3 + n
                if i is not None:
                    owner.pop(rows[i][1])
                owner[value] = key
                kept = active if active is not None else rows[i][4] if i is not None else True
                if i is None:
                    rows[-key] = [key, value, name, category, kept]  # cannot be named by a request of this batch
                else:
                    rows[i] = [key, value, name, category, kept]
        products, categories = spark.createDataFrame(table, PRODUCT), spark.createDataFrame([(7,)], "id long")
        requests = spark.createDataFrame(rng.sample(asked, len(asked)), "request_id long, " + PRODUCT)
        judged = catalog.judge_changes(products, requests, unique="sku", parent="category_id", parents=categories).cache()
        assert dict(judged.select("request_id", "rejection").collect()) == want
        assert as_set(catalog.apply_changes(products, judged), "id", "sku", "name", "category_id", "is_active") == {tuple(r) for r in rows.values()}


def test_catalog_requests_for_values_that_rows_share(spark):
    """Rows of the table may share a value: it is free once no other row has it, in whatever order they are read."""
    for seed in range(2):
        rng = random.Random(seed)
        table = [(i, rng.choice(["AAA", "BBB", None]), "n", None, True) for i in range(1, 9)]
        asked = [(n, i, table[i - 1][1], "own", None, True) for n, i in enumerate(range(1, 9), 1)]  # each its own value
        asked += [(n, rng.choice([None, *range(1, 9)]), rng.choice(["AAA", "BBB", "CCC", "DDD", None]), "r", None, True) for n in range(9, 40)]
        now, want = {r[0]: r[1] for r in table}, {}
        for n, i, value, *_ in asked:
            free = value is None or all(v != value for k, v in now.items() if k != i)
            want[n] = None if free else "DUPLICATE"
            if free:
                now[i if i is not None else -n] = value
        assert sum(w is None for w in want.values()) > 5 and "DUPLICATE" in [want[n] for n in range(1, 9)]
        products, categories = spark.createDataFrame(rng.sample(table, len(table)), PRODUCT), spark.createDataFrame([(7,)], "id long")
        requests = spark.createDataFrame(rng.sample(asked, len(asked)), "request_id long, " + PRODUCT).repartition(3)
        judged = catalog.judge_changes(products, requests, unique="sku", parent="category_id", parents=categories)
        assert dict(judged.select("request_id", "rejection").collect()) == want


def test_sketches_of_parts_merge_to_that_of_the_whole(spark):
    rng = random.Random(3)
    rows = [(f"S{rng.randint(0, 3000)}", rng.randint(0, 6)) for _ in range(20_000)] + [(None, 1)]
    df = spark.createDataFrame(rows, "sku string, day int").repartition(5)
    merged = keyed.merge_hot_items(keyed.hot_item_sketches(df, by="day", size=256), size=256)
    whole = keyed.hot_item_sketches(df.withColumn("all", F.lit(1)), by="all", size=256).select("sketch")
    assert merged.collect() == whole.collect()
    got = keyed.with_estimate(merged, size=256).first()
    exact = len({s for s, _ in rows if s})
    assert abs(got.hot_items - exact) < 3 * got.standard_error * exact
    few = keyed.with_estimate(keyed.hot_item_sketches(df.filter("day = 2").limit(100), by="day", size=256), size=256).first()
    assert few.hot_items == few.hot_items // 1 and few.standard_error == 0


def test_pages_do_not_overlap(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(25)], "id long, v int")
    seen = [r.id for n in range(3) for r in lookups.page(df, sort_by="v", descending=True, number=n).collect()]
    assert sorted(seen) == list(range(25))


# -- quality --------------------------------------------------------------------------------


def test_rules_count_nulls_and_blanks(spark, items, ledger):
    stock = items(
        {"sku": ""}, {"sku": None, "quantity_on_hand": -1}, {"warehouse_id": "", "reorder_quantity": -1},
        {"inventory_status": "DISCONTINUED", "quantity_on_hand": -1}, {"unit_cost": __import__("decimal").Decimal("-1")},
    )
    row = quality.check_inventory(stock).first().asDict()
    assert row == {
        "negative_inventory": 1, "over_reserved": 1, "negative_reorder_point": 0, "negative_reorder_quantity": 1,
        "missing_sku": 2, "missing_warehouse_id": 1, "negative_unit_cost": 1, "total_records": 4,
    }
    log = ledger([(1, "A", "W", 0, "", "2024-01-30"), (2, "A", "W", 1, None, "2024-02-01"), (3, "A", "W", 1, "SALE", None)])
    windowed = quality.check_transactions(log, as_of=NOW).first()
    assert (windowed.missing_timestamp, windowed.future_timestamp, windowed.total_transactions) == (0, 1, 2)
    assert quality.check_transactions(log, as_of=NOW, days=None).first().missing_timestamp == 1


def test_report_passes_only_without_issues(spark, items, ledger):
    products = spark.createDataFrame([("A", "n", 1, 1, True)], "sku string, name string, price int, category_id int, is_active boolean")
    log = ledger([(1, "A", "W", 1, "SALE", "2024-01-30")])
    good = quality.quality_report(quality.quality_checks(items({}), log, products, as_of=NOW))
    assert as_set(good, "status") == {("PASS",)}
    bad = quality.quality_report(quality.quality_checks(items({"sku": ""}), log, products, as_of=NOW))
    assert dict(bad.select("dataset", "status").collect()) == {
        "inventory": "FAIL", "transactions": "PASS", "products": "PASS", "summary": "FAIL",
    }
    assert bad.filter("dataset = 'inventory'").first().issues == "Missing SKUs: 1 records"


def test_violations(spark, items):
    stock = items({"sku": "AB", "quantity_reserved": -1}, {"inventory_status": "LOST"}, {"inventory_status": None})
    got = quality.violations(stock, quality.ITEM_CONSTRAINTS, identity=["sku"])
    assert as_set(got, "sku", "violation") == {
        ("AB", "sku_size_3_50"), ("AB", "reserved_min_0"), ("AAA", "status_domain"),
    }
    assert quality.duplicates(stock).first().occurrences == 2


# -- replenishment --------------------------------------------------------------------------


def test_recommendation_boundary(items):
    stock = items({"sku": "AT", "quantity_on_hand": 20}, {"sku": "OVER", "quantity_on_hand": 21})
    got = replenishment.recommendations(stock)
    assert as_set(got, "sku", "recommended_quantity", "priority") == {("AT", 20, "HIGH"), ("OVER", 0, "LOW")}
    orders = replenishment.purchase_orders(got, as_of=NOW)
    again = replenishment.purchase_orders(got, as_of=NOW)
    assert as_set(orders, "order_id") == as_set(again, "order_id")
    row = orders.first()
    assert row.status == "PENDING" and row.expected_delivery_date == NOW + timedelta(days=7)


def test_auto_reorder_default(items):
    got = replenishment.auto_reorder(items({"quantity_on_hand": 0, "reorder_quantity": None}))
    assert got.first().quantity == 100


def forecast_of(spark, values, width=10.0):
    rows = [("A", "W", date(2024, 1, 1) + timedelta(days=i), float(v), v - width / 2, v + width / 2) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "sku string, warehouse_id string, date date, yhat double, yhat_lower double, yhat_upper double"
    )


def test_plan_from_a_forecast(spark):
    stock = spark.createDataFrame([("A", "W", 25)], "sku string, warehouse_id string, current_inventory int")
    row = replenishment.replenishment_plan(forecast_of(spark, [10] * 10), stock).first()
    assert row.stockout_date == date(2024, 1, 3)  # 30 >= 25
    assert row.stockout_probability == 0.75  # 0.5 + 5 / 10 * 0.5
    assert row.reorder_point == 7 * 10 + 3 * 15
    assert row.recommended_order_quantity == int((2 * 10 * 365 * 50 / 0.1) ** 0.5)
    never = replenishment.replenishment_plan(
        forecast_of(spark, [0] * 10), stock
    ).first()
    assert (never.stockout_date, never.stockout_probability) == (None, 0.0)
    unknown = replenishment.replenishment_plan(forecast_of(spark, [1]), stock.filter("1 = 0")).first()
    assert unknown.current_inventory == 0 and unknown.stockout_date == date(2024, 1, 1)


# -- sources --------------------------------------------------------------------------------


def test_jdbc_options():
    got = tables.jdbc_options(url="jdbc:x", table="t", bounds=(1, 100), partitions=4)
    assert (got["lowerBound"], got["upperBound"], got["numPartitions"]) == ("1", "100", "4")
    with pytest.raises(ValueError):
        tables.jdbc_options(url="jdbc:x", table="t", bounds=(2, 1), partitions=4)


def test_documents_round_trip(spark, ledger):
    path = fresh_dir(spark, "test-documents")
    tables.as_documents(ledger([(1, "A", "W", -5, "SALE", "2024-01-01T10:00:00")])).write.json(path)
    back = tables.read_ledger_documents(spark, path)
    assert as_set(back, "sku", "quantity_change", "timestamp") == {("A", -5, datetime(2024, 1, 1, 10))}


def test_upsert_reads_only_partitions_between_those_of_the_batch(spark):
    path = fresh_dir(spark, "pruned")
    schema = T.StructType().add("day", "string").add("k", "integer").add("v", "integer")
    table = spark.createDataFrame([(f"2024-01-{d:02d}", k, 0) for d in range(1, 10) for k in range(2)], schema)
    sinks.write_partitions(table, path, ["day"])
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/day=*/*.parquet")}
    new = spark.createDataFrame([("2024-01-05", 1, 7), ("2024-01-05", 2, 8)], schema)
    sinks.upsert_partitions(spark, path, new, schema=schema, keys=["day", "k"], by="day")
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/day=*/*.parquet")}
    assert {f for f in before if before[f] != after.get(f)} == {f for f in before if "01-05" in f}
    got = spark.read.schema(schema).parquet(path)
    assert as_set(got.filter("v > 0"), "day", "k", "v") == {("2024-01-05", 1, 7), ("2024-01-05", 2, 8)} and got.count() == 19
    sinks.upsert_partitions(spark, path, new.limit(0), schema=schema, keys=["day", "k"], by="day")
    assert spark.read.schema(schema).parquet(path).count() == 19
    plan = got.filter(F.col("day").between("2024-01-05", "2024-01-05"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_sinks_of_a_run_replace_themselves(spark):
    path = fresh_dir(spark, "again")
    rows = spark.createDataFrame([("A", 1)], "sku string, n int")
    for day in (1, 1, 2):
        run = datetime(2024, 1, day)
        sinks.append_metrics(rows, path + "/metrics", processed_at=run)
        sinks.write_alerts(rows, path + "/alerts", at_time=run)
    assert spark.read.parquet(path + "/metrics").count() == 2 and spark.read.text(path + "/alerts").count() == 2


def test_metrics_sum_the_ledger_before_the_join(spark, ledger):
    log = ledger([(1, "A", "W", -5, "SALE", "2024-01-10T00:00")])
    plan = series.processed_metrics(log, log, as_of=NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [sku") or "LeftSemi" not in plan
    assert "LeftSemi" not in plan and plan.count("Join") == 1
