"""Rules of the snapshot and the daily series, each replayed row by row over random items and movements."""

from __future__ import annotations

import random
import statistics
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from granary.operators import series, snapshot
from granary.schemas import KEY

NOW = datetime(2024, 1, 31)
KINDS = ["SALE", "SALE", "SALE", "RESTOCK", "RETURN", "ADJUSTMENT", None]


def movements(rng, keys, count, days):
    out = []
    for n in range(count):
        sku, warehouse = rng.choice(keys)
        at = None if rng.random() < 0.02 else NOW - timedelta(minutes=rng.randint(0, days * 1440))
        out.append((n, sku, warehouse, rng.randint(-20, 20), rng.choice(KINDS), at))
    return out


@pytest.fixture(params=[1, 2])
def case(request, spark, items, ledger):
    rng = random.Random(request.param)
    keys = [(f"S{k}", w) for k in range(12) for w in ("W1", "W2")]
    stock = [
        {
            "sku": s, "warehouse_id": w, "quantity_on_hand": rng.choice([0, 0, 3, 10, 40, 100]), "quantity_reserved": rng.randint(0, 9),
            "reorder_point": rng.randint(0, 20), "unit_cost": rng.choice([None, "2.50", "0.10"]),
            "inventory_status": rng.choice(["NORMAL", "NORMAL", "LOW_STOCK", "DISCONTINUED", None]),
        }
        for s, w in keys
    ]
    from decimal import Decimal

    for row in stock:
        row["unit_cost"] = None if row["unit_cost"] is None else Decimal(row["unit_cost"])
    moved = movements(rng, [k for k in keys if k[0] not in ("S3", "S7")], 500, 60)
    log = ledger([(i, s, w, q, kind, None if t is None else t.isoformat()) for i, s, w, q, kind, t in moved])
    return stock, moved, items(*stock), log


def by_key(moved):
    out = defaultdict(list)
    for row in moved:
        out[row[1], row[2]].append(row)
    return out


def test_snapshot(case):
    stock, moved, items, log = case
    history, want = by_key(moved), {}
    for i in stock:
        if i["inventory_status"] in (None, "DISCONTINUED"):
            continue
        recent = [r for r in history[i["sku"], i["warehouse_id"]] if r[5] is not None and r[5] >= NOW - timedelta(days=30)]
        sold = [abs(r[3]) for r in recent if r[4] == "SALE"]
        if i["quantity_on_hand"] == 0:
            action = "STOCKOUT"
        elif i["quantity_on_hand"] - i["quantity_reserved"] <= i["reorder_point"]:
            action = "NEEDS_REORDER"
        elif recent and sum(sold) == 0:
            action = "NO_MOVEMENT"
        else:
            action = "NORMAL"
        want[i["sku"], i["warehouse_id"]] = (
            action, len(sold), sum(sold), statistics.mean(sold) if sold else 0, statistics.stdev(sold) if len(sold) > 1 else 0,
            sum(sold) / 30, i["quantity_on_hand"] * float(i["unit_cost"] or 0), max((r[5] for r in recent), default=None),
        )
    got = {(r.sku, r.warehouse_id): r for r in snapshot.inventory_snapshot(items, log, as_of=NOW).collect()}
    assert set(got) == set(want)
    for key, (action, count, total, mean, spread, velocity, value, last) in want.items():
        r = got[key]
        assert (r.action_required, r.sales_count_30d, r.total_sales_30d, r.last_transaction_date) == (action, count, total, last)
        numbers = (r.avg_sale_quantity, r.stddev_sale_quantity, r.daily_velocity, float(r.inventory_value))
        assert numbers == pytest.approx((mean, spread, velocity, value))
    assert {a for a, *_ in want.values()} == {"STOCKOUT", "NEEDS_REORDER", "NO_MOVEMENT", "NORMAL"} or len(want) < 20


def test_movement_stats(case):
    stock, moved, items, log = case
    start, history, want = NOW - timedelta(days=10), by_key(moved), {}
    for i in stock:
        every = history[i["sku"], i["warehouse_id"]]
        recent = [r for r in every if r[5] is None or r[5] >= start]
        if every and not recent:
            continue
        sold = [abs(r[3]) if r[4] == "SALE" else 0 for r in recent]
        want[i["sku"], i["warehouse_id"]] = (len(recent), sum(sold), pytest.approx(statistics.mean(sold) if sold else 0))
    got = snapshot.movement_stats(items, log, start=start).collect()
    assert {(r.sku, r.warehouse_id): (r.transaction_count, r.total_sales, r.avg_sale_quantity) for r in got} == want


def test_dead_stock(case):
    stock, moved, items, log = case
    cutoff, history = NOW - timedelta(days=3), by_key(moved)
    want = {
        (i["sku"], i["warehouse_id"]) for i in stock
        if i["quantity_on_hand"] > 0 and i["inventory_status"] not in (None, "DISCONTINUED")
        and not any(r[5] is not None and r[5] >= cutoff for r in history[i["sku"], i["warehouse_id"]])
    }
    got = snapshot.dead_stock(items, log, cutoff=cutoff).select(*KEY).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_training_frame(case):
    """Days with movements only; lags and means count such days, not calendar days."""
    stock, moved, items, log = case
    days = defaultdict(list)
    for r in moved:
        if r[5] is not None:
            days[r[1], r[2], r[5].date()].append(r)
    want = {}
    for i in stock:
        key = i["sku"], i["warehouse_id"]
        own = sorted(d for s, w, d in days if (s, w) == key)
        sales = [sum(abs(r[3]) for r in days[(*key, d)] if r[4] == "SALE") for d in own]
        for n, day in enumerate(own):
            week, month = sales[max(0, n - 7) : n + 1], sales[max(0, n - 30) : n + 1]
            want[(*key, day)] = (
                sales[n], len(days[(*key, day)]), sales[n - 1] if n else None, sales[n - 7] if n >= 7 else None,
                statistics.mean(week), statistics.mean(month), statistics.stdev(month) if len(month) > 1 else None,
            )
    got = series.training_frame(log, items, as_of=NOW)
    found = {
        (r.sku, r.warehouse_id, r.date): (
            r.daily_sales, r.transaction_count, r.sales_lag_1, r.sales_lag_7, r.sales_ma_7, r.sales_ma_30, r.sales_std_30)
        for r in got.collect()
    }
    assert set(found) == set(want)
    for key, values in want.items():
        assert found[key] == pytest.approx(values, nan_ok=True), key
