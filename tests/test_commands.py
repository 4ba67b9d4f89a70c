"""Stock commands: the golden cases, brute force, large keys, and the stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from granary.operators import commands as c
from granary.operators import ordered
from granary.operators.anomaly import volume_anomalies
from granary.schemas import COMMANDS
from granary.session import fresh_dir
from granary.sources.streams import read_table_files
from granary.streaming.commands import run_judge

START = datetime(2024, 1, 1)


def commands(spark, rows):
    return spark.createDataFrame(
        [(i, s, w, op, q, START + timedelta(minutes=m)) for i, s, w, op, q, m in rows], COMMANDS
    )


GOLDEN = [
    # what differs from 100 on hand, 10 reserved, reorder point 20; command; levels after; reason
    ({}, "ADJUST", -10, (90, 10, 0), None),
    ({"quantity_on_hand": 5, "quantity_reserved": 0}, "ADJUST", -10, (5, 0, 0), c.NEGATIVE),
    ({}, "RESERVE", 10, (100, 20, 0), None),
    ({"quantity_on_hand": 15}, "RESERVE", 10, (15, 10, 0), c.INSUFFICIENT),
    ({}, "RESERVE", 0, (100, 10, 0), c.NOT_POSITIVE),
    ({}, "SALE", 15, (85, 10, 0), None),
    ({}, "SALE", 91, (100, 10, 0), c.INSUFFICIENT),
    ({"quantity_on_hand": 50, "quantity_in_transit": 30}, "RECEIPT", 30, (80, 10, 0), None),
    ({"quantity_on_hand": 50, "quantity_in_transit": 10}, "RECEIPT", 30, (80, 10, 10), None),
    ({"quantity_reserved": 20}, "RELEASE", 10, (100, 10, 0), None),
    ({}, "RELEASE", 11, (100, 10, 0), c.OVER_RELEASE),
    ({}, "PAINT", 1, (100, 10, 0), c.UNKNOWN_OP),
    ({}, None, 1, (100, 10, 0), c.MISSING),
    ({}, "SALE", None, (100, 10, 0), c.MISSING),
    ({}, "RECEIPT", None, (100, 10, 0), c.MISSING),
]


def test_golden_cases(spark, items):
    """Each case is a product of its own, so one replay answers all of them."""
    skus = [f"S{n:02d}" for n in range(len(GOLDEN))]
    stock = items(*[{"sku": s, **before} for s, (before, *_) in zip(skus, GOLDEN, strict=True)])
    log = commands(
        spark, [(n, s, "W1", op, q, 0) for n, (s, (_, op, q, *_)) in enumerate(zip(skus, GOLDEN, strict=True))]
    )
    judged = c.judge(stock, log).cache()
    reasons = [reason for *_, reason in GOLDEN]
    assert dict(judged.select("sku", "rejection").collect()) == dict(zip(skus, reasons, strict=True))
    after = {r.sku: r for r in c.items_after(stock, log).collect()}
    for sku, (_, _, _, levels, reason) in zip(skus, GOLDEN, strict=True):
        r = after[sku]
        assert (r.quantity_on_hand, r.quantity_reserved, r.quantity_in_transit) == levels, sku
        assert r.version == (0 if reason else 1)
    # a rejected command leaves neither ledger row nor event
    done = c.accepted(judged)
    kept = {s for s, reason in zip(skus, reasons, strict=True) if reason is None}
    assert {r.sku for r in c.ledger_from_commands(done).collect()} == kept
    assert {r.sku for r in c.events_from_commands(done).collect()} == kept


MIXED = [("SALE", 5), ("SALE", None), ("SALE", 1000), (None, 5), ("ADJUST", None), ("RELEASE", None), ("SALE", 5)]
MIXED_REASONS = [None, c.MISSING, c.INSUFFICIENT, c.MISSING, c.MISSING, c.MISSING, None]


def test_missing_values_are_rejected_before_and_after_a_rejection(spark, items):
    log = commands(spark, [(n, "AAA", "W1", op, q, n) for n, (op, q) in enumerate(MIXED)])
    judged = c.judge(items({}), log).orderBy("id").collect()
    assert [r.rejection for r in judged] == MIXED_REASONS
    assert judged[-1].on_hand_after == 90
    sliced = c.judge(items({}), log, slices=3).orderBy("id").collect()
    assert [r.rejection for r in sliced] == MIXED_REASONS


def test_missing_values_are_rejected_on_a_stream(spark, items):
    log = commands(spark, [(n, "AAA", "W1", op, q, n) for n, (op, q) in enumerate(MIXED)])
    path, out = fresh_dir(spark, "mixed"), fresh_dir(spark, "judged")
    log.coalesce(1).write.parquet(path)
    stream = read_table_files(spark, path, COMMANDS, only="*.parquet")
    table = run_judge(items({}), stream, out, checkpoint=out + "-checkpoint")
    assert [r.rejection for r in table.orderBy("id").collect()] == MIXED_REASONS


def test_unknown_item_is_rejected(spark, items):
    judged = c.judge(items({}), commands(spark, [(1, "ZZZ", "W1", "SALE", 1, 0)]))
    assert [tuple(r) for r in judged.select("rejection", "on_hand_after").collect()] == [(c.NOT_FOUND, None)]


def test_status_is_derived_and_discontinued_lost(spark, items):
    stock = items({"inventory_status": "DISCONTINUED"}, {"sku": "BBB", "inventory_status": "DISCONTINUED"})
    after = c.items_after(stock, commands(spark, [(1, "AAA", "W1", "SALE", 90, 0)]))
    assert dict(after.select("sku", "inventory_status").collect()) == {"AAA": "LOW_STOCK", "BBB": "DISCONTINUED"}


def brute_force(levels, log):
    out = {}
    for i, s, w, op, q, _ in sorted(log, key=lambda r: (r[5], r[0])):
        if (s, w) not in levels:
            out[i] = (c.NOT_FOUND, None, None)
            continue
        h, r = levels[(s, w)]
        reason = None
        if op == "ADJUST" and h + q < 0:
            reason = c.NEGATIVE
        elif op in ("SALE", "RESERVE") and q > h - r:
            reason = c.INSUFFICIENT
        elif op == "RELEASE" and q > r:
            reason = c.OVER_RELEASE
        else:
            h += {"ADJUST": q, "SALE": -q, "RECEIPT": q}.get(op, 0)
            r += {"RESERVE": q, "RELEASE": -q}.get(op, 0)
        levels[(s, w)] = (h, r)
        out[i] = (reason, h, r)
    return out


def random_log(seed, n, hot=0.4):
    """Commands of which a large share fall on one key; ids do not follow time."""
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    log = []
    for i in ids:
        sku = "AAA" if rng.random() < hot else rng.choice(["BBB", "CCC", "DDD", "ZZZ"])
        op = rng.choice(["ADJUST", "RESERVE", "RELEASE", "SALE", "RECEIPT"])
        q = rng.randint(-15, 15) if op == "ADJUST" else rng.randint(1, 12)
        log.append((i, sku, rng.choice(["W1", "W2"]), op, q, rng.randint(0, 3000)))
    return log


@pytest.mark.parametrize("seed", [1, 2])
def test_judge_equals_brute_force(spark, items, seed):
    log = random_log(seed, 1500)
    keys = [(s, w) for s in ("AAA", "BBB", "CCC", "DDD") for w in ("W1", "W2")]
    stock = items(*[{"sku": s, "warehouse_id": w} for s, w in keys])
    got = {
        r.id: (r.rejection, r.on_hand_after, r.reserved_after)
        for r in c.judge(stock, commands(spark, log)).collect()
    }
    assert got == brute_force(dict.fromkeys(keys, (100, 10)), log)


def test_key_without_rejections(spark, items):
    log = commands(spark, [(i, "AAA", "W1", "RECEIPT", 1, i) for i in range(500)])
    judged = c.judge(items({}), log)
    assert judged.agg(F.max("on_hand_after")).first()[0] == 600
    assert judged.filter("rejection IS NOT NULL").count() == 0


@pytest.mark.parametrize("per_trigger", [1, 2, 100])
def test_stream_equals_batch_however_its_input_is_cut(spark, items, per_trigger):
    """Files whose times overlap, taken one, two or all at a time: rows wait for their turn."""
    log = random_log(3, 600)  # in no order
    keys = [(s, w) for s in ("AAA", "BBB", "CCC", "DDD") for w in ("W1", "W2")]
    stock = items(*[{"sku": s, "warehouse_id": w} for s, w in keys])
    folder = fresh_dir(spark, "test-commands")
    near = sorted(log, key=lambda r: r[5] // 700)  # order within a file is random, files are 700 minutes apart
    for n in range(5):
        part = commands(spark, near[n * 120 : (n + 1) * 120])
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = read_table_files(spark, folder, COMMANDS, only="*.parquet", files_per_trigger=per_trigger)
    out = fresh_dir(spark, "test-judged")
    table = run_judge(stock, stream, out, checkpoint=out + "-checkpoint", delay=timedelta(minutes=1500))
    got = {r.id: (r.rejection, r.on_hand_after, r.reserved_after) for r in table.collect()}
    assert got == brute_force(dict.fromkeys(keys, (100, 10)), log)


# -- running totals -------------------------------------------------------------------------


def moves(spark, n=4000, seed=5):
    rng = random.Random(seed)
    rows = [
        # a third of the rows on one key, many at the same moment, some without a time
        (i, "HOT" if rng.random() < 0.4 else f"S{rng.randint(0, 30)}", "W1", rng.randint(-50, 50),
         None if i % 97 == 0 else START + timedelta(minutes=rng.randint(0, 600) // 5 * 5))
        for i in rng.sample(range(10 * n), n)
    ]
    schema = "id long, sku string, warehouse_id string, quantity_change int, timestamp timestamp_ntz"
    return rows, spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("slices", [None, 1, 16])
def test_running_totals_equal_brute_force(spark, slices):
    rows, df = moves(spark)
    got = {
        r.id: (r.total, r.n)
        for r in ordered.running_totals(
            df, ["sku", "warehouse_id"], ["timestamp", "id"],
            {"total": F.col("quantity_change").cast("bigint"), "n": F.lit(1).cast("bigint")}, slices=slices,
        ).collect()
    }
    want, sums = {}, {}
    for i, s, _, q, t in sorted(rows, key=lambda r: (r[4] is not None, r[4] or START, r[0])):
        total, n = sums.get(s, (0, 0))
        want[i] = sums[s] = (total + q, n + 1)
    assert got == want


@pytest.mark.parametrize("time", [None, START])
def test_a_burst_of_one_moment_is_many_slices(spark, time):
    """Rows of one key with equal or missing times are cut by id."""
    rows = [(i, "HOT", "W1", 1, time) for i in random.Random(2).sample(range(100_000), 4000)]
    df = spark.createDataFrame(rows, "id long, sku string, warehouse_id string, quantity_change int, timestamp timestamp_ntz")
    sizes = [r["count"] for r in ordered.cut(df, ["sku", "warehouse_id"], ["timestamp", "id"], slices=8).groupBy(ordered.SLICE).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500
    total = {"n": F.lit(1).cast("bigint")}
    got = ordered.running_totals(df, ["sku", "warehouse_id"], ["timestamp", "id"], total, slices=8).orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, 4001))


def test_trailing_frames_cross_blocks(spark):
    rows, df = moves(spark, seed=6)
    got = {
        r.id: (r._n, r._s1, r._s2)
        for r in ordered.with_trailing(
            df, ["sku", "warehouse_id"], ["timestamp", "id"], F.col("quantity_change"), rows=100, block=100
        ).collect()
    }
    want, seen = {}, {}
    for i, s, _, q, t in sorted(rows, key=lambda r: (r[4] is not None, r[4] or START, r[0])):
        frame = seen[s] = [*seen.get(s, []), q][-100:]
        want[i] = (len(frame), sum(frame), sum(x * x for x in frame))
    assert got == want


def test_block_must_hold_a_frame(spark):
    with pytest.raises(ValueError):
        ordered.with_trailing(moves(spark, 10)[1], ["sku"], ["timestamp", "id"], F.lit(1), rows=100, block=50)


def test_running_totals_shuffle_rows_by_key_and_slice_only(spark):
    _, df = moves(spark, 100)
    plan = ordered.running_totals(
        df, ["sku", "warehouse_id"], ["timestamp", "id"], {"total": F.col("quantity_change").cast("bigint")}
    )._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 3  # slice totals twice, rows once


def test_judge_keeps_keys_whole_under_adaptive_layouts(spark, items):
    """With several partitions and a join that turns into a broadcast at run time, shuffles may
    be read in another layout; a key must still be replayed in one piece."""
    log = random_log(7, 3000, hot=0.3)
    keys = [(s, w) for s in ("AAA", "BBB", "CCC", "DDD") for w in ("W1", "W2")]
    stock = items(*[{"sku": s, "warehouse_id": w} for s, w in keys])
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    try:
        spark.conf.set(coalesce, "false")
        got = {
            r.id: (r.rejection, r.on_hand_after, r.reserved_after)
            for r in c.judge(stock, commands(spark, log).repartition(7)).collect()
        }
    finally:
        spark.conf.set(coalesce, before)
    assert got == brute_force(dict.fromkeys(keys, (100, 10)), log)


@pytest.mark.parametrize("slices", [1, 7, 60])
def test_slices_settle_to_the_same(spark, items, slices):
    log = random_log(11, 900, hot=0.6)
    keys = [(s, w) for s in ("AAA", "BBB", "CCC", "DDD") for w in ("W1", "W2")]
    stock = items(*[{"sku": s, "warehouse_id": w} for s, w in keys])
    judged = c.judge(stock, commands(spark, log), slices=slices)
    got = {r.id: (r.rejection, r.on_hand_after, r.reserved_after) for r in judged.collect()}
    assert got == brute_force(dict.fromkeys(keys, (100, 10)), log)


def test_a_hot_key_with_a_rejection_in_every_slice(spark, items):
    """Every slice rejects, and what it rejects depends on the slices before it."""
    rng = random.Random(21)
    log = []
    for n in range(1200):
        op = rng.choice(["SALE", "SALE", "RECEIPT", "ADJUST", "RESERVE", "RELEASE"])
        q = -rng.randint(1, 200) if op == "ADJUST" else rng.randint(1, 120) if op != "RECEIPT" else rng.randint(1, 90)
        log.append((n, "AAA", "W1", op, q, n // 400))  # bursts of 400 at one moment
    want = brute_force({("AAA", "W1"): (100, 10)}, log)
    judged = c.judge(items({}), commands(spark, log), slices=12)
    assert {r.id: (r.rejection, r.on_hand_after, r.reserved_after) for r in judged.collect()} == want
    slices = ordered.cut(commands(spark, log), ["sku", "warehouse_id"], ["timestamp", "id"], slices=12).select("id", ordered.SLICE).collect()
    rejected = {r[ordered.SLICE] for r in slices if want[r.id][0]}
    assert len(rejected) == len({r[ordered.SLICE] for r in slices}) >= 8
    after = c.items_after(items({}), commands(spark, log), slices=12).first()
    last = want[1199]
    assert (after.quantity_on_hand, after.quantity_reserved) == last[1:]
    assert after.version == sum(reason is None for reason, *_ in want.values())


@pytest.mark.parametrize("slices", [None, 5, 40])
def test_in_transit_equals_brute_force(spark, items, slices):
    rng = random.Random(13)
    start = {"AAA": 200, "BBB": 40, "CCC": 3, "DDD": 10_000, "EEE": 7}
    least = {"CCC": 4, "EEE": -2}
    log = [
        (i, s, "W1", "RECEIPT", rng.randint(least.get(s, 1), 30), rng.randint(0, 4000))
        for i in rng.sample(range(5000), 250) for s in [rng.choice(["AAA", "AAA", "BBB", "CCC", "DDD", "EEE"])]
    ]
    stock = items(*[{"sku": s, "quantity_in_transit": q} for s, q in start.items()])
    want = dict(start)
    for _, s, _, _, q, _ in sorted(log, key=lambda r: (r[5], r[0])):
        if want[s] >= q:
            want[s] -= q
    got = c.in_transit_after(stock, commands(spark, log), slices=slices)
    assert dict(got.select("sku", "_transit").collect()) == want


def test_large_quantities_do_not_overflow(spark):
    rows = [(i, "A", "W1", 2_000_000_000 if i % 2 else -2_000_000_000, START + timedelta(minutes=i)) for i in range(300)]
    df = spark.createDataFrame(
        rows, "id long, sku string, warehouse_id string, quantity_change int, timestamp timestamp_ntz"
    )
    want = {}
    for i in range(300):
        frame = [r[3] for r in rows[max(0, i - 99) : i + 1]]
        n, s1, s2 = len(frame), sum(frame), sum(x * x for x in frame)
        want[i] = abs(n * frame[-1] - s1) / (n * s2 - s1 * s1) ** 0.5 if n * s2 > s1 * s1 else 0.0
    got = {r.id: r.deviation for r in volume_anomalies(df, threshold=-1.0).collect()}
    assert got == pytest.approx(want)
