"""Streams over several micro-batches equal their batch twins; late rows, restarts, quarantine."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from granary.operators import anomaly, events
from granary.schemas import EVENTS, KEY
from granary.session import fresh_dir
from granary.sources import streams as src
from granary.streaming import state, windows
from granary.streaming.anomaly import run_anomalies
from granary.streaming.files import _at
from granary.streaming.metrics import run_days, run_enriched, run_metrics
from granary.streaming.ordered import FOLDERS, Waiting
from granary.streaming.tables import BATCH, Tiers, newest, run_available, to_newest, to_table
from tests.conftest import as_set

START = datetime(2024, 1, 1)
TYPES = ["INVENTORY_UPDATED", "RESTOCKED", "RESERVED", "RELEASED", "LOW_STOCK", "OUT_OF_STOCK", "ADJUSTED"]


def event_rows(n, seed=1, hot=0.4):
    rng = random.Random(seed)
    return [
        (f"{i:05d}", "HOT" if rng.random() < hot else f"S{rng.randint(0, 9)}", "W1", rng.randint(-40, 40),
         rng.choice(TYPES), START + timedelta(seconds=20 * i))
        for i in range(n)
    ]


class Feed:
    """A folder that gets one file after the other, and the stream over it."""

    def __init__(self, spark, schema=EVENTS):
        self.spark, self.schema, self.path = spark, schema, fresh_dir(spark, "test-feed")

    def add(self, rows):
        df = self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(self.path)
        return self

    def stream(self):
        return src.read_table_files(self.spark, self.path, self.schema, only="*.parquet", files_per_trigger=1)


def target(spark):
    path = fresh_dir(spark, "test-out")
    return path, f"{path}-checkpoint"


def split(rows, parts):
    size = len(rows) // parts
    return [rows[i * size : (i + 1) * size if i < parts - 1 else None] for i in range(parts)]


def test_window_sum_in_update_mode_equals_batch(spark):
    rows = event_rows(600)
    feed = Feed(spark)
    for part in split(rows, 3):
        feed.add(part)
    path, checkpoint = target(spark)
    got = to_newest(
        windows.window_sum(feed.stream(), size="30 minutes"), path, ["window_start", "window_end", *KEY], checkpoint=checkpoint
    )
    batch = windows.window_sum(spark.createDataFrame(rows, EVENTS), size="30 minutes")
    columns = ["window_start", *KEY, "quantity_change"]
    assert as_set(got, *columns) == as_set(batch, *columns)


def entries(spark, path):
    store, place = _at(spark, path)
    return [s.getPath().getName() for s in store.listStatus(place)]


def test_a_tiered_table_stays_small_over_many_batches(spark):
    path, _ = target(spark)
    schema = "k long, v long, batch_id long"
    table = Tiers(spark, path, spark.createDataFrame([], schema).schema, newest(["k"]), width=4)
    want = {}
    for n in range(50):
        rows = [(k, 100 * n + k, n) for k in range(n % 7, 20, 3)]
        want |= {k: v for k, v, _ in rows}
        table.commit(spark.createDataFrame(rows, schema).coalesce(1), n)
        if n == 30:  # run again after a crash behind its end, with other files
            table.commit(spark.createDataFrame(rows, schema).coalesce(1), n)
    assert dict(tuple(r) for r in table.read().select("k", "v").collect()) == want
    assert len(table.runs()) <= 4 * 3  # a few of each size: 50 batches are three powers of 4
    assert len(entries(spark, path)) <= 4 * 3 + 5 + 4 and len(entries(spark, f"{path}/manifest")) <= 3


def test_a_batch_that_did_not_end_leaves_nothing(spark):
    path, _ = target(spark)
    schema = "k long, v long, batch_id long"
    table = Tiers(spark, path, spark.createDataFrame([], schema).schema, newest(["k"]))
    table.commit(spark.createDataFrame([(1, 1, 0)], schema), 0)
    table._write(spark.createDataFrame([(1, 9, 1)], schema), "1-0")  # no manifest names it
    store, place = _at(spark, f"{path}/manifest/{1:012d}.json")
    out = store.create(place, True)
    out.write(bytearray(b'{"batch": 1, "ru'))  # torn
    out.close()
    assert [r.v for r in table.read().collect()] == [1]
    table.commit(spark.createDataFrame([(1, 2, 1)], schema), 1)
    assert [r.v for r in table.read().collect()] == [2]


def test_append_mode_emits_closed_windows_once_and_drops_late_rows(spark):
    def row(i, minute, q):
        return (str(i), "A", "W1", q, "ADJUSTED", START + timedelta(minutes=minute))

    # a watermark moves when a micro-batch ends and drops rows from the one after the next on
    feed = Feed(spark).add([row(1, 1, 5)]).add([row(2, 30, 7)]).add([row(7, 31, 2)])
    feed.add([row(3, 2, 100), row(4, 28, 1)])  # 2 is behind the watermark of 20, 28 is not
    feed.add([row(5, 90, 9)]).add([row(6, 91, 1)])
    path, checkpoint = target(spark)
    got = to_table(
        windows.window_sum(feed.stream(), size="10 minutes", watermark="10 minutes"), path, checkpoint=checkpoint
    )
    assert sorted(tuple(r) for r in got.select("window_start", "quantity_change").collect()) == [
        (START, 5), (START + timedelta(minutes=20), 1), (START + timedelta(minutes=30), 9),
    ]


def test_velocity_is_per_minute(spark):
    df = spark.createDataFrame([("1", "A_B", "W1", 30, "X", START), ("2", "A_B", "W1", -60, "X", START)], EVENTS)
    row = windows.window_velocity(df, minutes=15).first()
    assert (row.sku, row.velocity, row.period) == ("A_B", -2.0, 15)


MOVES = "id long, sku string, warehouse_id string, quantity_change int, timestamp timestamp_ntz"
FOUND = ["id", *KEY, "severity", "current_value", "message"]


def shuffled_moves(n=1500, seed=4):
    rng = random.Random(seed)
    return [
        (i, "HOT" if rng.random() < 0.5 else f"S{rng.randint(0, 3)}", "W1",
         rng.choice([1, 2, 3, 2, 1] * 12 + [90, -300]), START + timedelta(seconds=i // 3))
        for i in range(n)
    ]


@pytest.mark.parametrize("per_trigger", [1, 3, 100])
def test_anomalies_equal_batch_however_the_input_is_cut(spark, per_trigger):
    """Files out of order, taken one, three or all at a time."""
    rows, rng = shuffled_moves(), random.Random(9)
    schema = spark.createDataFrame([], MOVES).schema
    feed = Feed(spark, schema)
    parts = split(rng.sample(rows, len(rows)), 5)
    for part in parts:
        feed.add(part)
    stream = src.read_table_files(spark, feed.path, schema, only="*.parquet", files_per_trigger=per_trigger)
    path, checkpoint = target(spark)
    got = run_anomalies(stream, path, checkpoint=checkpoint, delay=timedelta(hours=1))
    want = anomaly.volume_anomalies(spark.createDataFrame(rows, MOVES), block=150)
    assert as_set(got, *FOUND) == as_set(want, *FOUND)
    assert got.filter("severity = 'CRITICAL'").count() > 0
    pairs = got.select("id", F.col("deviation").alias("a")).join(want.select("id", F.col("deviation").alias("b")), "id")
    assert pairs.filter("abs(a - b) > 1e-9").count() == 0


def test_late_movements_are_counted_and_kept_apart(spark):
    rows = shuffled_moves(1200)
    late = [rows[k] for k in (50, 60)]
    schema = spark.createDataFrame([], MOVES).schema
    feed = Feed(spark, schema)
    on_time = [r for r in rows if r not in late]
    for part in (on_time[:400], on_time[400:800], late + [(9999, "HOT", "W1", 5, None)], on_time[800:]):
        feed.add(part)
    path, checkpoint = target(spark)
    got = run_anomalies(feed.stream(), path, checkpoint=checkpoint, delay=timedelta(seconds=30))
    want = anomaly.volume_anomalies(spark.createDataFrame(on_time, MOVES), block=150)
    assert as_set(got, *FOUND) == as_set(want, *FOUND)
    waiting = Waiting(spark.createDataFrame([], schema), f"{path}/rows")
    assert as_set(waiting.late(), "id") == {(50,), (60,), (9999,)} and waiting.manifests.before()["late"] == 3


def test_a_stream_that_goes_on_after_its_end(spark):
    """What waited at the end was handed out, and is handed out again with what came after."""
    rows = shuffled_moves(900)
    feed = Feed(spark, spark.createDataFrame([], MOVES).schema).add(rows[:300]).add(rows[300:600])
    path, checkpoint = target(spark)
    run_anomalies(feed.stream(), path, checkpoint=checkpoint, delay=timedelta(minutes=2))
    feed.add(rows[600:])
    got = run_anomalies(feed.stream(), path, checkpoint=checkpoint, delay=timedelta(minutes=2))
    want = anomaly.volume_anomalies(spark.createDataFrame(rows, MOVES), block=150)
    assert as_set(got, *FOUND) == as_set(want, *FOUND)


def test_totals_go_on_after_a_restart(spark):
    rows = event_rows(400, seed=2)
    feed = Feed(spark).add(rows[:150])
    path, checkpoint = target(spark)
    state.run_event_totals(feed.stream(), path, checkpoint=checkpoint)
    feed.add(rows[150:])
    got = state.run_event_totals(feed.stream(), path, checkpoint=checkpoint)
    want = events.event_totals(spark.createDataFrame(rows, EVENTS))
    columns = [*KEY, "event_count", "quantity_changed"]
    assert as_set(got, *columns) == as_set(want, *columns)
    # nothing new: nothing changes
    again = state.run_event_totals(feed.stream(), path, checkpoint=checkpoint)
    assert as_set(again, *columns) == as_set(want, *columns)


def test_a_retried_batch_replaces_itself(spark):
    path, _ = target(spark)
    parts = [state.batch_state(spark.createDataFrame(event_rows(50, seed=n), EVENTS)) for n in (1, 9)]
    table = Tiers(spark, path, parts[0].schema, state.merged_state)
    for part, number in ((parts[0], 0), (parts[0], 0), (parts[1], 1), (parts[1], 1)):
        table.commit(part, number)
    both = spark.createDataFrame(event_rows(50, seed=1) + event_rows(50, seed=9), EVENTS)
    columns = [*KEY, "reserved", "low_stock"]
    assert as_set(state.fold_state(table.read()), *columns) == as_set(state.fold_state(state.batch_state(both)), *columns)


def test_event_state_over_micro_batches(spark):
    rows = event_rows(300, seed=3)
    feed = Feed(spark)
    for part in split(rows, 3):
        feed.add(part)
    path, checkpoint = target(spark)
    got = state.run_event_state(feed.stream(), path, checkpoint=checkpoint)
    want = state.fold_state(state.batch_state(spark.createDataFrame(rows, EVENTS)))
    assert set(map(tuple, got.collect())) == set(map(tuple, want.collect()))


def test_metrics_job_quarantines_and_alerts(spark, ledger):
    base = fresh_dir(spark, "test-etl")
    lines = [
        '{"sku":"A","warehouse":"W","quantityChange":-3}', '{"sku":"A","warehouse":"W","quantityChange":-4}',
        "{broken", '{"sku":"B","warehouseId":"W"}',
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{base}/topic")
    now = datetime(2024, 1, 31)
    log = ledger([
        (n, "A", "W", -q, "SALE", (now - timedelta(days=n)).isoformat())
        for n, q in enumerate([900, 1, 1, 1, 300, 1, 1, 1, 1, 1, 500] + [1] * 25)
    ])
    log.repartition(3).write.parquet(f"{base}/ledger")
    moves = src.read_table_files(spark, f"{base}/ledger", log.schema, only="*.parquet", files_per_trigger=1)
    sold = run_days(moves, f"{base}/days", checkpoint=f"{base}/days-checkpoint")
    assert sold.read().agg(F.sum("transaction_count")).first()[0] == log.count()
    got = run_metrics(src.read_json_lines(spark, f"{base}/topic"), sold, as_of=now, path=base, checkpoint=f"{base}/checkpoint")
    metrics = got.read()
    assert as_set(metrics, "sku") == {("A",), ("B",)} and metrics.count() == 2
    assert as_set(spark.read.parquet(f"{base}/quarantine"), "value") == {("{broken",)}
    assert as_set(spark.read.parquet(f"{base}/alerts"), "sku", "risk_score") == {("A", 0.8)}


def test_enriched_stream_equals_batch(spark):
    rows = event_rows(300)
    feed = Feed(spark)
    for part in split(rows, 3):
        feed.add(part)
    history = spark.createDataFrame([("HOT", "W1", 7), ("S1", "W1", 2)], "sku string, warehouse_id string, sales long")
    path, checkpoint = target(spark)
    got = run_enriched(feed.stream(), history, path, checkpoint=checkpoint)
    known = {"HOT": 7, "S1": 2}
    assert as_set(got, "event_id", "sku", "sales") == {(r[0], r[1], known.get(r[1])) for r in rows}


def test_routed_folders(spark):
    feed = Feed(spark).add(event_rows(100))
    path, checkpoint = target(spark)
    got = state.run_routed(feed.stream(), path, checkpoint=checkpoint)
    assert got.count() == 100
    assert as_set(got.filter("event_type = 'LOW_STOCK'"), "index_name") == {("inventory-alerts",)}


def test_stream_without_input_gives_an_empty_table(spark):
    feed = Feed(spark).add([])
    path, checkpoint = target(spark)
    assert to_table(events.stock_alerts(feed.stream()), path, checkpoint=checkpoint).count() == 0


@pytest.mark.parametrize(
    ("levels", "want"),
    [
        ([(0, 5), (5, 12)], [(0, 5)]),  # low for exactly five minutes
        ([(0, 5), (4, 12)], []),
        ([(0, 12), (1, 9), (3, 8), (7, 3), (9, 10)], [(1, 9)]),
        ([(0, 5)], []),  # no later report: known for one minute
        ([(0, 5), (1, 20), (2, 5), (30, 20)], [(2, 30)]),
    ],
)
def test_sustained_low_stock(spark, levels, want):
    rows = [("A", "W1", START + timedelta(minutes=m, seconds=10), q) for m, q in levels]
    df = spark.createDataFrame(rows, "sku string, warehouse_id string, timestamp timestamp_ntz, quantity int")
    minutes = windows.minute_levels(df, by=KEY, value="quantity")
    got = windows.sustained_low(minutes, by=KEY)
    assert as_set(got, "low_since", "until") == {
        (START + timedelta(minutes=a), START + timedelta(minutes=b)) for a, b in want
    }


@pytest.mark.parametrize("per_trigger", [1, 2, 100])
def test_sustained_low_stock_on_a_stream(spark, per_trigger):
    """Low runs that last over many micro-batches, in files whose order is not that of time."""
    rng = random.Random(5)
    rows, schema = [], "sku string, warehouse_id string, timestamp timestamp_ntz, quantity int"
    for sku in ("A", "B", "C"):
        level = 20
        for minute in range(0, 300):
            level = max(0, min(30, level + rng.randint(-6, 6)))
            if rng.random() < 0.6:
                rows.append((sku, "W1", START + timedelta(minutes=minute, seconds=rng.randint(0, 59)), level))
    rows.sort(key=lambda r: r[2])
    feed = Feed(spark, spark.createDataFrame([], schema).schema)
    for part in split(rows, 6):
        feed.add(rng.sample(part, len(part)))
    stream = src.read_table_files(spark, feed.path, feed.schema, only="*.parquet", files_per_trigger=per_trigger)
    path, checkpoint = target(spark)
    got = windows.run_sustained_low(stream, path, by=KEY, value="quantity", checkpoint=checkpoint, delay=timedelta(minutes=7))
    minutes = windows.minute_levels(spark.createDataFrame(rows, schema), by=KEY, value="quantity")
    columns = [*KEY, "low_since", "until", "highest", "severity"]
    want = as_set(windows.sustained_low(minutes, by=KEY), *columns)
    assert as_set(got, *columns) == want and len(want) > 5


def test_waiting_rows_stay_where_they_are(spark):
    """Batches that move no time on cost no step, and what waits is not written anew by each batch."""
    path, _ = target(spark)
    part = lambda n, minute: spark.createDataFrame([(n, START), (-n, START + timedelta(minutes=minute))], "id long, timestamp timestamp_ntz")
    waiting, steps = Waiting(part(1, 5), path, delay=timedelta(minutes=7)), []
    step = lambda ready, done, n: steps.append((n, {r.id for r in ready.collect()}))
    for n in range(FOLDERS + 3):
        waiting.advance(part(n + 1, 5), n, step)
    every = {*range(-FOLDERS - 3, 0), *range(1, FOLDERS + 4)}
    assert steps == [(0, set())] and len(waiting.manifests.before()["waiting"]) == 4
    waiting.advance(part(100, 8), FOLDERS + 3, step)  # this moves the watermark over the first rows
    waiting.advance(None, FOLDERS + 4, step)
    assert steps[1:] == [(FOLDERS + 3, {n for n in every if n > 0} | {100}), (FOLDERS + 4, {n for n in every if n < 0} | {-100})]


def test_rates_over_sliding_windows(spark):
    df = spark.createDataFrame([(START + timedelta(minutes=2), "error")] * 60, "ts timestamp_ntz, event_type string")
    rates = windows.request_rate(df, by=["event_type"])
    assert rates.count() == 5 and as_set(rates, "rate") == {(0.2,)}
    assert windows.error_rate_alerts(rates, above=0.2).count() == 0
    assert windows.error_rate_alerts(rates, above=0.1).count() == 5


def test_micro_batches_are_bounded(spark):
    feed = Feed(spark)
    for part in split(event_rows(50), 5):
        feed.add(part)
    seen = []
    _, checkpoint = target(spark)
    run_available(feed.stream(), lambda df, n: seen.append(df.count()), checkpoint=checkpoint)
    assert seen == [10] * 5


def test_topic_options():
    got = src.topic_options("h:1", earliest=False, max_per_trigger=5)
    assert got["startingOffsets"] == "latest" and got["maxOffsetsPerTrigger"] == "5"
