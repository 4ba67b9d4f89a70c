"""Every registered query equals its SQL on a whole folder of the given tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from tools.check_queries import compare, rows_of


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_its_sql(spark, name):
    if name in LEARNED:
        pytest.skip("too little history in the smallest tables; see test_learning.py")
    ok, note = compare(spark, SMALL, name)
    assert ok, note


LEARNED = {
    "train_random_forest", "train_gbt", "ensemble_predict", "deploy_model",
}


def test_sensitive_anomalies_of_built_rows(spark, tmp_path):
    """A key of more than two blocks, rows of one moment, and a key that never changes."""
    rng = random.Random(3)
    rows = [
        (i, datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 90)), 1, "purchase", float(rng.choice([1, 2, 3, 40, 90])))
        for i in range(0, 1200, 4)
    ] + [(i, datetime(2024, 1, 1) + timedelta(minutes=i), 2, "view", 5.0) for i in range(1, 200, 4)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    cursor = db.execute(contract.oracle_sql()["volume_anomaly_sensitive"])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got = contract.queries()["volume_anomaly_sensitive"](spark, str(tmp_path))
    assert rows_of(got.columns, got.collect()) == want and len(want) > 5


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_oracles_name_known_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
