from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession

from granary.session import local_session

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return local_session(8, shuffle_partitions=4)


@pytest.fixture
def ledger(spark):
    """Ledger rows out of (id, sku, warehouse, change, type, time) tuples."""

    def make(rows) -> DataFrame:
        return spark.createDataFrame(
            [(i, s, w, q, k, None if t is None else datetime.fromisoformat(t)) for i, s, w, q, k, t in rows],
            "id long, sku string, warehouse_id string, quantity_change int, "
            "transaction_type string, timestamp timestamp_ntz",
        )

    return make


@pytest.fixture
def items(spark):
    """Items with defaults; each row is a dict of what differs."""
    from granary.schemas import ITEMS

    base = {
        "id": None, "sku": "AAA", "warehouse_id": "W1", "quantity_on_hand": 100, "quantity_reserved": 10,
        "quantity_in_transit": 0, "reorder_point": 20, "reorder_quantity": 50, "unit_cost": None,
        "holding_cost_per_unit": None, "stockout_cost_per_unit": None, "inventory_status": "NORMAL",
        "last_stock_check": None, "last_reorder_date": None, "created_at": None, "updated_at": None,
        "version": 0,
    }

    def make(*rows: dict) -> DataFrame:
        full = [{**base, **r} for r in rows]
        return spark.createDataFrame([tuple(r[f] for f in ITEMS.fieldNames()) for r in full], ITEMS)

    return make


def as_set(df: DataFrame, *columns: str) -> set[tuple]:
    return {tuple(r) for r in df.select(*columns).collect()}
