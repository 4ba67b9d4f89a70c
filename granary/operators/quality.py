"""Data quality: counted rules, constraint violations, and one report over all of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import stock
from granary.functions.timing import days_before
from granary.schemas import KEY, STATUSES

# Rule name, condition of a failing row, label in the report.
INVENTORY_RULES = {
    "negative_inventory": ("quantity_on_hand < 0", "Negative inventory"),
    "over_reserved": ("quantity_reserved > quantity_on_hand", "Over-reserved items"),
    "negative_reorder_point": ("reorder_point < 0", "Negative reorder points"),
    "negative_reorder_quantity": ("reorder_quantity < 0", "Negative reorder quantities"),
    "missing_sku": ("sku IS NULL OR sku = ''", "Missing SKUs"),
    "missing_warehouse_id": ("warehouse_id IS NULL OR warehouse_id = ''", "Missing warehouse IDs"),
    "negative_unit_cost": ("unit_cost < 0", "Negative unit costs"),
}

PRODUCT_RULES = {
    "missing_sku": ("sku IS NULL OR sku = ''", "Missing SKUs"),
    "missing_name": ("name IS NULL OR name = ''", "Missing names"),
    "negative_price": ("price < 0", "Negative prices"),
    "missing_category": ("category_id IS NULL", "Missing categories"),
}

GATE_RULES = ["negative_inventory", "over_reserved", "negative_reorder_point"]
WIDE_GATE_RULES = [*GATE_RULES, "missing_sku", "missing_warehouse_id"]


def _transaction_rules(as_of: datetime) -> dict[str, tuple[str, str]]:
    now = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return {
        "missing_sku": ("sku IS NULL OR sku = ''", "Missing SKUs"),
        "missing_warehouse_id": ("warehouse_id IS NULL OR warehouse_id = ''", "Missing warehouse IDs"),
        "zero_quantity_change": ("quantity_change = 0", "Zero quantity changes"),
        "missing_transaction_type": (
            "transaction_type IS NULL OR transaction_type = ''", "Missing transaction types"
        ),
        "missing_timestamp": ("timestamp IS NULL", "Missing timestamps"),
        "future_timestamp": (f"timestamp > CAST('{now}' AS TIMESTAMP_NTZ)", "Future timestamps"),
    }


def _count(df: DataFrame, rules: dict[str, tuple[str, str]], total: str | None = None) -> DataFrame:
    """All rules in one pass, one row."""
    counts = [F.count_if(F.expr(failing)).alias(name) for name, (failing, _) in rules.items()]
    return df.agg(*counts, *([F.count(F.lit(1)).alias(total)] if total else []))


def check_inventory(items: DataFrame) -> DataFrame:
    return _count(items.filter(stock.not_discontinued()), INVENTORY_RULES, "total_records")


def check_transactions(
    ledger: DataFrame, *, as_of: datetime, days: int | None = 30
) -> DataFrame:
    """The window drops rows without a timestamp, so `missing_timestamp` is 0 unless `days`
    is None, which checks the whole ledger."""
    rows = ledger if days is None else ledger.filter(F.col("timestamp") >= days_before(as_of, days))
    return _count(rows, _transaction_rules(as_of), "total_transactions")


def check_products(products: DataFrame) -> DataFrame:
    return _count(products.filter(F.col("is_active")), PRODUCT_RULES, "total_products")


def snapshot_gate(items: DataFrame, *, wide: bool = False) -> DataFrame:
    """The check before a snapshot is loaded; `wide` adds the two missing-key rules."""
    names = WIDE_GATE_RULES if wide else GATE_RULES
    return _count(items.filter(stock.not_discontinued()), {n: INVENTORY_RULES[n] for n in names})


def _tidy(counts: DataFrame, rules: dict, total: str, dataset: str, noun: str) -> DataFrame:
    """One counted row to one row per rule."""
    return counts.select(
        F.lit(dataset).alias("dataset"),
        F.col(total).alias("total_records"),
        F.explode(F.array(*[
            F.struct(
                F.lit(name).alias("check"),
                F.col(name).alias("failures"),
                F.concat(F.lit(label + ": "), F.col(name).cast("string"), F.lit(" " + noun)).alias("text"),
            )
            for name, (_, label) in rules.items()
        ])).alias("r"),
    ).select("dataset", "total_records", "r.check", "r.failures", "r.text")


def quality_checks(
    items: DataFrame, ledger: DataFrame, products: DataFrame, *, as_of: datetime
) -> DataFrame:
    """Every rule of the three tables as (dataset, total_records, check, failures, text)."""
    parts = [
        _tidy(check_inventory(items), INVENTORY_RULES, "total_records", "inventory", "records"),
        _tidy(
            check_transactions(ledger, as_of=as_of), _transaction_rules(as_of),
            "total_transactions", "transactions", "transactions",
        ),
        _tidy(check_products(products), PRODUCT_RULES, "total_products", "products", "products"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def quality_report(checks: DataFrame) -> DataFrame:
    """Per dataset and overall: records, number of broken rules, their texts, PASS or FAIL.

    The texts are one short line per rule of the fixed rule lists above.
    """
    broken = F.col("failures") > 0
    text = F.array_join(F.array_sort(F.collect_list(F.when(broken, F.col("text")))), "; ")
    # a dataset's total is repeated on each of its rules; the overall row has no such total
    per_set = checks.groupBy("dataset").agg(
        F.max("total_records").alias("total_records"),
        F.count_if(broken).alias("issue_count"),
        text.alias("issues"),
    )
    # three rows by now; each also counts toward the summary, without a second pass
    row = F.struct("dataset", "total_records", "issue_count", "issues")
    toward = F.struct(
        F.lit("summary").alias("dataset"), "total_records", "issue_count", F.lit("").alias("issues")
    )
    return (
        per_set.select(F.explode(F.array(row, toward)).alias("r"))
        .groupBy("r.dataset")
        .agg(
            F.sum("r.total_records").alias("total_records"),
            F.sum("r.issue_count").alias("issue_count"),
            F.max("r.issues").alias("issues"),
        )
        .withColumn("status", F.when(F.col("issue_count") == 0, "PASS").otherwise("FAIL"))
    )


# -- constraints --------------------------------------------------------------------------


# Bounds of each column. A rule that is NULL for a row is not broken.
ITEM_CONSTRAINTS = {
    "sku_required": "sku IS NULL",
    "sku_size_3_50": "length(sku) NOT BETWEEN 3 AND 50",
    "warehouse_required": "warehouse_id IS NULL",
    "warehouse_size_2_20": "length(warehouse_id) NOT BETWEEN 2 AND 20",
    "on_hand_min_0": "quantity_on_hand IS NULL OR quantity_on_hand < 0",
    "reserved_min_0": "quantity_reserved IS NULL OR quantity_reserved < 0",
    "in_transit_min_0": "quantity_in_transit IS NULL OR quantity_in_transit < 0",
    "reorder_point_min_0": "reorder_point IS NULL OR reorder_point < 0",
    "reorder_quantity_min_0": "reorder_quantity IS NULL OR reorder_quantity < 0",
    "status_domain": "inventory_status NOT IN ({})".format(", ".join(f"'{s}'" for s in STATUSES)),
}

PRODUCT_CONSTRAINTS = {
    "sku_not_blank": "sku IS NULL OR trim(sku) = ''",
    "sku_size_3_50": "length(sku) NOT BETWEEN 3 AND 50",
    "name_not_blank": "name IS NULL OR trim(name) = ''",
    "name_size_2_200": "length(name) NOT BETWEEN 2 AND 200",
    "description_max_1000": "length(description) > 1000",
    "price_min_0": "price < 0",
}

WAREHOUSE_CONSTRAINTS = {
    "warehouse_id_not_blank": "warehouse_id IS NULL OR trim(warehouse_id) = ''",
    "warehouse_id_size_2_20": "length(warehouse_id) NOT BETWEEN 2 AND 20",
    "name_not_blank": "name IS NULL OR trim(name) = ''",
    "name_size_2_200": "length(name) NOT BETWEEN 2 AND 200",
    "address_max_500": "length(address) > 500",
    "city_max_100": "length(city) > 100",
    "state_max_100": "length(state) > 100",
    "country_max_100": "length(country) > 100",
    "postal_code_max_20": "length(postal_code) > 20",
}

CATEGORY_CONSTRAINTS = {
    "name_not_blank": "name IS NULL OR trim(name) = ''",
    "name_size_2_100": "length(name) NOT BETWEEN 2 AND 100",
    "description_max_500": "length(description) > 500",
}


def violations(df: DataFrame, constraints: dict[str, str], *, identity: list[str]) -> DataFrame:
    """One row per broken constraint of a row: the identity columns and the rule's name."""
    broken = F.array_compact(F.array(*[
        F.when(F.expr(rule), F.lit(name)) for name, rule in constraints.items()
    ]))
    return df.select(*identity, F.explode(broken).alias("violation"))


def duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return (
        df.groupBy(*(keys or KEY)).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")
    )
