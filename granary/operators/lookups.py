"""Filters, projections and pages over items, the ledger and the catalog.

Every filter is a plain column predicate, so it reaches the scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import stock, text
from granary.functions.timing import at


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values: point and list lookups alike."""
    for column, value in values.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def low_stock(
    items: DataFrame, *, threshold: int | None = None, warehouse_id: str | None = None
) -> DataFrame:
    """Available at or below the threshold, or below each item's own reorder point."""
    low = stock.needs_reorder() if threshold is None else stock.available() <= threshold
    if warehouse_id is not None:
        low = low & (F.col("warehouse_id") == warehouse_id)
    return items.filter(low)


def overstocked(items: DataFrame) -> DataFrame:
    return items.filter(stock.is_overstocked())


def stock_check_due(items: DataFrame, *, cutoff: datetime) -> DataFrame:
    checked = F.col("last_stock_check")
    return items.filter((checked < at(cutoff)) | checked.isNull())


def with_reservations(items: DataFrame) -> DataFrame:
    return items.filter(F.col("quantity_reserved") > 0)


def inventory_response(items: DataFrame) -> DataFrame:
    """Items with their derived columns."""
    return items.withColumns({
        "available_quantity": stock.available(),
        "total_quantity": stock.total_quantity(),
        "current_value": stock.stock_value(),
        "needs_reorder": stock.needs_reorder(),
    })


def items_needing_reorder(items: DataFrame) -> DataFrame:
    return inventory_response(low_stock(items))


def with_derived_status(items: DataFrame) -> DataFrame:
    return items.withColumn("derived_status", stock.derived_status())


def in_date_range(ledger: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Both ends included."""
    return ledger.filter(F.col("timestamp").between(at(start), at(end)))


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_active"))


def search_products(products: DataFrame, term: str) -> DataFrame:
    return active(products).filter(text.matches_any(term, "name", "sku"))


def search_products_literal(products: DataFrame, term: str) -> DataFrame:
    return products.filter(text.contains_any(term, "name", "sku", "description"))


def search_categories(categories: DataFrame, term: str) -> DataFrame:
    return active(categories).filter(text.matches_any(term, "name"))


def search_warehouses(warehouses: DataFrame, term: str) -> DataFrame:
    return active(warehouses).filter(text.matches_any(term, "name", "warehouse_id"))


def existing(candidates: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Candidate rows whose key is already in the table: one semi join for the whole batch."""
    return candidates.join(table.select(key), key, "left_semi")


def page(
    df: DataFrame, *, sort_by: str = "id", descending: bool = False, number: int = 0, size: int = 10
) -> DataFrame:
    """One page; ties are broken by id so that pages never overlap."""
    first = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    order: list[Column] = [first] if sort_by == "id" else [first, F.col("id").asc()]
    return df.orderBy(*order).offset(number * size).limit(size)


def newest(products: DataFrame, count: int = 5, by: str = "created_at") -> DataFrame:
    return products.orderBy(F.col(by).desc(), F.col("id").asc()).limit(count)
