"""Batch readers. Every reader takes an explicit schema; none infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import schemas

TABLES: dict[str, T.StructType] = {
    "inventory_items": schemas.ITEMS,
    "inventory_transactions": schemas.LEDGER,
    "products": schemas.PRODUCTS,
    "categories": schemas.CATEGORIES,
    "warehouses": schemas.WAREHOUSES,
}


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_jdbc(
    spark: SparkSession,
    *,
    url: str,
    table: str,
    bounds: tuple[int, int],
    partitions: int,
    partition_column: str = "id",
    fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A relational table in `partitions` ranges of its numeric key, read side by side.

    The driver's jar must be on the class path. Filters and columns are pushed to the database.
    """
    return spark.read.format("jdbc").options(
        **jdbc_options(
            url=url, table=table, bounds=bounds, partitions=partitions,
            partition_column=partition_column, fetch_size=fetch_size, properties=properties,
        )
    ).load()


def jdbc_options(
    *,
    url: str,
    table: str,
    bounds: tuple[int, int],
    partitions: int,
    partition_column: str = "id",
    fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> dict[str, str]:
    lower, upper = bounds
    if lower > upper or partitions < 1:
        raise ValueError("bounds must be ascending and partitions positive")
    return {
        **(properties or {}),
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def read_ledger_documents(spark: SparkSession, path: str, *, fmt: str = "json") -> DataFrame:
    """The document-store export of the ledger, with its `quantity` under the ledger's name.

    A store with a Spark connector is read with that connector's format name instead.
    """
    documents = spark.read.schema(schemas.LEDGER_DOCUMENT).format(fmt).load(path)
    return documents.withColumnRenamed("quantity", "quantity_change")


def as_documents(ledger: DataFrame) -> DataFrame:
    """Ledger rows in the shape of the document store."""
    return ledger.select(
        "sku", "warehouse_id", F.col("quantity_change").alias("quantity"),
        "transaction_type", "timestamp",
    )
