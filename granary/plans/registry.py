"""The list of registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.plans.views import Tables, sql_with_views


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None
    views: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, *, views: str = "") -> Callable:
    """Register a function of the tables under a name, with its SQL and the views that reads."""

    def keep(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(run, sql, tuple(views.split()))
        return run

    return keep


def present(df: DataFrame) -> DataFrame:
    """Types that compare the same in every engine: floats to 6 places, decimals as floats,
    dates and times as text."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType | T.FloatType | T.DecimalType):
            # adding 0.0 turns a negative zero into zero
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            column = column.cast("string")
        out.append(column.alias(field.name))
    return df.select(*out)


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: present(q.run(Tables(spark, folder)))

    return {name: bind(q) for name, q in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {
        name: sql_with_views(q.sql, list(q.views)) for name, q in QUERIES.items() if q.sql is not None
    }
