"""Insert, update and soft delete as joins of the old table with a batch of rows.

Batches must hold one row per key; `latest_per_key` makes one out of a longer log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, as an aggregate with map-side combine (no window)."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def upsert(
    old: DataFrame, new: DataFrame, keys: list[str], *, update: list[str] | None = None
) -> DataFrame:
    """Rows of `new` whose key exists replace the `update` columns (default: all) of the old
    row; the others are added. Columns not in `update` keep the old value on conflict."""
    columns = old.columns
    update = [c for c in columns if c not in keys] if update is None else update
    left = old.select(*keys, F.struct(*columns).alias("_old"))
    right = new.select(*keys, F.struct(*columns).alias("_new"))

    def merged(c: str) -> Column:
        if c in keys:
            return F.col(c)
        fresh = F.col(f"_new.{c}")
        if c in update:
            return F.when(F.col("_new").isNotNull(), fresh).otherwise(F.col(f"_old.{c}")).alias(c)
        return F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(fresh).alias(c)

    return left.join(right, keys, "full_outer").select(*[merged(c) for c in columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add only the rows whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def update_columns(
    table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]
) -> DataFrame:
    """Set columns by key; keys that are not in the table are ignored."""
    right = changes.select(*keys, F.struct(*columns).alias("_set"))
    hit = F.col("_set").isNotNull()
    return table.join(right, keys, "left").select(*[
        F.when(hit, F.col(f"_set.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in table.columns
    ])


def soft_delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    off = gone.select(key).distinct().withColumn("is_active", F.lit(False))
    return update_columns(table, off, [key], ["is_active"])
