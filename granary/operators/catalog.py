"""Products, categories and warehouses: joins, counts and validated changes.

The joins carry no broadcast hint: categories are expected to be small, but nothing bounds
them here, so the choice is left to the optimizer and its size estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators.lookups import active
from granary.session import enable_checkpoints


def product_with_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    names = categories.select(
        F.col("id").alias("category_id"), F.col("name").alias("category_name")
    )
    return products.join(names, "category_id", "left").withColumn(
        "category_label", F.coalesce("category_name", F.lit("Uncategorized"))
    )


def category_with_parent(categories: DataFrame) -> DataFrame:
    parents = categories.select(
        F.col("id").alias("parent_category_id"), F.col("name").alias("parent_category_name")
    )
    return categories.join(parents, "parent_category_id", "left")


def missing_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products that name a category that does not exist."""
    ids = categories.select(F.col("id").alias("category_id"))
    return products.filter(F.col("category_id").isNotNull()).join(ids, "category_id", "left_anti")


def dimension_counts(
    products: DataFrame, categories: DataFrame, warehouses: DataFrame
) -> DataFrame:
    """Tidy rows (metric, key, n)."""

    def count(df: DataFrame, metric: str, key: str | None = None) -> DataFrame:
        if key is None:
            n = df.agg(F.count(F.lit(1)).alias("n"))
            return n.select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")
        n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return n.select(F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key"), "n")

    return (
        count(active(products), "active_products")
        .unionByName(count(products, "products_in_category", "category_id"))
        .unionByName(count(active(categories), "active_categories"))
        .unionByName(count(categories, "child_categories", "parent_category_id"))
        .unionByName(count(active(warehouses), "active_warehouses"))
    )


def judge_changes(
    table: DataFrame,
    requests: DataFrame,
    *,
    unique: str,
    parent: str | None = None,
    parents: DataFrame | None = None,
) -> DataFrame:
    """Each create or update request with the reason it is rejected, NULL when accepted.

    `requests` has the table's columns and `request_id`; a NULL `id` asks for a new row, any
    other for an update. `parent`, when given, must be the id of a row of `parents`, and `unique` must not belong to
    another row at that time: requests are taken in the order of request_id, each sees what those accepted before
    it have left. So an update may follow an update, and a value that a row gives up is free again, or, where several
    rows of the table have it, once all others have given it up.

    Whether a request is accepted depends on those before it that share its value or its row. All are judged side by side from a
    guess, that every value is free, and again from what that gave, until no verdict
    changes; each round makes at least one more request of every chain exact. Rounds are checkpointed.
    """
    enable_checkpoints(table.sparkSession)
    known = table.select(F.col("id").alias("_known")).hint("merge")  # a row each: the table may be large however small its file
    judged = requests.join(known, F.col("id") == F.col("_known"), "left").withColumn(
        "_missing", F.col("id").isNotNull() & F.col("_known").isNull())
    if parent is not None and parents is not None:
        pid = parents.select(F.col("id").alias("_parent"))
        judged = judged.join(pid, F.col(parent) == F.col("_parent"), "left").withColumn(
            "_orphan", F.col(parent).isNotNull() & F.col("_parent").isNull())
    else:
        judged = judged.withColumn("_orphan", F.lit(False))
    judged = judged.select(*requests.columns, "_missing", "_orphan").checkpoint()

    def row(kind: int, number: str) -> Column:
        """A row of the table (0), or the one that a request makes (1)."""
        return F.struct(F.lit(kind).alias("kind"), F.col(number).cast("bigint").alias("id")).alias("_row")

    asked = judged.filter(~F.col("_missing")).select(
        F.col("request_id").cast("bigint").alias("_at"),
        F.when(F.col("id").isNull(), row(1, "request_id")).otherwise(row(0, "id")).alias("_row"),
        F.col(unique).alias("_value"), "_orphan",
    )
    rows = table.select(row(0, "id"), F.col(unique).alias("_value"))
    concerned = rows.join(asked.select("_row").distinct(), "_row", "left_semi").unionByName(
        rows.join(asked.select("_value").distinct(), "_value", "left_semi").select(*rows.columns)).distinct()
    # what no verdict changes: the values at the start, and those given up for none, as a NULL is always free
    fixed = concerned.select(F.lit(-1).cast("bigint").alias("_at"), "_row", "_value").unionByName(
        asked.filter("_value is null and not _orphan").select("_at", "_row", "_value")).checkpoint()
    verdicts = asked.filter("_value is not null").withColumn("_free", F.lit(True)).checkpoint()
    before = (W.unboundedPreceding, -1)
    own = W.partitionBy("_value", "_row").orderBy("_at", "_kind").rowsBetween(*before)
    along = W.partitionBy("_value").orderBy("_at", "_kind").rowsBetween(*before)
    while True:
        # the values that each row holds in turn
        held = verdicts.filter("_free and not _orphan").select("_at", "_row", "_value").unionByName(fixed)
        held = held.withColumn("_before", F.lag("_value").over(W.partitionBy("_row").orderBy("_at", "_value")))
        # each time a row takes a value or gives it up, and each time it is asked for
        taken = held.filter("_value is not null").select(
            "_at", "_row", "_value", F.lit(1).alias("_kind"), F.lit(1).alias("_holds"))
        given = held.filter("_before is not null and not _before <=> _value").select(
            "_at", "_row", F.col("_before").alias("_value"), F.lit(0).alias("_kind"), F.lit(0).alias("_holds"))
        asks = verdicts.withColumn("_kind", F.lit(-1))
        events = asks.unionByName(taken.unionByName(given), allowMissingColumns=True).repartition("_value")
        # whether the row holds the value already, and how many rows do: counted, as several may from the start, in no order
        events = events.withColumn("_own", F.coalesce(F.last("_holds", ignorenulls=True).over(own), F.lit(0)))
        holders = F.coalesce(F.sum(F.col("_holds") - F.col("_own")).over(along), F.lit(0))
        found = events.withColumn("_now", holders == F.col("_own")).filter("_kind = -1").select(
            *asked.columns, F.col("_free").alias("_was"), F.col("_now").alias("_free")).checkpoint()
        verdicts = found.drop("_was")
        if found.filter("_was <> _free").isEmpty():
            break
    late = verdicts.filter(~F.col("_free")).select(F.col("_at").alias("request_id"), F.lit(True).alias("_late"))
    reason = (
        F.when(F.col("_missing"), "NOT_FOUND").when(F.col("_late"), "DUPLICATE").when(F.col("_orphan"), "PARENT_NOT_FOUND")
    )
    return judged.join(late, "request_id", "left").withColumn("rejection", reason).select(*requests.columns, "rejection")


def apply_changes(table: DataFrame, judged: DataFrame) -> DataFrame:
    """The table after the accepted requests; of several for one row the last one wins.

    A new row takes the id `max id + request_id`; a NULL is_active means TRUE on a new row and
    no change on an old one, where the last that is not NULL counts.
    """
    good = judged.filter(F.col("rejection").isNull())
    columns = table.columns
    top = table.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = good.filter(F.col("id").isNull()).withColumns({
        "id": (top + F.col("request_id")).cast("bigint"),
        "is_active": F.coalesce("is_active", F.lit(True)),
    }).select(*columns)
    edits = good.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.max_by(F.struct(*[c for c in columns if c not in ("id", "is_active")]), "request_id").alias("_last"),
        F.max_by("is_active", F.when(F.col("is_active").isNotNull(), F.col("request_id"))).alias("_active"),
    ).select("id", F.struct("_last.*", F.col("_active").alias("is_active")).alias("_set"))
    hit = F.col("_set").isNotNull()
    kept = table.join(edits, "id", "left").select(*[
        F.col("id") if c == "id"
        else F.when(hit, F.coalesce(F.col(f"_set.{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
        if c == "is_active"
        else F.when(hit, F.col(f"_set.{c}")).otherwise(F.col(c)).alias(c)
        for c in columns
    ])
    return kept.unionByName(fresh)
