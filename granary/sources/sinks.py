"""Writers. Each one can be run again with the same input and leaves the same table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.timing import at
from granary.operators.events import as_messages, with_index_name
from granary.operators.upsert import upsert
from granary.session import enable_checkpoints

#: Partitions that a filter names one by one.
NAMED = 200
# microseconds, which the JSON writer would cut off by default
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions that `df` holds."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def archive_metrics(metrics: DataFrame, path: str, *, processed_at: datetime) -> None:
    """Metrics of one run under its own processed_at, in a folder per day and run."""
    stamped = metrics.withColumns({
        "processed_at": at(processed_at),
        "processed_date": F.lit(processed_at.strftime("%Y-%m-%d")),
        "run": F.lit(run_name(processed_at)),
    })
    write_partitions(stamped, path, ["processed_date", "run"])


def run_name(at_time: datetime) -> str:
    return at_time.strftime("%Y%m%d_%H%M%S")


def append_metrics(metrics: DataFrame, path: str, *, processed_at: datetime) -> None:
    """Metrics of one run, in a folder per run that a repeated run replaces."""
    stamped = metrics.withColumns({"processed_at": at(processed_at), "run": F.lit(run_name(processed_at))})
    write_partitions(stamped, path, ["run"])


def upsert_partitions(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    *,
    schema: T.StructType,
    keys: list[str],
    by: str,
    update: list[str] | None = None,
) -> None:
    """Merge a batch into a parquet table partitioned by one of its key columns.

    Only partitions that the batch names are read, or, if they are many, those between the least and the greatest,
    and of these the rows of named ones are kept. The batch is computed once, and the merged rows are checkpointed
    before they replace those partitions, so no plan reads the files it is replacing. A batch without rows changes nothing.
    """
    if by not in keys:
        raise ValueError("the partition column must be part of the key")
    enable_checkpoints(spark)
    new = new.select(*schema.fieldNames()).checkpoint()
    names = new.select(by).distinct()
    few = [r[0] for r in names.limit(NAMED + 1).collect()]
    if not few:
        return
    stored = spark.read.schema(schema).parquet(path)
    if len(few) <= NAMED:
        old = stored.filter(F.col(by).isin(few))
    else:
        low, high = new.agg(F.min(by), F.max(by)).first()
        old = stored.filter(F.col(by).between(F.lit(low), F.lit(high))).join(names, by, "left_semi")
    merged = upsert(old, new, keys, update=update).checkpoint()
    write_partitions(merged, path, [by])


def write_alerts(alerts: DataFrame, path: str, *, at_time: datetime) -> None:
    """Alert rows as JSON lines, the content of the alert topic, in a folder per run."""
    lines = alert_messages(alerts, at_time=at_time).withColumn("run", F.lit(run_name(at_time)))
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").text(path)


def alert_messages(alerts: DataFrame, *, at_time: datetime) -> DataFrame:
    stamp = F.lit(at_time.strftime("%Y-%m-%dT%H:%M:%S")).alias("timestamp")
    return alerts.select(F.to_json(F.struct(*alerts.columns, stamp)).alias("value"))


def publish_events(events: DataFrame, servers: str, topic: str) -> None:
    """Events to a topic, keyed so that one item's events stay in order."""
    as_messages(events).write.format("kafka").options(
        **{"kafka.bootstrap.servers": servers, "topic": topic}
    ).save()


def write_routed(events: DataFrame, path: str, *, batch: str) -> None:
    """Events into one folder per index and batch; a batch that is written again replaces itself."""
    (
        with_index_name(events).withColumn("batch", F.lit(batch)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("timestampNTZFormat", JSON_TIME)
        .partitionBy("index_name", "batch")
        .json(path)
    )
