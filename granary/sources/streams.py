"""Streams of inventory events: a message topic, or files with the same JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPIC = "inventory-events"
ALERT_TOPIC = "inventory-alerts"


def topic_options(
    servers: str, *, topic: str = TOPIC, earliest: bool = True, max_per_trigger: int = 1_000_000
) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest" if earliest else "latest",
        "maxOffsetsPerTrigger": str(max_per_trigger),
    }


def read_topic(spark: SparkSession, servers: str, **options) -> DataFrame:
    """Records of a topic as (key, value) text. Needs the Kafka connector on the class path."""
    stream = spark.readStream.format("kafka").options(**topic_options(servers, **options)).load()
    return stream.select(F.col("key").cast("string"), F.col("value").cast("string"))


def read_json_lines(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """The same records out of files, one JSON text per line, as column `value`.

    A trigger takes a bounded number of files, oldest first, which bounds a micro-batch.
    """
    return (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
        .select("value")
    )


def read_table_files(
    spark: SparkSession, folder: str, schema: T.StructType, *, only: str, files_per_trigger: int = 100
) -> DataFrame:
    """Parquet files of a table as a stream; `only` is a glob on the file name."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", only)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
