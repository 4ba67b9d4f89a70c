"""Stored models: coefficient tables by version, and fitted pipelines with their metadata."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.ml.forecast import MODEL_SCHEMA
from granary.operators.upsert import latest_per_key
from granary.schemas import KEY
from granary.session import materialized
from granary.sources.sinks import write_partitions
from granary.streaming.files import delete


_ABOUT = (
    "name string, version string, training_date string, model_type string, "
    "feature_columns array<string>, metrics map<string,double>, importances map<string,double>"
)


def version_of(moment: datetime) -> str:
    return moment.strftime("%Y%m%d_%H%M%S")


def save_models(models: DataFrame, path: str, *, trained_at: datetime) -> None:
    """All keys of one training run under one version; the same run replaces itself."""
    write_partitions(models.withColumn("version", F.lit(version_of(trained_at))), path, ["version"])


def load_models(spark: SparkSession, path: str, *, version: str | None = None, newest: bool = True) -> DataFrame:
    """The newest model of each key, or those of one version, or with `newest` false all."""
    # versions look like numbers to partition discovery, so the type is given
    stored = spark.read.schema(MODEL_SCHEMA + ", version string").parquet(path)
    if version is not None:
        return stored.filter(F.col("version") == version)
    if not newest:
        return stored
    return latest_per_key(stored, KEY, ["version"])


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """Every stored model without its coefficients, and whether it is the newest of its key."""
    stored = load_models(spark, path, newest=False)
    last = F.max("version").over(W.partitionBy(*KEY))
    return stored.select(*KEY, "version", "status", "data_points", "last_date", "mape").withColumn("is_newest", F.col("version") == last)


def without_models(models: DataFrame, keys: DataFrame) -> DataFrame:
    return models.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def delete_models(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Take all versions of some keys out of the store. What stays is written aside before it replaces what was there."""
    stored = load_models(spark, path, newest=False)
    kept = materialized(without_models(stored, keys))
    versions = lambda df: {r["version"] for r in df.select("version").distinct().collect()}  # noqa: E731  one per training run
    gone = versions(stored) - versions(kept)
    write_partitions(kept, path, ["version"])
    for version in gone:
        delete(spark, f"{path}/version={version}")


def save_pipeline(
    spark: SparkSession,
    model: PipelineModel,
    path: str,
    *,
    name: str,
    trained_at: datetime,
    metrics: dict[str, float],
    features: list[str],
    importances: dict[str, float] | None = None,
) -> str:
    """A fitted pipeline, scaler and all, and one row about it; returns the version."""
    version = version_of(trained_at)
    model.write().overwrite().save(f"{path}/{name}/{version}")
    about = spark.createDataFrame(
        [(name, version, trained_at.isoformat(), type(model.stages[-1]).__name__, features, metrics, importances or {})],
        _ABOUT,
    )
    about.coalesce(1).write.mode("append").json(f"{path}/metadata")
    return version


def load_metadata(spark: SparkSession, path: str, *, name: str, version: str) -> DataFrame:
    """The row about a stored pipeline; of one stored again, one."""
    stored = spark.read.schema(_ABOUT).json(f"{path}/metadata")
    return stored.filter((F.col("name") == name) & (F.col("version") == version)).limit(1)


def load_pipeline(path: str, *, name: str, version: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/{name}/{version}")
