"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("granary")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only in a local session where `spark.checkpoint.dir` is unset is a temporary folder
    taken, one for the life of the process.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="granary-")
    return _local_dir


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark)}/granary/{label}-{uuid.uuid4().hex}"


def enable_checkpoints(spark: SparkSession) -> None:
    """Let DataFrame.checkpoint() write under the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialized(df: DataFrame) -> DataFrame:
    """The rows written once under the shared folder, for frames that are read many times.

    Unlike a cache this survives the loss of executors, and it cuts the lineage.
    """
    enable_checkpoints(df.sparkSession)
    return df.checkpoint()
