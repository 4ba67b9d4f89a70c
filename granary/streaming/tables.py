"""Running a stream to the end of its input, and the tables it keeps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.streaming.files import Manifests, delete

BATCH = "batch_id"


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """One micro-batch in its own folder; a retried batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def run_available(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    *,
    checkpoint: str,
    mode: str = "append",
) -> int:
    """Process all input that is there now, in as many micro-batches as it takes. Returns how many rows came behind the
    watermark of a stateful step and were left out by it."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each_batch)
        .start()
    )
    query.awaitTermination()
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def to_table(
    stream: DataFrame, path: str, *, checkpoint: str, mode: str = "append"
) -> DataFrame:
    """Run the stream into a parquet table, one folder per micro-batch, and read it."""
    spark = stream.sparkSession
    run_available(
        stream, lambda df, n: write_batch(df, n, path), checkpoint=checkpoint, mode=mode
    )
    return read_table(spark, path, stream)


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The written rows; an input without rows leaves no files, hence the given schema."""
    schema = like.schema.add(BATCH, "long")
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # no batch was written
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def newest(keys: list[str], by: str = BATCH) -> Callable[[DataFrame], DataFrame]:
    """Keeps of each key the row with the greatest `by`."""

    def fold(table: DataFrame) -> DataFrame:
        rest = [c for c in table.columns if c not in keys]
        return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_newest")).select(*keys, "_newest.*")

    return fold


class Tiers:
    """A table that micro-batches add to: what each adds is a run, and `width` runs of one size are folded into one of the
    next, so a reader folds a few runs for every power of `width` and a row is rewritten as often as there are powers.

    `fold` reduces rows to what the table means and may be applied again to its own results (sums, the newest of a key, the
    last rows of a key). A manifest per micro-batch names the runs, so a batch that is run again
    replaces what it added; files that no manifest names go with the next batch.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame], *, width: int = 8
    ):
        self.spark, self.path, self.fold, self.width = spark, path, fold, width
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self.manifests = Manifests(spark, f"{path}/manifest")

    def _read(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r}" for r in runs])

    def _write(self, df: DataFrame, label: str) -> str:
        run = f"run-{label}-{uuid.uuid4().hex}"
        self.fold(df).select(*self.schema.names).write.parquet(f"{self.path}/{run}")
        return run

    def commit(self, rows: DataFrame, batch_id: int) -> None:
        before = self.manifests.before(batch_id) or {"runs": []}
        runs = [*before["runs"], [0, self._write(rows, f"{batch_id}-0")]]
        level, merged = 0, []
        while len(same := [r for n, r in runs if n == level]) >= self.width:
            folded = self._write(self._read(same), f"{batch_id}-{level + 1}")
            runs = [*[r for r in runs if r[0] > level], [level + 1, folded], *[r for r in runs if r[0] < level]]
            merged += same
            level += 1
        gone = before.get("gone", [])
        self.manifests.put(batch_id, {"batch": batch_id, "runs": runs, "gone": merged})
        # what the batch before folded away is not needed by a retry of this one
        for run in gone:
            delete(self.spark, f"{self.path}/{run}")

    def runs(self, before: int | None = None) -> list[str]:
        return [run for _, run in (self.manifests.before(before) or {"runs": []})["runs"]]

    def read(self, before: int | None = None) -> DataFrame:
        """The table as of the last batch, or as a batch finds it, also when that batch is run again."""
        return self.fold(self._read(self.runs(before))).select(*self.schema.names)


def to_newest(stream: DataFrame, path: str, keys: list[str], *, checkpoint: str) -> DataFrame:
    """Run a stream in update mode into a table that has the newest row of each key, and read it."""
    table = Tiers(stream.sparkSession, path, stream.schema.add(BATCH, "long"), newest(keys))
    run_available(
        stream, lambda df, n: table.commit(df.withColumn(BATCH, F.lit(n).cast("bigint")), n), checkpoint=checkpoint, mode="update"
    )
    return table.read().drop(BATCH)
