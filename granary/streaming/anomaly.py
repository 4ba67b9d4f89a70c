"""Volume anomalies on a stream: the last 100 changes of a key are its state."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.timing import at
from granary.operators.anomaly import ANOMALY, CRITICAL_Z, HIGH_Z, HISTORY, volume_anomalies
from granary.schemas import KEY
from granary.streaming.ordered import DELAY, Waiting
from granary.streaming.tables import BATCH, Tiers, read_table, write_batch


def last_rows(count: int):
    """Keeps the last rows of each key by (timestamp, id)."""

    def fold(rows: DataFrame) -> DataFrame:
        back = W.partitionBy(*KEY).orderBy(F.desc("timestamp"), F.desc("id"))
        return rows.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= count).drop("_back")

    return fold


def run_anomalies(
    events: DataFrame,
    path: str,
    *,
    checkpoint: str,
    threshold: float = HIGH_Z,
    critical: float = CRITICAL_Z,
    history: int = HISTORY,
    delay: timedelta = DELAY,
    ended: bool = True,
) -> DataFrame:
    """Anomalies in the order of (timestamp, id), as rows get ready; the same as of all rows at once, but for those that come
    later than the delay allows and are quarantined under `path`. Ready rows are judged by the batch operator, behind the last
    `history - 1` rows of their keys, so a key with many rows is as many tasks as in a batch."""
    rows = events.select("id", *KEY, "quantity_change", "timestamp")
    waiting = Waiting(rows, f"{path}/rows", delay=delay)
    tail = Tiers(rows.sparkSession, f"{path}/tail", rows.schema, last_rows(history - 1))

    def step(ready: DataFrame, done, batch_id: int) -> None:
        known = tail.read(before=batch_id).join(ready.select(*KEY).distinct(), KEY, "left_semi").select(*ready.columns)
        found = volume_anomalies(known.unionByName(ready), threshold=threshold, critical=critical, history=history)
        write_batch(found if done is None else found.filter(F.col("timestamp") > at(done)), batch_id, f"{path}/found")
        tail.commit(ready, batch_id)

    waiting.run(rows, step, checkpoint=checkpoint, ended=ended)
    return read_table(rows.sparkSession, f"{path}/found", rows.sparkSession.createDataFrame([], ANOMALY)).drop(BATCH)
