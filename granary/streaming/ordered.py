"""Rows of a stream in the order of their event time, whatever order they arrive in.

Each micro-batch adds its rows to those that wait. A row is ready once the watermark, the latest time seen less the
delay, has passed it; the ready rows of a batch go, all at once, to a step that treats them as the next part of one
ordered history. So results depend on the rows alone and not on how the input was cut into files, triggers or
batches. A batch that moves no time on has no step. What waits is bounded by the delay; it stays in the folders it
came in, read from the time done on, until there are `FOLDERS` of them, which are then written as one. Rows that come when their time is already done, and rows without a
time, go to a quarantine, with their number in the batch's record.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.timing import at
from granary.streaming.files import Manifests, delete
from granary.streaming.tables import run_available, write_batch

DELAY = timedelta(minutes=10)
#: Folders of waiting rows that are written as one.
FOLDERS = 16
#: Called with the ready rows, the end of the time done before (None at first), and the number of the batch.
Step = Callable[[DataFrame, datetime | None, int], None]


def _time(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


class Waiting:
    """The rows of a stream that wait for the watermark."""

    def __init__(self, stream: DataFrame, path: str, *, time: str = "timestamp", delay: timedelta = DELAY, whole: timedelta | None = None):
        """`whole` holds back the rows of the last, unfinished period of that length, so that a step sees whole periods."""
        self.spark, self.schema, self.path = stream.sparkSession, stream.schema, path
        self.time, self.delay, self.whole = time, delay, whole
        self.manifests = Manifests(self.spark, f"{path}/manifest")

    def _folder(self, label: str) -> str:
        return f"{self.path}/{label}-{uuid.uuid4().hex}"

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def advance(self, rows: DataFrame | None, batch_id: int, step: Step) -> None:
        """One micro-batch; without rows, the end of the stream, after which all that waits is ready."""
        before = self.manifests.before(batch_id) or {"done": None, "seen": None, "waiting": [], "late": 0}
        done, seen, folders, late_rows = _time(before["done"]), _time(before["seen"]), list(before["waiting"]), 0
        when = F.col(self.time)
        if rows is not None:
            arrived = self._folder(f"arrived-{batch_id}")
            rows.write.parquet(arrived)
            rows = self._read([arrived])
            late = when.isNull() if done is None else F.coalesce(when <= at(done), F.lit(True))
            told = rows.agg(F.max(when).alias("latest"), F.count_if(late).alias("late")).first()
            late_rows = told["late"]
            if late_rows:
                write_batch(rows.filter(late), batch_id, f"{self.path}/late")
            seen = max(filter(None, (seen, told["latest"])), default=None)
            folders.append(arrived)
        if seen is None:
            self.manifests.put(batch_id, before | {"late": before["late"] + late_rows, "gone": []})
            return
        limit = seen if rows is None else seen - self.delay
        if self.whole and rows is not None:
            limit = datetime.min + (limit - datetime.min) // self.whole * self.whole - timedelta(microseconds=1)
        if done is not None:
            limit = max(limit, done)
        pool = self._read(folders)
        pool = pool.filter(when.isNotNull() if done is None else when > at(done))
        if done is None or limit > done:
            step(pool.filter(when <= at(limit)), done, batch_id)
        waiting, gone = folders, []
        if rows is None or len(folders) >= FOLDERS:
            waiting, gone = [self._folder(f"waiting-{batch_id}")], folders
            pool.filter(when > at(limit)).write.parquet(waiting[0])
        self.manifests.put(batch_id, {
            "done": limit.isoformat(), "seen": seen.isoformat(), "waiting": waiting, "late": before["late"] + late_rows,
            "gone": gone, "ended": rows is None,
        })
        for folder in before.get("gone", []):  # a retry of this batch does not need them
            delete(self.spark, folder)

    def run(self, stream: DataFrame, step: Step, *, checkpoint: str, ended: bool = True) -> int:
        """All input that is there now; if the stream has `ended`, what waits as well. Returns the number of late rows.

        The end is a batch behind the last; if the stream goes on after all, its next batch has the same number and replaces it.
        """
        run_available(stream, lambda df, n: self.advance(df, n, step), checkpoint=checkpoint)
        last = self.manifests.before()
        if ended and last and not last.get("ended"):
            self.advance(None, self.manifests.numbers()[-1] + 1, step)
        return (last or {"late": 0})["late"]

    def late(self) -> DataFrame:
        """The quarantine."""
        from granary.streaming.tables import read_table

        return read_table(self.spark, f"{self.path}/late", self._read([]))
