"""Tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from granary.session import fresh_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: read many times, computed once, whole
    whichever executors are lost, and of a size that the planner knows."""
    path = fresh_dir(df.sparkSession, label)
    # small row groups: a writer holds one in memory, beside the Python workers
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_batches(files: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of Parquet files in the shared folder, so many at a time: how a task reads a table that is too large to be
    sent to it."""
    for name in files:
        store, path = fs.FileSystem.from_uri(name)
        with store.open_input_file(path) as file:
            yield from pq.ParquetFile(file).iter_batches(batch_size=rows)
