"""Token ids of a corpus in seekable files, in the order of the documents."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.seekable import Reader, Writer
from granary.llm.store import written
from granary.llm.tokens import bounded, encoder
from granary.session import fresh_dir

MANIFEST = "part int, path string, n_docs long, n_tokens long"


def open_store(path: str):
    """The file system of a path and the path in it: any store that pyarrow knows, or a mounted folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_tokens(
    docs: DataFrame, vocabulary: str, folder: str | None = None, *, key: str = "doc_id", text: str = "text", end_id: int = 0
) -> DataFrame:
    """Write the ids of every text, each followed by `end_id`, to files in ascending order of key (nulls first, then by
    text), and return the manifest: one row per file, `part` in that order.

    Texts are dealt by ranges of the key before they are encoded, so each is encoded once and no task
    holds more than its range. A file's name has an id of the attempt that wrote it and the manifest names
    only files of finished tasks, so a task that is repeated or lost leaves nothing that is read. Null and empty
    texts are one id; an empty table has an empty manifest or files without documents.
    """
    folder = folder or fresh_dir(docs.sparkSession, "tokens")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, file, n_docs = TaskContext.get().partitionId(), None, 0
        end = np.array([end_id], np.uint32)
        for batch in bounded(batches, text):
            own = encoder(vocabulary)
            if file is None:
                store, base = open_store(folder)
                store.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
                file = store.open_output_stream(f"{base}/{name}", compression=None)
                writer = Writer(file, width=2 if len(own.width) <= 1 << 16 else 4)
            ids, ends = own.encode(batch.column(text))
            start = 0
            for doc, stop in zip(batch.column(key).to_pylist(), ends.tolist(), strict=True):
                writer.add(doc, np.concatenate([ids[start:stop], end]))
                start = stop
            n_docs += batch.num_rows
        if file is not None:
            writer.close()
            file.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t.type) for v, t in zip((part, f"{folder}/{name}", n_docs, writer.ids), schema, strict=True)], schema=schema
            )

    ordered = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(key).sortWithinPartitions(key, text)
    return written(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest. `start` counts the ids of all
    documents before it over all files; ids_crc32 is that of the ids as little-endian unsigned 32-bit integers."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("part", "path", F.coalesce(before, F.lit(0)).alias("before"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                store, inside = open_store(path)
                with store.open_input_file(inside) as file:
                    reader = Reader(file, file.size())
                    for at in range(0, len(reader), 10_000):
                        own = range(at, min(at + 10_000, len(reader)))
                        sums = [zlib.crc32(reader.ids(i).astype("<u4").tobytes()) for i in own]
                        rows = reader.docs[own.start : own.stop]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([reader.doc_id(i) for i in own], pa.int64()),
                            pa.array(rows["start"].astype("int64") + base),
                            pa.array(rows["ids"].astype("int64")),
                            pa.array(sums, pa.int64()),
                        ], schema=schema)

    files = max(1, manifest.count())  # one file to a task
    return placed.repartitionByRange(files, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
