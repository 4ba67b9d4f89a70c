"""Lines that several documents share stay in the first of them only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.bloom import BITS, may_repeat, twice_seen
from granary.llm.store import written

#: Characters stripped from both ends of a line: ASCII white space.
SPACES = b" \t\n\x0b\x0c\r"
LEAST = 10
#: Stands for a null key: after every document.
LAST = (1 << 63) - 1


def line_keys(text: str | None, least: int = LEAST) -> dict[bytes, list[int]]:
    """The keys of a text's lines, with the numbers of the lines that have them: a line without white space at its
    ends, A-Z in lower case; keys of fewer than `least` code points are left out."""
    found: dict[bytes, list[int]] = {}
    for number, line in enumerate((text or "").encode().split(b"\n")):
        key = line.strip(SPACES).lower()
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            found.setdefault(key, []).append(number)
    return found


def _hashed(keys: dict[bytes, list[int]]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))


def repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, bits: int = BITS) -> DataFrame:
    """(doc, mark, lines array<int>) of the documents that lose lines: those whose key also stands in a document of
    a smaller id. A null id counts as the largest; rows that repeat an id are one document, and `mark`, a hash of
    the text, tells their lines apart."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (_hashed(line_keys(value.as_py(), least)) for value in batch.column(0))

    filled = twice_seen(docs.select(text), hashes, bits)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("line", pa.binary()), ("numbers", pa.list_(pa.int32()))])
        for batch in batches:
            docs_of, marks, line, numbers = [], [], [], []
            for doc, mark, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys = line_keys(value.as_py(), least)
                if keys:
                    for (k, at), suspect in zip(keys.items(), may_repeat(filled.value, _hashed(keys), bits).tolist(), strict=True):
                        if suspect:
                            docs_of.append(doc)
                            marks.append(mark)
                            line.append(k)
                            numbers.append(at)
            if line:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip((docs_of, marks, line, numbers), schema, strict=True)], schema=schema
                )

    ids = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    found = written(
        docs.select(ids.alias("doc"), F.xxhash64(text).alias("mark"), text)
        .mapInArrow(suspects, "doc long, mark long, line binary, numbers array<int>"),
        "suspects",
    )
    # the partial minimum leaves a row per line and task; written apart, so that adaptive execution can split the join
    # back where one line is in many documents
    first = written(
        found.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last"), "repeated"
    )
    lost = found.join(first, "line").filter("doc > first")
    return lost.groupBy("doc", "mark").agg(F.flatten(F.collect_list("numbers")).alias("lines"))


def drop_repeated_lines(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, bits: int = BITS,
    lines: str = "n_lines", dropped: str = "n_dropped",
) -> DataFrame:
    """`docs` with the lines left in `text` and the counts `lines` (before) and `dropped` (long).

    A null or empty text is one empty line and comes out empty. Keys must be whole numbers. Clashing columns
    are replaced by the two counts.
    """
    columns = [c for c in docs.columns if c not in (lines, dropped)]
    lost = repeated_lines(docs, key=key, text=text, least=least, bits=bits)
    lost = lost.select(F.col("doc").alias("lost:doc"), F.col("mark").alias("lost:mark"), F.col("lines").alias("lost:lines"))
    marked = docs.select(*columns).withColumns({"lost:doc": F.coalesce(F.col(key).cast("long"), F.lit(LAST)), "lost:mark": F.xxhash64(text)})
    joined = marked.join(lost, ["lost:doc", "lost:mark"], "left").select(*columns, "lost:lines")
    schema = T.StructType([f if f.name != text else T.StructField(text, T.StringType()) for f in docs.select(*columns).schema])
    schema = schema.add(lines, "long").add(dropped, "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, total, gone = [], [], []
            for value, numbers in zip(batch.column(text), batch.column("lost:lines"), strict=True):
                every = (value.as_py() or "").split("\n")
                lose = set(numbers.as_py() or ())
                left.append("\n".join([line for i, line in enumerate(every) if i not in lose]) if lose else "\n".join(every))
                total.append(len(every))
                gone.append(len(lose))
            arrays = [batch.column(c) if c != text else pa.array(left, pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*columns, lines, dropped])

    return joined.mapInArrow(cut, schema)
