"""Documents packed into sequences of bounded length: first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.store import written
from granary.llm.tokens import bounded, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces that are packed together: enough that little room is left over, few enough for any task.
GROUP = 4096


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in the order given: the first bin that has room takes it.

    A tournament tree over the bins holds in each node the most room below it, so the first bin with enough room
    is found, and its room updated, in log(bins) steps.
    """
    width = 1
    while width < len(sizes):
        width *= 2
    room = [capacity] * (2 * width)
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < width:
            node *= 2
            if room[node] < size:
                node += 1
        bins.append(node - width)
        offsets.append(capacity - room[node])
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def token_pieces(
    docs: DataFrame, vocabulary: str, *, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): the ids of each text, then `end_id`, cut every `length`
    ids. Null texts are empty; every document has a piece."""
    end = np.array([end_id], np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text):
            ids, ends = encoder(vocabulary).encode(batch.column(text))
            rows: list[tuple] = []
            begin = 0
            for doc, stop in zip(batch.column(key).to_pylist(), ends.tolist(), strict=True):
                own = np.concatenate([ids[begin:stop], end]).astype("<u4")
                begin = stop
                for at in range(0, len(own), length):
                    part = own[at : at + length]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(own)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, *, length: int = 2048, group: int = GROUP, seed: int = 7) -> DataFrame:
    """Add sequence_id and offset (long): pieces of at most `length` share sequences of at most `length`, each
    gapless from 0.

    Pieces go at random, equal ones as well, to groups of about `group`; each group is packed on its
    own, largest first, so work and memory of a task do not grow with the corpus. An empty table gives an empty table.
    """
    names = pieces.columns
    # numbered before they are written, so that a repeated task deals them alike
    pieces = written(pieces.withColumn("pack:row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *names], ascending=[False] + [True] * len(names), kind="stable")
        bins, offsets = first_fit(rows["length"].tolist(), length)
        number = rows["pack:group"].iloc[0]
        return rows[names].assign(sequence_id=(int(number) << 32) + np.array(bins, np.int64), offset=np.array(offsets, np.int64))

    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    dealt = pieces.withColumn("pack:group", F.pmod(F.xxhash64(F.lit(seed), "pack:row"), F.lit(groups))).drop("pack:row")
    return dealt.groupBy("pack:group").applyInPandas(packed, schema)
