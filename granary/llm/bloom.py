"""Which hashes occur more than once: two Bloom filters, for hashes seen once and seen twice.

Map tasks hand over their hashes, 4 bytes each, dealt by hash into segments; a task that builds a segment sets each hash
in the first filter, and in the second if the first already had it. The second filter, of a fixed
size whatever the input, then tells every task which of its items may be repeated. It never misses one; what it
holds wrongly costs a shuffle of that item to an exact check, and no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from granary.llm.store import shared_batches, written

#: log2 of the bits of a filter: 32 MB, which keeps false repeats below 1 % up to about 60 million distinct hashes.
BITS = 28
#: Filters up to 32 MB.
SMALL = 28
SEGMENTS = 6
PROBES = 4
#: Hashes that a task hands over at once.
AT_ONCE = 1 << 20


def _keys(hashes: np.ndarray) -> np.ndarray:
    """The 32 bits after those that name the segment: all that travels of a hash."""
    return (hashes >> np.uint64(32 - SEGMENTS)).astype(np.uint32)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key in its segment of 2**bits bits, one row per probe."""
    mixed = (keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    first, step = mixed >> np.uint64(32), (mixed >> np.uint64(7)) & np.uint64(0xFFFFFF) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((first + probes * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


def may_repeat(second: bytes, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether the filter of twice-seen hashes has each of the hashes."""
    filled = np.frombuffer(second, np.uint8)
    inner = bits - SEGMENTS
    base = (hashes >> np.uint64(64 - SEGMENTS)).astype(np.int64) << inner
    places = _places(_keys(hashes), inner) + base
    return ((filled[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


class Stored:
    """A filter in the shared folder, which each task that asks for its `value` reads from there; the driver holds no more
    than the names of its files."""

    def __init__(self, files: list[str], bits: int):
        self.files, self.bits, self.held = files, bits, None

    @property
    def value(self) -> np.ndarray:
        if self.held is None:
            self.held, width = np.zeros(1 << (self.bits - 3), np.uint8), 1 << (self.bits - SEGMENTS - 3)
            for batch in shared_batches(self.files, 1):
                at = batch.column("segment")[0].as_py() * width
                self.held[at : at + width] = np.frombuffer(batch.column("filter")[0].as_buffer(), np.uint8)
        return self.held


def twice_seen(
    df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BITS, *, stored: bool = False
) -> Broadcast | Stored:
    """The filter of hashes that more than one item holds, as a broadcast of 2**bits / 8 bytes or `stored` in the shared
    folder. `hashes_of` gives the distinct hashes (uint64) of each item of a batch."""
    spark = df.sparkSession
    inner = bits - SEGMENTS

    def handed(each: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(each), return_counts=True)
        cuts = np.searchsorted(found, np.arange(1, 1 << SEGMENTS, dtype=np.uint64) << np.uint64(64 - SEGMENTS))
        rows = [
            (segment, _keys(part).tobytes(), _keys(part[n > 1]).tobytes())
            for segment, (part, n) in enumerate(zip(np.split(found, cuts), np.split(times, cuts), strict=True))
            if part.size
        ]
        return pa.RecordBatch.from_pylist([dict(zip(("segment", "all", "again"), r, strict=True)) for r in rows], schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for own in hashes_of(batch):
                each.append(own)
                held += len(own)
                if held > AT_ONCE:  # what comes again later is found where the segments are built
                    yield handed(each)
                    each, held = [], 0
        if held:
            yield handed(each)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for segment, every, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment not in filters:
                    filters[segment] = (np.zeros(1 << inner, bool), np.zeros(1 << inner, bool))
                once, twice = filters[segment]
                places = _places(np.frombuffer(every, np.uint32), inner)
                twice[places[:, once[places].all(axis=0)]] = True
                twice[_places(np.frombuffer(again, np.uint32), inner)] = True
                once[places] = True
        for segment, (_, twice) in filters.items():
            packed = np.packbits(twice, bitorder="little").tobytes()
            yield pa.RecordBatch.from_pylist([{"segment": segment, "filter": packed}], built)

    schema = pa.schema([("segment", pa.int32()), ("all", pa.binary()), ("again", pa.binary())])
    built = pa.schema([("segment", pa.int32()), ("filter", pa.binary())])
    dealt = df.mapInArrow(deal, "segment int, all binary, again binary")
    # as many tasks as segments: each holds the two arrays of a segment or a few, 4 MB each
    parts = dealt.repartition(1 << SEGMENTS, "segment").mapInArrow(build, "segment int, filter binary")
    if stored:  # one file of 64 rows, whatever the input
        return Stored(written(parts.repartition(1), "filter").inputFiles(), bits)
    second = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (inner - 3)
    # a small filter comes at once; of a large one the driver holds a segment beside the whole, a job each
    for row in parts.collect() if bits <= SMALL else parts.toLocalIterator():
        second[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(row["filter"], np.uint8)
    return spark.sparkContext.broadcast(second.tobytes())
