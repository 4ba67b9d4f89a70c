"""Passages that several documents share stay in the first of them only: FM-indexes of the shared passages.

A window is `length` consecutive words. Each window has an anchor, the least hash among its five-word grams, so
equal windows have equal anchors wherever they stand. Anchors, then windows, that a Bloom filter has seen only once
can't be shared and go no further; runs of the others that have one anchor are passages, dealt by anchor to shards. Passages
of an anchor that has too many for a task are cut further, by their windows' second-least gram, third-least and so on.
Each shard is a compressed index of its distinct passages, the Burrows-Wheeler transform in a wavelet tree. Its passages are
streamed through it: backward search gives the matching statistic of each word, the length of the longest run up to it that stands
elsewhere in the shard, and where that reaches a window's length, the documents of the rows found tell where it stands first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.bloom import BITS, may_repeat, twice_seen
from granary.llm.store import written
from granary.llm.tokens import bounded

LENGTH = 13
GRAM = 5
#: Stands for a null key: after every document.
LAST = (1 << 63) - 1
#: Bytes of distinct passages in a shard.
SHARD = 1_000_000
#: Bytes of distinct passages of one key that are still left to one task.
LIMIT = 4_000_000
#: Distinct passages that a task remembers, so that it sends those that many documents share once, and passages it takes in
#: between before it looks which are new.
TOLD = 120_000
MET = 40_000
#: log2 of the bits of the filter of documents that lose words: 2 MB.
LOSERS = 24
#: Bytes of text looked at in one go.
AT_ONCE = 500_000

# Odd multipliers of a multiplicative hash.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 120_000:
            self.clear()
        self[word] = found = xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(_ODD[0])
    return values ^ (values >> np.uint64(29))


#: The bytes that part words.
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: What is left of eight bytes of which 0 … 8 belong to a word.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 512


class Words:
    """The words of all texts after one another, as places in the bytes of the texts: word i of all is raw[starts[i]:ends[i]],
    text t has size[t] words from begin[t] on. Null texts have none."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = pc.fill_null(texts, b"")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        self.raw = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        blank = _BLANK[self.raw]
        inside = ~blank
        first, last = inside.copy(), inside.copy()
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        first[edges[:-1][edges[:-1] < len(inside)]] = True
        last[edges[1:][edges[1:] > 0] - 1] = True
        self.starts, self.ends = np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
        bounds = np.searchsorted(self.starts, edges)
        self.begin, self.size = bounds[:-1], np.diff(bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: its length, then eight bytes after eight are mixed in. So words of up to eight bytes
        and one length never clash."""
        size = self.ends - self.starts
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.raw) + 1, "<u8", padded, strides=(1,))
        out = size.astype(np.uint64) * np.uint64(_ODD[4])
        at, done = np.arange(len(size)), 0
        while len(at) and done < _LONG:
            value = eight[self.starts[at] + done] & _LEFT[np.minimum(size[at] - done, 8)]
            out[at] = _mixed(_mixed(out[at] ^ value) + np.uint64(_ODD[1]))
            done += 8
            at = at[size[at] > done]
        if len(at):
            from xxhash import xxh3_64_intdigest

            for i in at.tolist():
                out[i] = xxh3_64_intdigest(self.raw[self.starts[i] : self.ends[i]].tobytes())
        return out

    def joined(self, first: np.ndarray, stop: np.ndarray) -> Iterator[bytes]:
        """The words first … stop - 1 of each run, joined by one space."""
        raw = self.raw.tobytes()
        odd = (self.starts[1:] - self.ends[:-1] != 1) | (self.raw[self.ends[:-1]] != 32)
        so_far = np.concatenate([[0], np.cumsum(odd)])
        plain = so_far[stop - 1] == so_far[first]
        for a, b, as_is in zip(self.starts[first].tolist(), self.ends[stop - 1].tolist(), plain.tolist(), strict=True):
            yield raw[a:b] if as_is else b" ".join(raw[a:b].split())


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            one = np.ones(1, np.uint64)
            cls.up, cls.down = (
                np.concatenate([one, np.cumprod(np.full(size - 1, base, np.uint64))]) for base in (_ODD[3], pow(_ODD[3], -1, 1 << 64))
            )
        return cls.up[:n], cls.down[:n]


def run_hashes(hashes: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size a hash of each run of so many hashes, in order: differences of the sums so far of hash times power,
    divided by the power that the run begins with."""
    n = len(hashes)
    up, down = _Powers.of(n)
    so_far = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up)])
    return [_mixed((so_far[size:] - so_far[: n - size + 1]) * down[: n - size + 1]) if n >= size else np.empty(0, np.uint64) for size in sizes]


def run_names(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits that name each run first … stop - 1 of words, from two 64-bit values of each word."""
    up, down = _Powers.of(len(hashes) + 1)
    many = (stop - first).astype(np.uint64) * np.uint64(_ODD[1])
    out = []
    for values in (hashes, _mixed(hashes + np.uint64(_ODD[4]))):
        so_far = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])
        out.append(_mixed((so_far[stop] - so_far[first]) * down[first] + many).view(np.int64))
    return out[0], out[1]


def alike_rows(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in an order that has equal ones side by side, and where in it each begins that differs from the one before."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([v[order[1:]] != v[order[:-1]] for v in columns], axis=0)
    return order, np.flatnonzero(new)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` hashes, in order."""
    return run_hashes(hashes, size)[0]


def window_hashes(hashes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The anchor and a hash of each window of `length` words. An anchor is the least hash of a window's grams."""
    size = min(GRAM, length)
    own, whole = run_hashes(hashes, size, length)
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    span = length - size + 1
    least, have = own, 1
    while 2 * have <= span:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    return np.minimum(least[:n], least[span - have : span - have + n]), whole


def batch_windows(texts: pa.Array, length: int = LENGTH) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of all texts after one another; of each window where it starts there, and the text it is of."""
    words = Words(texts)
    count = np.maximum(words.size - length + 1, 0)
    of = np.repeat(np.arange(len(count)), count)
    starts = np.arange(len(of)) + np.repeat(words.begin - (np.cumsum(count) - count), count)
    return words, starts, of


class Wavelet:
    """Rank of symbols in a sequence: one bit vector a level, with counts at every 64th bit."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, self.zeros, self.counts, self.words = max(1, (symbols - 1).bit_length()), [], [], []
        order = sequence.astype(np.int64)
        for level in reversed(range(self.levels)):
            bits = (order >> level & 1).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(int(len(bits) - bits.sum()))
            order = np.concatenate([order[~bits], order[bits]])
        every = np.arange(symbols, dtype=np.int64)
        self.begins = self._down(every, np.zeros(symbols, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.counts[level][word] + np.bitwise_count(low)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.begins[symbol]


class Index:
    """FM-index of texts of symbols 1 …: rows sorted by at least `depth` symbols, so patterns up to that are found. It holds
    the symbol before each row in a wavelet tree and, 4 bytes a row, the text's holder by rank; not the places themselves."""

    def __init__(self, sequence: np.ndarray, holders: np.ndarray, depth: int):
        symbols = int(sequence.max(initial=0)) + 1
        rank, sorted_by = sequence.astype(np.int64), 1
        rows = np.argsort(rank)  # rows that are equal so far may stand in any order
        while sorted_by < depth:
            behind = np.zeros(len(rank), np.int64)
            behind[:-sorted_by] = rank[sorted_by:] + 1
            joined = rank * (int(rank.max(initial=0)) + 2) + behind
            rows = np.argsort(joined)
            ordered = joined[rows]
            rank = np.empty(len(ordered), np.int64)
            rank[rows] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            sorted_by *= 2
        self.size = len(rows)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        self.tree = Wavelet(sequence[rows - 1], symbols)  # the symbol before each row, round at the first
        self.holders, codes = np.unique(holders, return_inverse=True)
        self.holder_of_row = codes.astype(np.uint32)[rows]

    def statistics(self, sequence: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end the matching statistic, up to `depth`: how many symbols up to it, taken from last to first, stand in
        more than one row, and the rows [low, high) that start with them."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        length = np.zeros(len(ends), np.int64)
        open_ = np.arange(len(ends))
        for back in range(depth):
            symbol = sequence[ends[open_] - back].astype(np.int64)
            if back:
                first = self.before[symbol] + self.tree.rank(symbol, low[open_])
                behind = self.before[symbol] + self.tree.rank(symbol, high[open_])
            else:  # of all rows: those that start with the symbol
                first, behind = self.before[symbol], self.before[symbol + 1]
            more = behind - first > 1  # one row is the place itself
            open_ = open_[more]
            low[open_], high[open_] = first[more], behind[more]
            length[open_] += 1
        return length, low, high

    def least_holder(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least holder of each range of rows."""
        each, where = np.unique(low, return_inverse=True)
        stop = np.zeros(len(each), np.int64)
        stop[where] = high
        bounds = np.stack([each, stop], axis=1).ravel()
        ranked = np.append(self.holder_of_row, np.uint32(len(self.holders)))
        return self.holders[np.minimum.reduceat(ranked, bounds)[::2][where]]


def first_holders(contents: list[bytes], holders: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each content, the least holder of a content that has the window."""
    words = Words(pa.array(contents, pa.binary()))
    found = holders_of_windows(words.hashes(), words.size, holders, length)
    return np.split(found, np.cumsum(words.size - length + 1)[:-1])


def holders_of_windows(hashes: np.ndarray, sizes: np.ndarray, holders: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The same for contents of so many words each, given the hashes of all words and with the windows of all contents after
    one another."""
    _, codes = np.unique(hashes, return_inverse=True)
    # a text of all contents, each ended by symbol 0
    ends = np.cumsum(sizes + 1) - 1
    sequence = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(sequence), bool)
    inside[ends] = False
    sequence[inside] = codes + 1
    index = Index(sequence, np.repeat(holders, sizes + 1), length)
    windows = sizes - length + 1
    starts = np.repeat(ends - sizes, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    found = np.repeat(holders, windows)  # its own, where a window stands nowhere else
    for at in range(0, len(starts), 100_000):
        part = np.arange(at, min(at + 100_000, len(starts)))
        reach, low, high = index.statistics(sequence, starts[part] + length - 1, length)
        whole = reach >= length
        if whole.any():
            found[part[whole]] = index.least_holder(low[whole], high[whole])
    return found


def cut_further(content: bytes, level: int, length: int = LENGTH) -> list[tuple[int, bytes, int]]:
    """The parts of a passage whose windows have the same `level` least grams: (window that a part begins with, content, key).
    Equal windows have equal grams, so they meet under one key."""
    words = content.split(b" ")
    size = min(GRAM, length)
    own = grams(Hashes().of(words), size)
    span = length - size + 1
    least = np.sort(np.lib.stride_tricks.sliding_window_view(own, span), axis=1)[:, :level]
    key = np.zeros(len(least), np.uint64)
    for column in least.T:
        key = _mixed(key * np.uint64(_ODD[1]) + column)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(first[1:], len(key)) - 1
    return [
        (a, b" ".join(words[a : b + length]), int(key[a] >> np.uint64(1)))
        for a, b in zip(first.tolist(), last.tolist(), strict=True)
    ]


CONTENTS = "shard long, doc long, last long, id long, id2 long, offset int, content binary"


def passage_ids(content: bytes) -> tuple[int, int]:
    """The 128 bits that name a passage."""
    hashes = Words(pa.array([content], pa.binary())).hashes()
    first, second = run_names(hashes, np.zeros(1, np.int64), np.array([len(hashes)]))
    return int(first[0]), int(second[0])


def bounded_groups(contents: DataFrame, length: int = LENGTH) -> DataFrame:
    """`contents` (CONTENTS; null ids stand for those of the content) with the passages of keys that have too many for one
    task cut by further grams of their windows, until none has or all grams are used. A part keeps its passage's ids."""

    def recut(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if r["id"] is None:
                        r["id"], r["id2"] = passage_ids(r["content"])
                    for at, content, key in cut_further(r["content"], level, length):
                        rows.append(r | {"shard": key, "offset": r["offset"] + at, "content": content})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, batch.schema)

        return run

    for level in range(2, length - min(GRAM, length) + 2):
        # copies are told apart only for keys that are too large with them
        crowded = contents.groupBy("shard").agg(F.sum(F.octet_length("content")).alias("bytes")).filter(F.col("bytes") > LIMIT)
        crowded = written(crowded.select("shard"), "crowded")
        if crowded.isEmpty():
            break
        distinct = contents.join(crowded, "shard", "left_semi").groupBy("shard", F.xxhash64("content").alias("part")).agg(
            F.max(F.octet_length("content")).alias("bytes"))
        hot = written(distinct.groupBy("shard").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > LIMIT).select("shard"), "hot")
        if hot.isEmpty():
            break
        again = contents.join(hot, "shard", "left_semi").select(*contents.columns).mapInArrow(recut(level), contents.schema)
        contents = written(contents.join(hot, "shard", "left_anti").select(*contents.columns).unionByName(again), "contents")
    return contents


def repeated_windows(docs: DataFrame, *, length: int = LENGTH, bits: int = BITS) -> DataFrame:
    """(doc, mark, places array<array<int>>): where windows start that also start in a smaller doc. `docs` has doc
    (long), mark (long, tells rows of one doc apart) and text."""

    def anchors_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in bounded(iter([batch]), "text", AT_ONCE):
            words, starts, of = batch_windows(part.column("text"), length)
            anchor = window_hashes(words.hashes(), length)[0][starts]
            # one of each run of equal anchors in a text; what a text repeats itself does no harm
            first = np.flatnonzero((anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])) + 1
            order = np.concatenate([[0], first]) if len(starts) else first
            ends = np.searchsorted(of[order], np.arange(part.num_rows), side="right")
            yield from (np.unique(own) for own in np.split(anchor[order], ends[:-1]))

    filled = twice_seen(docs.select("text"), anchors_of, bits)

    def windows_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in bounded(iter([batch]), "text", AT_ONCE):
            words, starts, of = batch_windows(part.column("text"), length)
            anchor, whole = (v[starts] for v in window_hashes(words.hashes(), length))
            hit = may_repeat(filled.value, anchor, bits)
            ends = np.searchsorted(of[hit], np.arange(part.num_rows), side="right")
            yield from (np.unique(own) for own in np.split(whole[hit], ends[:-1]))

    shared = twice_seen(docs.select("text"), windows_of, bits)
    kind = pa.schema([(n, pa.int64()) for n in ("doc", "mark", "start", "shard", "id", "id2", "last")] + [("content", pa.binary())])

    def passages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per passage of a document without its content, and the contents the task has met, with the least and
        the greatest document of each; their ids follow from the content."""
        told: list[pa.RecordBatch] = []
        fresh = 0

        def filled_rows(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
            rows = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in kind], schema=kind)

        def once(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            """The rows of each content as one, in the order met: passages that overlap take few bytes side by side."""
            every = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            order, one = alike_rows(every.column("id").to_numpy(), every.column("id2").to_numpy())
            met = np.argsort(order[one])
            out = every.take(pa.array(order[one][met]))
            for name, bound in (("doc", np.minimum), ("last", np.maximum)):
                held = bound.reduceat(every.column(name).to_numpy()[order], one)[met]
                out = out.set_column(out.schema.get_field_index(name), name, pa.array(held))
            return out

        def contents(rows: pa.RecordBatch) -> pa.RecordBatch:
            none = np.zeros(rows.num_rows, np.int64)
            return filled_rows(mark=none, start=none, **{c: rows.column(c) for c in ("doc", "shard", "last", "content")})

        for batch in bounded(batches, "text", AT_ONCE):
            words, starts, of = batch_windows(batch.column("text"), length)
            hashes = words.hashes()
            anchor, whole = (v[starts] for v in window_hashes(hashes, length))
            at = np.flatnonzero(may_repeat(filled.value, anchor, bits))
            at = at[may_repeat(shared.value, whole[at], bits)]
            # a passage goes on while windows of a text follow one another and have one anchor
            new = (np.diff(at, prepend=-2) != 1) | (np.diff(anchor[at], prepend=np.uint64(0)) != 0) | (np.diff(of[at], prepend=-1) != 0)
            first = np.flatnonzero(new)
            if not len(first):
                continue
            last = at[np.append(first[1:], len(at)) - 1]
            first = at[first]
            a, stop, text = starts[first], starts[last] + length, of[first]
            ids = run_names(hashes, a, stop)
            doc, mark = batch.column("doc").take(pa.array(text)), batch.column("mark").take(pa.array(text))
            told.append(once([pa.RecordBatch.from_arrays([
                *(pa.array(v) for v in ids), doc, doc,
                pa.array((anchor[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)),  # half of an anchor takes half the bytes
                pa.array(list(words.joined(a, stop)), pa.binary()),
            ], ["id", "id2", "doc", "last", "shard", "content"])]))
            fresh += told[-1].num_rows
            yield filled_rows(doc=doc, mark=mark, start=a - words.begin[text], id=ids[0], id2=ids[1])
            if fresh > MET:
                told, fresh = [once(told)], 0
                if told[0].num_rows > TOLD:
                    yield contents(told.pop())
        if told:
            yield contents(once(told))

    table = written(docs.mapInArrow(passages_of, "doc long, mark long, start long, shard long, id long, id2 long, last long, content binary"), "passages")
    contents = bounded_groups(table.filter("content is not null").select(
        "shard", "doc", "last", "id", "id2", F.lit(0).alias("offset"), "content"), length)
    size = contents.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    out = pa.schema([("id", pa.int64()), ("id2", pa.int64()), ("offset", pa.int32()), ("firsts", pa.list_(pa.int64()))])

    def search(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        words = Words(shard.column("content").combine_chunks())
        hashes = words.hashes()
        ids = run_names(hashes, words.begin, words.begin + words.size)
        # rows of one content are a group, held by the least and the greatest of their documents
        rows, one = alike_rows(*ids)
        group = np.empty(len(rows), np.int64)
        group[rows] = np.repeat(np.arange(len(one)), np.diff(np.append(one, len(rows))))
        least = np.minimum.reduceat(shard.column("doc").to_numpy()[rows], one)
        greatest = np.maximum.reduceat(shard.column("last").to_numpy()[rows], one)
        begin, sizes = words.begin[rows[one]], words.size[rows[one]]
        upto = np.cumsum(sizes)
        firsts = holders_of_windows(hashes[np.arange(upto[-1]) + np.repeat(begin - (upto - sizes), sizes)], sizes, least, length)
        windows = sizes - length + 1
        ends = np.cumsum(windows)
        some = np.maximum.reduceat(firsts < np.repeat(greatest, windows), ends - windows)
        # where the parts of passages stand in them; passages that were not cut have the ids of their content
        place = [
            pc.fill_null(shard.column(c).combine_chunks(), 0).to_numpy(zero_copy_only=False) for c in ("id", "id2", "offset")
        ]
        given = shard.column("id").is_valid().to_numpy()
        place[:2] = [np.where(given, a, b) for a, b in zip(place, ids)]
        order, each = alike_rows(*place, group)
        order = order[each]
        order = order[some[group[order]]]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(firsts))
        arrays = [*(pa.array(v[order]) for v in place), lists.take(pa.array(group[order]))]
        return pa.Table.from_arrays([v.cast(f.type) for v, f in zip(arrays, out, strict=True)], schema=out)

    found = contents.withColumn("shard", F.pmod("shard", F.lit(shards))).select("shard", "id", "id2", "offset", "doc", "last", "content").groupBy(
        "shard").applyInArrow(search, "id long, id2 long, offset int, firsts array<long>")
    places = F.expr("filter(transform(firsts, (first, i) -> if(first < doc, cast(start as int) + offset + i, -1)), at -> at >= 0)")
    return (
        table.filter("content is null").select("doc", "mark", "start", "id", "id2").join(found, ["id", "id2"])
        .select("doc", "mark", places.alias("places")).filter(F.size("places") > 0)
        .groupBy("doc", "mark").agg(F.collect_list("places").alias("places"))
    )


def drop_repeated_passages(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, bits: int = BITS,
    words: str = "n_words", removed: str = "n_removed",
) -> DataFrame:
    """`docs` with the words left in `text`, joined by one space, and the counts `words` (before) and `removed` (long).

    A word goes if a window of `length` words that covers it also starts in a document of a smaller id; all windows are
    judged on the input. Null and empty texts come out empty. A null id counts as the largest; rows that repeat an
    id are one document, each judged by its own text. Clashing columns are replaced by the two counts.
    """
    columns = [c for c in docs.columns if c not in (words, removed)]
    rows = docs.select(*columns).withColumns({
        "repeat:doc": F.coalesce(F.col(key).cast("long"), F.lit(LAST)), "repeat:mark": F.xxhash64(text),
    })
    lost = repeated_windows(
        rows.select(F.col("repeat:doc").alias("doc"), F.col("repeat:mark").alias("mark"), F.col(text).alias("text")), length=length, bits=bits
    ).select(F.col("doc").alias("repeat:doc"), F.col("mark").alias("repeat:mark"), F.flatten("places").alias("repeat:places"))
    schema = T.StructType([f if f.name != text else T.StructField(text, T.StringType()) for f in docs.select(*columns).schema])
    schema = schema.add(words, "long").add(removed, "long")

    def cut(batch: pa.RecordBatch, lost: pa.Array) -> pa.RecordBatch:
        own = Words(batch.column(text))
        # where windows that go start and end
        at = lost.flatten().to_numpy() + np.repeat(own.begin, pc.fill_null(pc.list_value_length(lost), 0).to_numpy())
        many = len(own.starts)
        gone = np.cumsum(np.bincount(at, minlength=many + 1) - np.bincount(at + length, minlength=many + 1))[:many] > 0
        so_far = np.concatenate([[0], np.cumsum(gone)])
        # runs of words that stay, each in one text
        edge = np.zeros(many + 1, bool)
        edge[own.begin] = edge[-1] = True
        first = np.flatnonzero(~gone & (edge[:-1] | np.concatenate([[True], gone[:-1]])[:many]))
        stop = np.flatnonzero(~gone & (edge[1:] | np.concatenate([gone[1:], [True]])[:many])) + 1
        runs = list(own.joined(first, stop))
        bounds = np.searchsorted(first, np.append(own.begin, many)).tolist()
        left = [b" ".join(runs[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        arrays = [batch.column(c) if c != text else pa.array(left, pa.binary()).cast(pa.string()) for c in columns]
        removed_words = so_far[own.begin + own.size] - so_far[own.begin]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(own.size), pa.array(removed_words)], [*columns, words, removed])

    # documents that have lost nothing need no shuffle: a filter of those that have tells them apart
    def losers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        found = np.unique(_row_hashes(batch))
        return iter([found, found])

    lost = written(lost, "lost")
    held = twice_seen(lost.select("repeat:doc", "repeat:mark"), losers, LOSERS)

    # each stage has one step of Python, so an executor has no more workers than cores
    def losing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_repeat(held.value, _row_hashes(batch), LOSERS)))

    def kept_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text, AT_ONCE):
            own = batch.filter(pa.array(~may_repeat(held.value, _row_hashes(batch), LOSERS)))
            yield cut(own, pa.nulls(own.num_rows, pa.list_(pa.int64())))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text, AT_ONCE):
            yield cut(batch, batch.column("repeat:places"))

    touched = rows.mapInArrow(losing, rows.schema).join(lost, ["repeat:doc", "repeat:mark"], "left").select(*columns, "repeat:places")
    return touched.mapInArrow(thinned, schema).unionByName(rows.mapInArrow(kept_whole, schema))


def _row_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """A hash of the document and the mark of each row."""
    doc, mark = (batch.column(c).to_numpy().view(np.uint64) for c in ("repeat:doc", "repeat:mark"))
    return _mixed(_mixed(doc * np.uint64(_ODD[2])) + mark)
