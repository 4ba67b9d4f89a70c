"""Documents whose sets of word n-grams are similar: a self-join on rare prefix n-grams.

Equal sets are one node from the start. The grams of a set are ordered rarest first by counts over the whole corpus; two
sets of the similarity asked for share a gram of their first few, so only sets that meet there, in a bucket, are
compared. What a pair must pass before its sets are fetched: the length filter, the positional filter (too few grams
behind the shared one) and the suffix filter (counts of grams by slice of the hash space that differ too much), first with
as many slices for all sets, then with some four grams to a slice, a thirtieth of the set's bytes.

A bucket that many near copies share holds far too many pairs, nearly all between sets that links already connect. So
buckets are worked off in rounds: all members against the member whose shared gram comes first, then against some 16 more,
256 more and so on, each time only across components; a bucket is done when what is left of it is connected. Every
pair of a bucket is compared or connected in the end, so no component is missed whatever the group's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.bloom import may_repeat, twice_seen
from granary.llm.graph import components
from granary.llm.store import written
from granary.llm.substrings import Hashes, grams
from granary.llm.tokens import bounded

#: log2 of the counters that order the grams: 32 MB in a task, 8 MB when told to all. They decide the order only.
COUNTERS = 23
#: log2 of the counters of a part that travels by itself.
PART = 14
#: Slices of the hash space in the suffix filter.
SLICES = 16
#: Grams to a slice of a set's fine shape, at most.
FINE = 4
#: Sets compared with one other in a task.
TOGETHER = 64
#: Nodes that a task remembers, so that it sends those that many documents share once.
TOLD = 200_000
#: Bytes of text looked at in one go.
AT_ONCE = 2_000_000
#: log2 of the bits of the filter of repeated grams, and of those of wanted documents and sets.
BITS = 28
WANTED = 24
#: Rows of ids (24 bytes each) up to which a table is sent to every task; beyond, both sides of a join are shuffled.
BROADCAST_ROWS = 1_000_000


def shingles(text: bytes, size: int, hashes: Hashes) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes in ascending order: A-Z in lower case, words cut at ASCII white
    space, runs of `size` words; all the words, if there are fewer; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = hashes.of(words)
    # the number of words is mixed in, so that a short text never equals a run of another's words
    return np.unique(grams(own, min(size, len(words))) + np.uint64(min(size, len(words))))


def node_of(own: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    number = xxh3_64_intdigest(own.tobytes())
    return number - (1 << 64) if number >> 63 else number


def prefix_length(n: int, percent: int) -> int:
    """How many grams, in any common order, sets of that similarity must meet in."""
    return n - -(-percent * n // 100) + 1


def counted(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """A row (key, node, n, grams) per document, the grams once for each task that meets the set, if sets of that size can be
    similar to others at all; per task, rows (part, counts) with how often its grams fell to each counter."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, node long, n long, held boolean, grams binary, part int, counts binary"
    names = [key, "node", "n", "held", "grams", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counters, told = Hashes(), np.zeros(1 << COUNTERS, np.uint32), set()
        types = None
        for batch in bounded(batches, text, AT_ONCE):
            types = batch.schema.field(key).type
            nodes, sizes, sets, every = [], [], [], []
            for value in batch.column(text).cast(pa.binary()):
                own = shingles(value.as_py() or b"", size, hashes)
                node = node_of(own) if len(own) else None
                known = node in told or 100 * len(own) < percent * (len(own) + 1)
                if not known:
                    if len(told) >= TOLD:
                        told.clear()
                    told.add(node)
                nodes.append(node)
                sizes.append(len(own))
                sets.append(None if known else own.tobytes())
                every.append(own)
            np.add.at(counters, (np.concatenate(every) >> np.uint64(64 - COUNTERS)).astype(np.int64), np.uint32(1))
            empty = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array([s is not None for s in sets]), pa.array(sets, pa.binary()),
                empty.cast(pa.int32()), empty.cast(pa.binary()),
            ], names)
        if types is None:
            return
        for part, own in enumerate(counters.reshape(-1, 1 << PART)):
            if own.any():
                data = zlib.compress(np.minimum(own, 65_535).astype("<u2").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(1, types), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()),
                    pa.array([part], pa.int32()), pa.array([data]),
                ], names)

    return docs.select(key, text).mapInArrow(run, schema)


def frequency_classes(parts: DataFrame) -> Broadcast:
    """One byte per counter: four classes to each doubling of its count over all tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(data.as_py()), "<u2")
                held[part] = held[part] + own if part in held else own.astype(np.uint64)
        for part, times in held.items():
            classes = np.floor(4 * np.log2(np.maximum(times, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([classes.tobytes()])], ["part", "classes"])

    spark = parts.sparkSession
    out = np.zeros(1 << COUNTERS, np.uint8).reshape(-1, 1 << PART)
    # 8 MB in all, whatever the input
    for row in parts.repartition(16, "part").mapInArrow(add, "part int, classes binary").collect():
        out[row["part"]] = np.frombuffer(row["classes"], np.uint8)
    return spark.sparkContext.broadcast(out)


def rare_first(own: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The grams as numbers whose order is rarest first, ties by hash: the class in the first byte, then the hash."""
    kind = classes[(own >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.uint64)
    return np.sort((kind << np.uint64(56)) | (own >> np.uint64(8)))


def fine_shape(own: np.ndarray) -> bytes:
    """How many grams lie in each of 2, 4, 8 … slices of the hash space, a byte each, so many that FINE lie in a slice at most on
    average; empty, which says nothing, if a count has no room in a byte."""
    bits = max(1, (len(own) // FINE).bit_length())
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def fine_alike(x: bytes, y: bytes, percent: int) -> bool:
    """The suffix filter on fine shapes: slices of the finer one are added up to those of the other."""
    if not x or not y:
        return True
    few, more = sorted((np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y)), key=len)
    both = int(few.sum() + more.sum())
    apart = int(np.abs(few - more.reshape(len(few), -1).sum(axis=1)).sum())
    return apart <= both - 2 * -(-percent * both // (100 + percent))


def prefixes(sets: DataFrame, first: DataFrame, percent: int, classes: Broadcast) -> DataFrame:
    """(node, n, slices, fine, prefix) of those sets (mark, node, n, grams) whose mark is in the one column of `first`, and a few
    others: their grams by slice, and the first of them in order."""
    held = filter_of(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(classes.value, np.uint8)
        for whole in batches:
            batch = whole.filter(pa.array(may_repeat(held.value, _marks(whole.column("mark")), WANTED)))
            slices, fine, prefix = [], [], []
            for value in batch.column("grams"):
                own = np.frombuffer(value.as_py(), np.uint64)
                slices.append(np.bincount((own >> np.uint64(60)).astype(np.int64), minlength=SLICES))
                fine.append(fine_shape(own))
                prefix.append(rare_first(own, order)[: prefix_length(len(own), percent)].tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("n"), pa.array(slices, pa.list_(pa.int32())), pa.array(fine, pa.binary()),
                pa.array(prefix, pa.binary()),
            ], ["node", "n", "slices", "fine", "prefix"])

    return sets.mapInArrow(run, "node long, n long, slices array<int>, fine binary, prefix binary")


def only_once(nodes: DataFrame) -> DataFrame:
    """One row of each node of a written table (node, row, …): only their numbers are shuffled unless very many repeat."""
    again = nodes.groupBy("node").agg(F.count("*").alias("many"), F.min("row").alias("one")).filter("many > 1").select("node", "one")
    return nodes.join(small(written(again, "again")), "node", "left").filter("one is null or row = one").drop("row", "one")


def suspected(nodes: DataFrame) -> DataFrame:
    """(token, node, pos, n) for the prefix grams that another set may have."""

    def grams_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (np.unique(_spread(np.frombuffer(value.as_py(), np.uint64))) for value in batch.column(0))

    again = twice_seen(nodes.select("prefix"), grams_of, BITS, stored=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, of, pos = [], [], []
            for row, value in enumerate(batch.column("prefix")):
                own = np.frombuffer(value.as_py(), np.uint64)
                at = np.flatnonzero(may_repeat(again.value, _spread(own), BITS))
                tokens.append(own[at].view(np.int64))
                of.append(np.full(len(at), row))
                pos.append(at)
            of = pa.array(np.concatenate(of).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens)), batch.column("node").take(of), pa.array(np.concatenate(pos).astype(np.int64)), batch.column("n").take(of)],
                ["token", "node", "pos", "n"],
            )

    return nodes.select("node", "n", "prefix").mapInArrow(run, "token long, node long, pos long, n long")


def _spread(tokens: np.ndarray) -> np.ndarray:
    """Tokens begin with a class; the filter wants all bits alike."""
    return tokens * np.uint64(0x9E3779B97F4A7C15) ^ (tokens << np.uint64(40))


def overlap(n: Column, m: Column, percent: int) -> Column:
    """The least number of grams that similar sets of n and m grams share."""
    return F.ceil(percent * (n + m) / (100 + percent))


def admissible(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """The length filter, and the positional filter at a shared gram: exact where it is the first that the sets share,
    and pairs need to pass only there."""
    lengths = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    return lengths & (F.least(n - pos, m - at) >= overlap(n, m, percent))


def alike(n: Column, x: Column, m: Column, y: Column, percent: int) -> Column:
    """The suffix filter: the grams that two sets do not share number at least as many as their slices differ."""
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.abs(p - q)), F.lit(0), lambda total, d: total + d)
    return apart <= n + m - 2 * overlap(n, m, percent)


def _marks(column: pa.Array) -> np.ndarray:
    return _spread(column.to_numpy(zero_copy_only=False).view(np.uint64))


def filter_of(wanted: DataFrame) -> Broadcast:
    """A filter of 2 MB that holds the values (long) of the one column of `wanted`."""

    def twice(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        found = np.unique(_marks(batch.column(0)))
        return iter([found, found])  # a hash given twice is held by the filter

    return twice_seen(wanted, twice, WANTED)


def wanted_only(df: DataFrame, mark: str, wanted: DataFrame) -> DataFrame:
    """The rows of `df` whose `mark` (long) is in the one column of `wanted`, and a few others: cut by a filter before
    anything is shuffled."""
    held = filter_of(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_repeat(held.value, _marks(batch.column(mark)), WANTED)))

    return df.mapInArrow(run, df.schema)


def small(df: DataFrame) -> DataFrame:
    """A written table of a few columns, sent to all tasks if it has no more rows than BROADCAST_ROWS; the rows it is joined
    with are then not shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def matched(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """`df` joined by node (long) with a written table of a few columns. Where that goes to all tasks `df` is not shuffled, so
    there is nothing to cut before; else a filter cuts rows that have no match."""
    sent = small(wanted)
    return df.join(sent, "node") if sent is not wanted else wanted_only(df, "node", wanted.select("node")).join(wanted, "node")


def compared(pairs: DataFrame, values: DataFrame, passes: Callable[[bytes, bytes], bool], few: bool) -> DataFrame:
    """The pairs (a, b) whose values (node, value; rows of a node are equal) pass. The value of b travels once for every few
    compared with it. Unless the values are `few` bytes, those that no pair asks for are cut before a join that shuffles them."""
    many = pairs.groupBy("b").agg(F.count("*").alias("many"))
    dealt = pairs.join(many, "b").select("a", "b", F.expr(f"pmod(xxhash64(a), 1 + many div {TOGETHER})").alias("salt"))
    asked = written(dealt.select(F.col("a").alias("node"), "b", "salt", "a").unionByName(
        dealt.select(F.col("b").alias("node"), "b", "salt", F.lit(None).cast("long").alias("a")).distinct()
    ), "asked")
    sent = (values.join(small(asked), "node") if few else matched(values, asked)).select("b", "salt", "a", "value").repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other, before = None, b"", None
        for batch in batches:
            found = []
            for b, salt, a, value in zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "a")), batch.column("value"), strict=True):
                if a is None:
                    if (b, salt) != own:  # other tasks may have sent the same value
                        own, other = (b, salt), value.as_py()
                elif (b, salt, a) != before:
                    before = (b, salt, a)
                    if passes(value.as_py(), other):
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets of grams in ascending order are similar enough."""
    few, more = sorted((np.frombuffer(v, np.uint64) for v in (x, y)), key=len)
    place = np.minimum(np.searchsorted(more, few), len(more) - 1)
    both = int((more[place] == few).sum())
    return 100 * both >= percent * (len(few) + len(more) - both)


def verified(pairs: DataFrame, fine: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, value) are similar enough; sets travel of those whose fine shapes (node, value) are."""
    close = written(compared(pairs, fine, lambda x, y: fine_alike(x, y, percent), few=True), "close")
    return compared(close, sets, lambda x, y: similar(x, y, percent), few=False)


def _pairs(found: DataFrame) -> DataFrame:
    """Each pair once, whichever of its ends came first."""
    return found.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(
        F.min(F.struct("b", "a")).alias("one")).select(F.col("one.a").alias("a"), F.col("one.b").alias("b"))


def linked(rows: DataFrame, classes: Broadcast, *, key: str, percent: int) -> DataFrame | None:
    """(node, root) of the nodes that links of similar sets connect, given `counted` rows; None if there are none. The driver
    lets go of `classes` once they are used."""
    sets = rows.filter("held").select(F.xxhash64(key).alias("mark"), "node", "n", "grams")
    # of documents with equal sets one is enough; others that hold the set in another task are cut by their key
    first = rows.filter("held").groupBy("node").agg(F.min(key).alias(key)).select(F.xxhash64(key))
    nodes = only_once(written(prefixes(sets, first, percent, classes).withColumn("row", F.monotonically_increasing_id()), "prefixes"))
    classes.destroy()
    entries = written(suspected(nodes), "entries")
    stats = entries.groupBy("token").agg(F.count("*").alias("many"), F.min(F.struct("pos", "n", "node")).alias("first")).filter("many > 1")
    # sixteen times as many members of a bucket lead in each round; the first is the one whose shared gram comes first
    place = F.expr("shiftrightunsigned(xxhash64(token, node), 11)") / float(1 << 53) * F.col("many")
    level = F.when(F.col("node") == F.col("first.node"), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log2(place) / 4)).cast("int"))
    buckets = written(entries.join(stats, "token").withColumn("level", level), "buckets")
    active = written(buckets.groupBy("node").agg(F.first("n").alias("n")), "active")
    shapes = written(
        matched(nodes.select("node", "slices"), active)
        .groupBy("node", "n").agg(F.first("slices").alias("slices")), "shapes")
    begun = _pairs(buckets.filter(
        (F.col("level") > 0) & admissible(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos"), percent)
    ).select(F.col("node").alias("a"), F.col("first.node").alias("b")))
    left_shapes = shapes.select(F.col("node").alias("a"), "n", F.col("slices").alias("x"))
    right_shapes = shapes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("slices").alias("y"))
    begun = written(
        begun.join(left_shapes, "a").join(right_shapes, "b").filter(alike(F.col("n"), F.col("x"), F.col("m"), F.col("y"), percent)).select("a", "b"),
        "begun",
    )
    rest = buckets.filter("many > 2 and level > 0").select("token", "node", "pos", "n", "level")
    if begun.isEmpty() and rest.isEmpty():
        return None
    sets = sets.select("node", F.col("grams").alias("value"))
    fine = nodes.select("node", F.col("fine").alias("value"))

    links: DataFrame | None = None
    tested: DataFrame | None = None
    roots: DataFrame | None = None

    def test(pairs: DataFrame) -> None:
        nonlocal links, tested, roots
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            return
        found = written(verified(pairs, fine, sets, percent), "similar")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = components(links)

    def rooted(df: DataFrame, node: str, root: str) -> DataFrame:
        if roots is None:
            return df.withColumn(root, F.col(node))
        known = small(roots).select(F.col("node").alias(node), F.col("root").alias(root))
        return df.join(known, node, "left").withColumn(root, F.coalesce(root, node))

    def open_pairs(pairs: DataFrame) -> DataFrame:
        """Those across components that have not been compared yet."""
        pairs = rooted(rooted(pairs, "a", "root"), "b", "other").filter("root <> other").select("a", "b")
        if tested is None:
            return pairs
        done = tested.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        marked = pairs.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
        return marked.join(done, ["low", "high"], "left_anti").select("a", "b")

    test(begun.groupBy("a").agg(F.min("b").alias("b")))
    test(open_pairs(begun))
    turn = 1
    while True:
        rest = written(rooted(rest.filter(F.col("level") >= turn).drop("root"), "node", "root"), "rest")
        spread = rest.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
        spread = written(spread, "spread")
        if spread.isEmpty():
            return roots
        rest = rest.join(small(spread), "token", "left_semi")
        shaped = written(rest.join(shapes.select("node", "slices"), "node"), "shaped")
        leads = shaped.filter(F.col("level") == turn).select(
            "token", F.col("node").alias("lead"), F.col("pos").alias("at"), F.col("n").alias("m"), F.col("slices").alias("y"), F.col("root").alias("other"))
        met = shaped.join(leads, "token").filter(
            (F.col("root") != F.col("other")) & ((F.col("level") > turn) | (F.col("node") > F.col("lead")))
            & admissible(F.col("n"), F.col("pos"), F.col("m"), F.col("at"), percent)
            & alike(F.col("n"), F.col("slices"), F.col("m"), F.col("y"), percent)
        ).select(F.col("node").alias("a"), F.col("lead").alias("b"))
        test(open_pairs(_pairs(met)))
        turn += 1


def similar_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component): the size of a document's set, and the least key that it reaches over links of
    Jaccard similarity of at least `percent` hundredths.

    Sets are distinct runs of `size` words; a text of fewer words is one run; null texts and texts without words have none
    and are linked with nothing, so each is its own component. A null key has a row but names no component; a component
    of null keys alone has a null one. Rows that repeat a key are documents of their own. Sets and grams are
    told apart by 64-bit hashes.
    """
    rows = written(counted(docs.select(key, text), key, text, size, percent), "counted")
    classes = frequency_classes(rows.filter("part is not null").select("part", "counts"))
    rows = rows.filter("part is null").drop("part", "counts")
    roots = linked(rows, classes, key=key, percent=percent)
    own = rows.select(key, "node", "n")
    # copies are added up before anything is joined with them
    least = own.filter("node is not null").groupBy("node").agg(F.min(key).alias("least"))
    if roots is None:
        named = least.select("node", F.col("least").alias("component"))
    else:
        rooted = written(least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
        named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    alone = F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component"))
    return own.join(written(named, "named"), "node", "left").select(key, F.col("n").alias("n_shingles"), alone.alias("component"))
