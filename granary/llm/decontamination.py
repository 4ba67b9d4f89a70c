"""Documents that hold an item of a benchmark, by SimHash fingerprints of windows of an item's size.

Windows are laid where a document shares enough shingles with items of one size, fingerprinted, and found by blocks of the
fingerprint near to an item's (multi-index Hamming search, complete within its radius). Exact weighted Jaccard similarity of
the shingles decides. Everything is a row per place or window, so a very long or repetitive document costs in proportion to
its words.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.store import written

SHINGLE = 5
#: Bits in which a window's fingerprint may differ from an item's. Two sets of similarity 0.8 differ in some 10 of 64 bits, with a
#: deviation of 3; more than 23 have a chance below 1 in 10,000.
RADIUS = 23
#: One of the blocks then differs in at most RADIUS / BLOCKS bits: 2, so an item has 37 entries a block.
BLOCKS = 8
#: Rows of benchmark shingles up to which they are sent to every task (24 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of any other side of a join up to which it is sent to every task: some 100 bytes each as a hash table, which the driver
#: builds, and a query has a handful of them.
SENT_ROWS = 200_000


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has so many rows: sent to all tasks if they are few, else shuffled, as the other side then is.
    The planner goes by the sizes of compressed files, a tenth or less of what the driver would hold."""
    return df.hint("broadcast" if rows <= SENT_ROWS else "merge")


def _words(text: str) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashes(words: str, run: int) -> Column:
    return F.when(
        F.size(words) >= run,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - run),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(run)]),
        ),
    )


def with_shingles(df: DataFrame, text: str, to: str, run: int = SHINGLE) -> DataFrame:
    """Add the hashes of a text's runs of five words, in order; null where there are none. A filter on the array, also
    one that `explode` implies, would move below it and compute the words anew for each element."""
    return df.withColumn("_words", _words(text)).withColumn(to, _hashes("_words", run)).drop("_words")


def with_simhash(df: DataFrame, hashes: str, to: str) -> DataFrame:
    """Add the 64-bit SimHash of an array of hashes, each counted as often as it stands there: a bit is set if it is
    set in over half of them. Bits are counted in pairs, 32 apart, in the halves of a long."""
    counts = F.expr(
        f"transform(sequence(0, 31), k -> aggregate(`{hashes}`, 0L, (n, h) -> n + (shiftrightunsigned(h, k) & 4294967297L)))"
    )
    mark = F.expr(
        f"aggregate(sequence(0, 31), 0L, (m, k) -> m"
        f" | shiftleft(if(2 * (`_counts`[k] & 4294967295L) > size(`{hashes}`), 1L, 0L), k)"
        f" | shiftleft(if(2 * shiftrightunsigned(`_counts`[k], 32) > size(`{hashes}`), 1L, 0L), k + 32))"
    )
    return df.withColumn("_counts", counts).withColumn(to, mark).drop("_counts")


def _block(mark: str, block: str) -> str:
    width = 64 // BLOCKS
    return f"(shiftrightunsigned({mark}, {block} * {width}) & {(1 << width) - 1}L)"


def hamming_pairs(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of a window (columns of `windows`, with `mark` and `length`) and an item of that length (`item`, `item_mark`,
    `length`) whose fingerprints differ in at most `radius` bits: all such pairs, as one of the blocks of both then differs
    in at most radius / BLOCKS bits. Items, the small side, are entered under every value that near to each of their blocks."""
    width, near = 64 // BLOCKS, radius // BLOCKS
    masks = [sum(1 << b for b in bits) for n in range(near + 1) for bits in combinations(range(width), n)]
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    entered = items.select("item", "item_mark", "length", blocks).withColumn("value", F.expr(_block("item_mark", "block"))).withColumn(
        "value", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(F.col("value"))))
    )
    entered = written(entered, "entered")
    asked = windows.select("*", blocks).withColumn("value", F.expr(_block("mark", "block")))
    met = asked.join(_sent(entered, entered.count()), ["length", "block", "value"]).filter(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= radius)
    return met.drop("block", "value", "length").distinct()


_WINDOW = ["doc", "version", "length", "start"]


def _laid(met: DataFrame, least: float) -> DataFrame:
    """(doc, version, length, start): the windows of `length` shingles that can be the best of a document and an item, out
    of the places where they share one (doc, version, length, place, offset).

    A window can be moved until a shared shingle is its first one, or, where the document's start cuts it, its last one,
    and shares no fewer; so only such windows are laid, and those that bring a shingle to its place in the item. They
    stay if they hold at least as many shared places as a hit must. These are counted for all windows of a document in one
    pass: its places, and the begins and ends of its windows, in order.
    """
    place, length = F.col("place"), F.col("length")
    cut = place - length + 1
    starts = F.array(place, place - F.col("offset"), F.when(cut < 0, cut).otherwise(place))
    windows = met.select("doc", "version", "length", F.explode(starts).alias("start")).distinct()
    none = F.lit(None).cast("int")
    marks = (
        met.select("doc", "version", "length", "place").distinct()
        .select("doc", "version", "length", place.alias("at"), F.lit(1).alias("kind"), none.alias("start"))
        .unionByName(windows.select("doc", "version", "length", F.col("start").alias("at"), F.lit(0).alias("kind"), "start"))
        .unionByName(windows.select("doc", "version", "length", (F.col("start") + length - 1).alias("at"), F.lit(2).alias("kind"), "start"))
    )
    order = Window.partitionBy("doc", "version", "length").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    so_far = marks.withColumn("seen", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(order)).filter("kind <> 1")
    held = so_far.groupBy(*_WINDOW).agg((F.max("seen") - F.min("seen")).alias("held"))
    return held.filter(F.col("held") >= F.ceil(F.lit(least) * length - 1e-9)).drop("held")


def _contents(windows: DataFrame, shingles: DataFrame) -> DataFrame:
    """A row per shingle of each window (all columns of `windows`, hash), cut at the ends of the document. Both sides are
    shuffled: the planner does not see how much an explode adds, and would have the driver hold every place of all windows."""
    places = F.sequence(F.greatest("start", F.lit(0)), F.col("start") + F.col("length") - 1)
    return windows.withColumn("place", F.explode(places)).join(shingles.hint("merge"), ["row", "place"]).drop("place")


def _fingerprints(windows: DataFrame, shingles: DataFrame) -> DataFrame:
    """(window, row, length, start, shingles, mark): one window of those of a document that hold the same shingles, the first."""
    lanes = [F.sum(F.expr(f"shiftrightunsigned(hash, {k}) & 4294967297L")).alias(f"_b{k}") for k in range(32)]
    counted = _contents(windows, shingles).groupBy("row", "length", "start").agg(
        F.count("*").alias("shingles"), F.sum(F.expr("shiftrightunsigned(xxhash64(hash), 24)")).alias("content"), *lanes)
    mark = F.expr(" | ".join(
        f"shiftleft(if(2 * (_b{k} & 4294967295L) > shingles, 1L, 0L), {k}) | shiftleft(if(2 * shiftrightunsigned(_b{k}, 32) > shingles, 1L, 0L), {k + 32})"
        for k in range(32)
    ))
    marked = counted.withColumn("mark", mark)
    same = marked.groupBy("row", "length", "shingles", "content", "mark").agg(F.min("start").alias("start"))
    return written(same.drop("content").withColumn("window", F.monotonically_increasing_id()), "windows")


def _short_hits(rows: DataFrame, short: DataFrame, run: int) -> DataFrame:
    """Where documents hold items of `run` words, fewer than a shingle has: all the words in order."""
    wanted = with_shingles(short.filter(F.col("words") == run), "_text", "hashes", run).select("item", F.col("hashes")[0].alias("hash"))
    held = with_shingles(rows, "_text", "hashes", run).select("doc", F.posexplode_outer("hashes").alias("start", "hash"))
    return held.join(wanted, "hash").select("doc", "item", "start", F.lit(1.0).alias("similarity"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", least: float = 0.8, radius: int = RADIUS,
) -> DataFrame:
    """(key, item_key, similarity, start, length): each document that holds a benchmark item, with the best window.

    For each item a window of as many words is laid over a document, also cut at its ends; hits are the pairs whose
    best window has a weighted Jaccard similarity of `least` or more, with shingles of five words counted as
    often as they stand. Windows are compared with the items whose SimHash fingerprint is within `radius` bits of theirs. `start`
    counts words from 0. An item of fewer than five words is one shingle of all its words. Texts and items without words, and
    null ones, are never hits; rows that repeat a key are judged one by one and reported together; null keys of
    documents and items are keys like any other.
    """
    given = with_shingles(
        benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("name"), F.col(item_text).alias("_text")),
        "_text", "item_hashes",
    ).withColumn("words", F.size(_words("_text"))).withColumn("length", F.size("item_hashes"))
    given = written(with_simhash(given, "item_hashes", "item_mark"), "items")
    items = given.filter("item_hashes is not null").drop("_text")
    seeds = written(
        items.select("length", F.posexplode("item_hashes").alias("offset", "hash"))
        .groupBy("hash", "length").agg(F.min("offset").alias("offset")),
        "seeds",
    )
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("_text"))
    every = with_shingles(rows, "_text", "hashes").select("doc", "version", F.posexplode_outer("hashes").alias("place", "hash"))
    known = seeds.hint("broadcast" if seeds.count() <= BROADCAST_ROWS else "merge")
    met = written(every.join(known, "hash").drop("hash"), "met")
    laid = written(_laid(met, least), "laid")
    # only documents with such a window come this far; their shingles are made once more
    chosen = written(laid.select("doc", "version").distinct().withColumn("row", F.monotonically_increasing_id()), "chosen")
    documents = chosen.count()
    named = _sent(chosen.select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), "row"), documents)
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version"))
    held = rows.join(named, same).groupBy("row").agg(F.first("_text").alias("_text"))  # equal rows are one
    shingles = written(with_shingles(held, "_text", "hashes").select("row", F.posexplode_outer("hashes").alias("place", "hash")), "shingles")
    windows = _fingerprints(laid.join(named, same).select("row", "length", "start"), shingles)
    pairs = written(hamming_pairs(windows.select("window", "mark", "length", "shingles"), items.select("item", "item_mark", "length"), radius), "pairs")
    many = pairs.count()
    asked = windows.join(_sent(pairs.select("window").distinct(), many), "window", "left_semi").select("window", "row", "length", "start")
    of_window = _contents(asked, shingles).groupBy("window", "hash").agg(F.count("*").alias("n"))
    of_item = written(
        items.select("item", F.col("length").alias("item_shingles"), F.explode("item_hashes").alias("hash"))
        .groupBy("item", "item_shingles", "hash").agg(F.count("*").alias("item_n")),
        "of_item",
    )
    alike = (
        _sent(pairs.select("window", "item", "shingles"), many).join(of_window, "window")
        .join(_sent(of_item, of_item.count()), ["item", "hash"])
        .groupBy("window", "item", "shingles", "item_shingles").agg(F.sum(F.least("n", "item_n")).alias("both"))
        .withColumn("similarity", F.col("both") / (F.col("shingles") + F.col("item_shingles") - F.col("both")))
        .filter(F.col("similarity") >= least)
    )
    found = alike.join(_sent(windows.select("window", "row", "start"), windows.count()), "window").join(_sent(chosen, documents), "row").select(
        "doc", "item", F.greatest("start", F.lit(0)).alias("start"), "similarity")
    short = given.filter(F.col("words").between(1, SHINGLE - 1))
    for run in sorted(r["words"] for r in short.select("words").distinct().collect()):
        found = found.unionByName(_short_hits(rows, short, run))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "words")).alias("best")
    return (
        found.join(_sent(given.select("item", "name", "words"), given.count()), "item").groupBy("doc", "name").agg(best)
        .select(
            F.col("doc").alias(key), F.col("name").alias(item_key), F.round("best.similarity", 6).alias("similarity"),
            (-F.col("best.start")).alias("start"), F.col("best.words").alias("length"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of `docs`, all columns, whose key is no hit."""
    key = str(options.get("key", "doc_id"))
    hits = written(contaminated(docs, benchmark, **options).select(F.col(key).alias("hit:key")).distinct(), "hits")  # type: ignore[arg-type]
    return docs.join(_sent(hits, hits.count()), docs[key].eqNullSafe(F.col("hit:key")), "left_anti")
