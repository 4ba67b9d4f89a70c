"""Near-duplicate documents by SimHash: every fingerprint emits its ball of half the radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.graph import components
from granary.llm.store import written

#: Shingles whose bits are counted at once, so that a very long text needs no more memory.
AT_ONCE = 65_536
SEED = 42


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles in order, in parts of bounded size: A-Z in lower case, words cut at ASCII white space, runs
    of so many words (all the words if there are fewer). Nothing for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    behind = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    ends = behind[k - 1 :].tolist()
    starts = [0, *(behind[: len(ends) - 1] + 1).tolist()]
    for at in range(0, len(ends), AT_ONCE):
        cut = zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True)
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in cut], "<u8")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a text's shingles: a bit is set if it is set in over half of their hashes. A text without words has 0."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str, shingle: int = 3) -> DataFrame:
    """`df` with the text replaced by `fingerprint` (long). Null texts have 0, like texts without words."""
    schema = df.drop(text).schema.add("fingerprint", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text).cast(pa.binary())
            marks = [fingerprint(v.as_py() or b"", shingle) for v in column]
            rest = batch.drop_columns([text])
            yield rest.append_column("fingerprint", pa.array(marks, pa.int64()))

    return df.mapInArrow(run, schema)


def ball(mark: Column, radius: int) -> Column:
    """All values that differ from a 64-bit mark in at most `radius` bits, itself first."""
    masks = [0]
    for n in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m) for m in signed]), lambda mask: mark.bitwiseXOR(mask))


def near_links(marks: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in at most `radius` bits (even), enough of them
    to reach each from each that all such pairs would connect.

    Two such fingerprints have a value half-way between them, so both emit it. All that emit one value are
    within the radius of each other; each links to the next larger, which keeps them connected
    without listing pairs. A value is emitted by at most as many fingerprints as a ball has values
    (65 for radius 2), whatever the corpus holds.
    """
    variants = marks.select(
        F.col("fingerprint").alias("mark"), F.explode(ball(F.col("fingerprint"), radius // 2)).alias("variant")
    )
    before = F.lag("mark").over(Window.partitionBy("variant").orderBy("mark"))
    pairs = variants.select("mark", before.alias("other")).filter(F.col("other").isNotNull()).distinct()
    return pairs.filter(F.bit_count(F.col("mark").bitwiseXOR(F.col("other"))) <= radius).select(
        F.col("mark").alias("a"), F.col("other").alias("b")
    )


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(key, fingerprint, component): `component` is the least key that a document reaches over links of
    fingerprints at most `radius` bits apart.

    Equal fingerprints, with them those of texts without words (0), are one node however many documents share
    them: the search sees distinct fingerprints only. A null key has a row, but names no component;
    a component of null keys alone has a null one. Rows that repeat a key are documents of their own.
    """
    own = written(with_fingerprint(docs.select(key, text), text, shingle), "fingerprints")
    marks = own.groupBy("fingerprint").agg(F.min(key).alias("least"))
    roots = components(near_links(marks, radius))
    rooted = marks.join(roots, marks["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = written(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fingerprint", "component")
    return own.join(named, "fingerprint").select(key, "fingerprint", "component")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of `docs` with the least key of their component; where rows share that key, the one with the
    least text. Rows with a null key stay if no other key is in their component."""
    return least_rows(docs, near_duplicates(docs, key=key, text=text, shingle=shingle, radius=radius), key, text)


def least_rows(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of `docs` whose key is that of their `component` in `found`; of rows that share it, the one with the least text."""
    stay = found.filter(F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("stay:key")).distinct()
    columns = docs.columns
    kept = docs.join(stay, docs[key].eqNullSafe(F.col("stay:key")), "left_semi")
    place = F.row_number().over(Window.partitionBy(key).orderBy(text))
    return kept.withColumn("stay:place", place).filter(F.col("stay:place") == 1).select(*columns)
