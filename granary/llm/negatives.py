"""Hard negatives for anchors: a shuffle with secondary sort, read as a stream.

Every row is scored against every anchor, in blocks: tasks hold a block of rows and read the anchors, block by block, from
the shared folder. Of a block's pairs only those that can be in the result travel: the first positives of each anchor,
then, once the anchors' positives and with them the windows of scores are known, the first negatives of each window. The
pairs are dealt by anchor and sorted by (anchor, descending score, id) within their partitions, the DataFrame form of
repartitionAndSortWithinPartitions. An iterator passes over them once: a positive opens its window, the
negatives behind it are emitted while their window is open, and no anchor's pairs are ever held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.store import shared_batches, written

#: Components of the rows that a task holds: 32 MB. Rows and anchors that are scored at once: 16 MB of scores.
HELD = 1 << 22
AT_ONCE = 4_096
ANCHORS = 512
LAST = (1 << 63) - 1


def usable(rows: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, vector array<long>): components as floor(scale * x). Rows with a null in one of the three or a component
    that is null or not finite go; of rows that share an id the one with the least label, then vector, stays."""
    x = lambda v: v.cast("double")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    whole = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.when(finite, F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * x(v)))).alias("vector"),
    ).filter("id is not null and label is not null and vector is not null")
    one = whole.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("id", "row.label", "row.vector")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; missing components count as 0."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b, exact; beyond 64 bits they stop at the ends of the range."""
    most = a.shape[1] * max(-int(a.min(initial=0)), int(a.max(initial=0))) * max(-int(b.min(initial=0)), int(b.max(initial=0)))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -LAST - 1, LAST).astype(np.int64)


def first_of(score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` highest scores, ties by smaller id."""
    if len(score) > 4 * count:
        least = np.partition(score, len(score) - count)[len(score) - count]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], ~score[at]))[:count]]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors, some HELD components at a time."""
    held: list[pa.RecordBatch] = []
    rows = max(1, HELD // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            if sum(b.num_rows for b in held) >= rows:
                yield _block(held, width)
                held = []
    if held:
        yield _block(held, width)


def _block(held: list[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "label"))
    return ids, labels, np.concatenate([matrix(b.column("vector"), width) for b in held])


PAIR = "anchor long, score long, negative boolean, id long"


def _found(columns: list[tuple[int, np.ndarray, np.ndarray]], negative: bool) -> pa.RecordBatch:
    sizes = [len(ids) for _, _, ids in columns]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array([a for a, _, _ in columns], np.int64), sizes)),
            pa.array(np.concatenate([s for _, s, _ in columns]).astype(np.int64)),
            pa.array(np.full(sum(sizes), negative)),
            pa.array(np.concatenate([i for _, _, i in columns]).astype(np.int64)),
        ],
        ["anchor", "score", "negative", "id"],
    )


def positive_pairs(rows: DataFrame, anchors: list[str], width: int, count: int) -> DataFrame:
    """For each anchor and block of rows, the first `count` other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in _blocks(batches, width):
            order = np.argsort(labels, kind="stable")
            cut = {int(k): own for own in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(own) for k in labels[own[:1]]}
            for block in shared_batches(anchors, ANCHORS):
                names, kinds, own = block.column("id").to_numpy(), block.column("label").to_numpy(), matrix(block.column("vector"), width)
                found = []
                for kind in np.unique(kinds).tolist():
                    if kind not in cut:
                        continue
                    mine = np.flatnonzero(kinds == kind)
                    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2] * len(mine)
                    for at in range(0, len(cut[kind]), AT_ONCE):
                        part = cut[kind][at : at + AT_ONCE]
                        value = scores(own[mine], vectors[part])
                        for k, anchor in enumerate(names[mine].tolist()):
                            other = ids[part] != anchor
                            s, i = (np.concatenate(p) for p in zip(best[k], (value[k][other], ids[part][other]), strict=True))
                            top = first_of(s, i, count)
                            best[k] = (s[top], i[top])
                    found += [(anchor, *best[k]) for k, anchor in enumerate(names[mine].tolist()) if len(best[k][0])]
                if found:
                    yield _found(found, False)

    return rows.mapInArrow(run, PAIR)


def negative_pairs(rows: DataFrame, anchors: list[str], width: int, count: int) -> DataFrame:
    """For each anchor, block of rows and window of scores (`low` and `high` of the anchor), the first `count` rows of
    another label whose score is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in _blocks(batches, width):
            for block in shared_batches(anchors, ANCHORS):
                names, kinds, own = block.column("id").to_numpy(), block.column("label").to_numpy(), matrix(block.column("vector"), width)
                windows = [list(zip(low, high, strict=True)) for low, high in zip(block.column("low").to_pylist(), block.column("high").to_pylist(), strict=True)]
                best: list[dict] = [{w: (np.empty(0, np.int64),) * 2 for w in each} for each in windows]
                for at in range(0, len(ids), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    value = scores(own, vectors[part])
                    for k, each in enumerate(best):
                        if not each:
                            continue
                        floor, top = min(w[0] for w in each), max(w[1] for w in each)
                        seen = np.flatnonzero((labels[part] != kinds[k]) & (value[k] >= floor) & (value[k] <= top))
                        s_all, i_all = value[k][seen], ids[part][seen]
                        for (low, high), held in each.items():
                            inside = (s_all >= low) & (s_all <= high)
                            s, i = (np.concatenate(p) for p in zip(held, (s_all[inside], i_all[inside]), strict=True))
                            first = first_of(s, i, count)
                            each[low, high] = (s[first], i[first])
                found = []
                for anchor, each in zip(names.tolist(), best, strict=True):
                    if each:
                        s, i = (np.concatenate(p) for p in zip(*each.values(), strict=True))
                        i, at = np.unique(i, return_index=True)
                        found.append((anchor, s[at], i))
                if found:
                    yield _found(found, True)

    return rows.mapInArrow(run, PAIR)


def opened_windows(pairs: DataFrame, count: int, low: int, high: int) -> DataFrame:
    """The result from all pairs that may be in it: one pass over the sorted pairs of each partition. At equal scores
    positives come first, so that a window is open before anything that it may hold."""
    kind = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id")] + [("rank", pa.int32())] + [(n, pa.int64()) for n in ("negative_id", "positive_score", "negative_score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out = []
            for a, score, negative, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != anchor:
                    anchor, windows = a, []
                if not negative:
                    windows.append([other, score, 0])
                    continue
                for window in windows:
                    positive, own, given = window
                    if given < count and low * own <= 100 * score <= high * own:
                        window[2] = given + 1
                        out.append((a, positive, given + 1, other, own, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    dealt = pairs.select("anchor", "score", "negative", "id").repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "negative", "id")
    return dealt.mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor its first `positives`
    other rows of the same label by score, and for each of them the first `negatives` rows of another label whose score is between
    `low` and `high` hundredths of the positive's (0 or more, low < high). `is_anchor` is a condition on the columns of `rows`.

    A score is the inner product of floor(scale * component); higher scores come first, ties by smaller id. Rows with a
    null id, label or vector or a component that is null or not finite take no part; of rows that share an id one
    does (the least label, then vector). Shorter vectors are filled up with 0; scores stop at the ends of 64 bits. No anchors,
    no positives or no negatives give no rows.
    """
    table = written(usable(rows, key, label, vector, scale), "vectors")
    named = rows.filter(is_anchor).select(F.col(key).cast("long").alias("id")).distinct()
    anchors = written(table.join(named, "id", "left_semi"), "anchors")
    width = table.agg(F.max(F.size("vector"))).first()[0] or 0
    if not anchors.inputFiles():
        return opened_windows(table.sparkSession.createDataFrame([], PAIR), negatives, low, high)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    first = positive_pairs(table, anchors.inputFiles(), width, positives).withColumn("place", place).filter(F.col("place") <= positives)
    first = written(first.drop("place"), "positives")
    # 100 * score lies between low and high hundredths of the positive's; in whole numbers, so nothing is lost
    bounds = first.withColumns({"low": F.expr(f"({low} * cast(score as decimal(38)) + 99) div 100"), "high": F.expr(f"{high} * cast(score as decimal(38)) div 100")})
    bounds = bounds.filter("score >= 0").groupBy(F.col("anchor").alias("id")).agg(
        F.collect_list(F.struct(F.expr("cast(low as long)").alias("low"), F.expr("cast(high as long)").alias("high"))).alias("window"))
    open_ = written(anchors.join(bounds, "id").select("id", "label", "vector", F.col("window.low").alias("low"), F.col("window.high").alias("high")), "windows")
    if not open_.inputFiles():
        return opened_windows(first, negatives, low, high)
    found = negative_pairs(table, open_.inputFiles(), width, negatives)
    return opened_windows(first.unionByName(found), negatives, low, high)
