"""Supervised subword embeddings: hashed vectors of words and character n-grams, averaged, with a softmax."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.store import written

BUCKETS = 1 << 17
DIMENSIONS = 16
GRAMS = (3, 4, 5)
#: Labelled rows that a model is fitted on at most, the first by a hash of their key: the bound of the one task that fits.
SAMPLE = 6000
EPOCHS = 4
RATE = 0.5

# Odd multipliers of a multiplicative hash.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _buckets(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * _B
    return (values >> np.uint64(40)).astype(np.int64) % BUCKETS


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each word (the word and its character n-grams, ends marked), and how many each has."""
    marked = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place
    keyed = (points + np.uint64(1)) * _A
    whole = np.add.reduceat((keyed ^ (keyed >> np.uint64(31))) * (2 * place.astype(np.uint64) + np.uint64(1)), starts)
    found, owner = [_buckets(whole)], [np.arange(len(words))]
    of_point = np.repeat(np.arange(len(words)), sizes)
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = (value ^ points[at + k]) * _A
            value ^= value >> np.uint64(32)
        found.append(_buckets(value))
        owner.append(of_point[at])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(words))


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts after one another, and where the words of each begin and the last ends. Null texts have none;
    white space at the ends of a text makes no word."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    offsets = split.offsets.to_numpy().astype(np.int64)
    words = split.flatten()
    real = pc.not_equal(words, "")
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), before[offsets - offsets[0]]


def fit(texts: list[str], labels: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the buckets, softmax weights and biases of two classes, by stochastic gradient descent, a text a
    step, with a rate that falls to zero. Without rows of both labels all weights are zero."""
    draw = np.random.default_rng(seed)
    vectors = ((draw.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    weights, biases = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    if len(set(labels.tolist())) < 2:
        return vectors, weights, biases
    rows = []
    spelled, first = cut(pa.array(texts, pa.string()))
    for begin, end in itertools.pairwise(first.tolist()):
        words = spelled.slice(begin, end - begin).to_pylist()
        ids, _ = features(words) if words else (np.empty(0, np.int64), None)
        each, times = np.unique(ids, return_counts=True)
        rows.append((each, (times / max(1, len(ids))).astype(np.float32)))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            ids, share = rows[i]
            mean = share @ vectors[ids]
            scores = weights @ mean + biases
            chances = np.exp(scores - scores.max())
            chances /= chances.sum()
            chances[labels[i]] -= 1
            now = rate * (1 - step / steps)
            step += 1
            back = weights.T @ chances
            weights -= now * np.outer(chances, mean)
            biases -= now * chances
            # the gradient of an averaged vector is small by its share; so is its step, times the text's features
            vectors[ids] -= now * np.minimum(1, share * len(ids))[:, None] * back
    return vectors, weights, biases


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> bytes:
    """One float per bucket, then the bias: what a bucket's vector adds to the odds of label 1. Fitted in one
    task on at most `sample` of the labelled rows; rows without text, key or label (0 or 1) are left out."""
    chosen = written(
        labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key", "_label").limit(sample),
        "sample",
    )
    rows = docs.select(F.col(key).alias("_own"), F.col(text).alias("_text")).filter("_text is not null").join(
        chosen, F.col("_own") == F.col("_key")
    ).select("_key", "_label", "_text")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_key", "_text", "_label"])
        vectors, weights, biases = fit(part["_text"].tolist(), part["_label"].to_numpy())
        odds = vectors @ (weights[1] - weights[0])
        return pd.DataFrame({"model": [np.append(odds, biases[1] - biases[0]).astype("<f4").tobytes()]})

    fitted = rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "model binary").first()
    return fitted["model"] if fitted else np.zeros(BUCKETS + 1, "<f4").tobytes()


def with_score(docs: DataFrame, model: bytes, *, text: str = "text", score: str = "score") -> DataFrame:
    """`docs` without the text, with a score from 0 to 1 of every whole text: as the softmax is of an average, each word adds its own
    share, so a word is looked at once a batch. Null and empty texts have the score of the bias."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # four bytes a bucket
    columns = [c for c in docs.columns if c not in (text, score)]
    schema = docs.select(*columns).schema.add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = np.frombuffer(sent.value, "<f4").astype(np.float64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                spelled, first = cut(batch.column(text))
                coded = spelled.dictionary_encode()
                codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                total, count = np.zeros(len(words)), np.zeros(len(words))
                if words:
                    ids, count = features(words)
                    total = np.add.reduceat(odds[ids], np.cumsum(count) - count)
                sums, sizes = (np.concatenate([[0], np.cumsum(v[codes])]) for v in (total, count))
                size = sizes[first[1:]] - sizes[first[:-1]]
                mean = np.divide(sums[first[1:]] - sums[first[:-1]], size, out=np.zeros(len(size)), where=size > 0)
                result = 1 / (1 + np.exp(-np.clip(mean + odds[-1], -50, 50)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(result, pa.float64())], [*columns, score])

    return docs.select(*columns, text).mapInArrow(run, schema)
