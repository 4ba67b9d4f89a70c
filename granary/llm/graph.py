"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.store import written


def _starred(links: DataFrame, every: bool) -> DataFrame:
    """One star step: the neighbours of a node, larger ones only or (`every` false) smaller ones and itself,
    link to its least neighbour instead. A hub is one row after the partial minimum; its links join by node,
    and adaptive execution splits that join where one node has many."""
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if every else links
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    turned = sides.join(least, "a")
    if every:
        out = turned.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = turned.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (a, b long): root is the least node that it can reach.

    Large and small stars alternate until every node links straight to its root; each round writes its links to
    the shared folder. Null ends, loops and repeated links are ignored; no links give no rows.
    """
    now = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct(),
        "links",
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before or not state[0]:
            break
        before = state
        now = written(_starred(_starred(now, every=True), every=False), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
