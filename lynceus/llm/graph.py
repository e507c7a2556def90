"""Connected components of an edge table, by per-partition union-find and star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.shared import cut


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find over some pairs: each node but the roots, and its root, the smallest of its group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each Arrow batch of edges is first reduced to a spanning forest where it lies. Then large-star and
    small-star steps alternate until the edges no longer change, which takes about log(n) rounds;
    every round is a shuffle of at most the remaining edges, cut by a table in the shared folder.
    A self-loop or an edge with a null is no edge. No edges give no rows.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a <> b")
    e = cut(e.mapInArrow(_forests, "a long, b long").distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = low.toDF("a", "b").union(hung.filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))
        e = cut(small.distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    return e.toDF("node", "component").union(e.select("b", "b").distinct())
