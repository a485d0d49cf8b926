"""Connected components of an edge table, by alternating stars.

Every round is two group-bys of edges by node, each with a map-side minimum, and one equi-join back; nothing is
collected, and rounds grow with the logarithm of the longest chain. Edges are contracted within each partition first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.session import cut_lineage

#: Edges a task contracts at once.
CHUNK_EDGES = 200_000


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its component) of the graph of *pairs*, without the smallest themselves."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while x != top:
            root[x], x = top, root.get(x, top)
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            root.setdefault(min(a, b), min(a, b))
    return [(x, top) for x in root if (top := find(x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        if len(held) >= CHUNK_EDGES:
            yield _edges(forest(held))
            held = []
    yield _edges(forest(held))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})


def _larger_to_least(edges: DataFrame) -> DataFrame:
    """Large star: each node's larger neighbours are tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")))  # splittable join
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours are tied to the least of those."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not the least of its component, with the least. *edges* holds longs a and b, a <> b."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut_lineage(down.mapInArrow(_contract, "a long, b long").distinct())
    while True:
        after = cut_lineage(_smaller_to_least(_larger_to_least(now)))
        # Done when every node points at one that points nowhere: the edges are stars.
        tops = after.select(F.col("b").alias("a")).distinct()
        if after.join(tops, "a", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            return after
        now = after
