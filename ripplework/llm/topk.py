"""Exact top-k by inner product over a pivot-distance index.

The largest inner product becomes the nearest neighbour by one more coordinate: x gets sqrt(M - |x|^2), M the largest
squared norm, and a query gets 0. Pivots come from a bounded sample. Every vector is keyed by its nearest pivot and its
distance to it; each pivot's distances are cut into ``RINGS`` annuli, and an annulus is stored in blocks of about
``BLOCK`` rows, however many it holds. The directory of annuli has at most ``PIVOTS * RINGS`` rows whatever the data.

A search first visits each query's most promising annuli, sorted by their best possible score, until ``FIRST`` rows are
seen; the k-th best of those bounds from below what can still matter. By the triangle inequality a vector at distance
r from a pivot is at least |d - r| from a query at distance d, so annuli whose best possible score is under that bound
are never visited. The others are, in blocks of queries of one nearest pivot, and the best k of all visits win.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; repeated rows take part
as rows of their own, as queries as well (each has results of its own, and its like among its candidates); vectors of
another dimension than a query's are not compared; ties go to the smaller id; other columns are ignored; an empty table gives no rows. Scores are exact
up to 2 ** 53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework.session import cut_lineage

PIVOTS, RINGS, SAMPLE, BLOCK, QUERY_BLOCK, FIRST, SCALE = 12, 8, 2048, 4096, 256, 2048, 256


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): whole-number components of the vectors that take part."""
    x = F.transform(F.col("embedding"), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    bad = F.exists(F.col("embedding"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True))
    return vectors.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest points first, then a few rounds of means: rows of *sample*'s space."""
    picked = [0]
    distance = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(sample)):
        picked.append(int(distance.argmax()))
        distance = np.minimum(distance, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    pivots = sample[picked].copy()
    for _ in range(5):
        near = _distances(sample, pivots).argmin(axis=1)
        for p in range(len(pivots)):
            if (near == p).any():
                pivots[p] = sample[near == p].mean(axis=0)
    return pivots


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (rows ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def _lifted(rows: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate((rows, np.sqrt(np.maximum(most - (rows ** 2).sum(axis=1), 0))[:, None]), axis=1)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def _keyed(pivots: np.ndarray, most: float, size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("x"), size)
            distances = _distances(_lifted(rows, most), pivots)
            near = distances.argmin(axis=1)
            yield pa.record_batch({"pivot": pa.array(near.astype(np.int64)), "distance": pa.array(distances[np.arange(len(rows)), near]),
                                   "vec_id": batch.column("vec_id"), "row": batch.column("row"), "x": batch.column("x")})

    return each


def bounds(to_pivots: np.ndarray, norms: np.ndarray, directory: list[tuple[int, int, float, float, int]], most: float) -> np.ndarray:
    """The best inner product each query (row) can have within each annulus (column)."""
    pivot = np.array([x[0] for x in directory])
    low, high = np.array([x[2] for x in directory]), np.array([x[3] for x in directory])
    distance = to_pivots[:, pivot]
    nearest = np.maximum(0, np.maximum(low - distance, distance - high)) - 1e-6 * (1 + distance)  # for rounding
    return (norms[:, None] + most - np.maximum(nearest, 0) ** 2) / 2


def _plan(pivots: np.ndarray, most: float, size: int, directory: list[tuple[int, int, float, float, int]], first: int, bounded: bool):
    """(query_id, query_row, x, near, annulus): the annuli a query is to visit, at first or (*bounded*) given its k-th best score so far."""
    numbers = np.array([x[1] for x in directory])
    rows_in = np.array([x[4] for x in directory])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("x"), size)
            to_pivots = _distances(np.concatenate((rows, np.zeros((len(rows), 1))), axis=1), pivots)
            best = bounds(to_pivots, (rows ** 2).sum(axis=1), directory, most)
            order = np.argsort(-best, axis=1, kind="stable")
            before = np.cumsum(rows_in[order], axis=1) - rows_in[order]
            early = np.zeros(best.shape, bool)
            np.put_along_axis(early, order, before < first, axis=1)
            if bounded:
                known = np.array([-np.inf if x is None else x for x in batch.column("bound").to_pylist()])
                visit = ~early & (best >= known[:, None])
            else:
                visit = early
            which, annulus = np.nonzero(visit)
            yield pa.record_batch({
                "query_id": batch.column("vec_id").take(pa.array(which)), "query_row": batch.column("row").take(pa.array(which)), "x": batch.column("x").take(pa.array(which)),
                "near": pa.array(to_pivots.argmin(axis=1)[which].astype(np.int64)), "annulus": pa.array(numbers[annulus].astype(np.int64))})

    return each


def _visit(size: int, k: int):
    """Rows of (a block's vectors, queries): each query's k best within the block."""

    def unpacked(column: pa.Array, at: int, *names: str) -> tuple[np.ndarray, ...]:
        members = column[at].values
        return *(np.asarray(members.field(name)) for name in names), np.asarray(members.field("x").flatten(), np.float64).reshape(-1, size)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, numbers, rows = unpacked(batch.column("members"), at, "vec_id", "row")
                asked, asking, queries = unpacked(batch.column("queries"), at, "query_id", "query_row")
                order = np.lexsort((numbers, ids))
                ids, numbers, scores = ids[order], numbers[order], queries @ rows[order].T
                scores[asking[:, None] == numbers[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                values = np.take_along_axis(scores, best, axis=1)
                real = np.isfinite(values)
                yield pa.record_batch({"query_id": pa.array(np.repeat(asked, best.shape[1])[real.ravel()]),
                                       "query_row": pa.array(np.repeat(asking, best.shape[1])[real.ravel()]),
                                       "vec_id": pa.array(ids[best][real]), "row": pa.array(numbers[best][real]), "score": pa.array(values[real].astype(np.int64))})

    return each


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE, block: int = BLOCK,
           query_block: int = QUERY_BLOCK, first: int = FIRST, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows of *vectors* (vec_id, embedding) for each query row."""
    # Written with its numbers: a row is told from others with its id and components by them.
    table = cut_lineage(quantized(vectors, scale).withColumn("size", F.size("x")).withColumn("row", F.monotonically_increasing_id()))
    out = table.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    # Vectors of different dimension are separate searches; a table has one dimension, or a few.
    for (size,) in table.select("size").distinct().collect():
        part = table.where(F.col("size") == size).select("vec_id", "row", "x")
        out = out.unionByName(_search(part, is_query, k, pivots, rings, sample, block, query_block, first, size))
    return out


def _search(table: DataFrame, is_query: Column, k: int, pivots: int, rings: int, sample: int, block: int, query_block: int, first: int, size: int) -> DataFrame:
    most = float(table.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0])
    drawn = np.array([row.x for row in table.orderBy(F.xxhash64("vec_id", "row"), "row").limit(sample).collect()])
    lifted = _lifted(drawn, most)
    centres = choose_pivots(lifted, pivots)

    keyed = table.mapInArrow(_keyed(centres, most, size), "pivot long, distance double, vec_id long, row long, x array<double>")
    # Each pivot's distances are cut at the sample's quantiles; the last annulus is open to the outside.
    near = _distances(lifted, centres)
    owner = near.argmin(axis=1)
    own = near[np.arange(len(near)), owner]
    ring = F.lit(0)
    for pivot in range(len(centres)):
        if (owner == pivot).any():
            steps = [float(x) for x in np.unique(np.quantile(own[owner == pivot], np.arange(1, rings) / rings))]
            ring = F.when(F.col("pivot") == pivot, F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: x <= F.col("distance")))).otherwise(ring)
    keyed = cut_lineage(keyed.withColumn("annulus", F.col("pivot") * rings + ring))
    counts = cut_lineage(keyed.groupBy("annulus").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")))
    directory = [(row.annulus // rings, row.annulus, row.low, row.high, row.n) for row in counts.collect()]  # pivots * rings rows at most

    parts = F.ceil(F.col("n") / block).cast("long")
    stored = keyed.join(counts, "annulus").withColumn("part", F.pmod(F.xxhash64("row"), parts))
    blocks = cut_lineage(stored.groupBy("annulus", "part").agg(F.collect_list(F.struct("vec_id", "row", "x")).alias("members")))

    queries = cut_lineage(table.where(is_query))
    query_parts = max(1, -(-queries.count() // query_block))

    def visited(planned: DataFrame) -> DataFrame:
        grouped = planned.withColumn("part_of", F.pmod(F.xxhash64("query_row"), F.lit(query_parts))).groupBy("annulus", "part_of").agg(
            F.collect_list(F.struct("query_id", "query_row", "x")).alias("queries"))
        return blocks.join(cut_lineage(grouped), "annulus").select("members", "queries").mapInArrow(_visit(size, k), "query_id long, query_row long, vec_id long, row long, score long")

    planned = "query_id long, query_row long, x array<double>, near long, annulus long"
    early = cut_lineage(_best(visited(queries.mapInArrow(_plan(centres, most, size, directory, first, False), planned)), k))
    bound = early.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("bound"))
    late = visited(queries.join(bound, "row", "left").mapInArrow(_plan(centres, most, size, directory, first, True), planned))
    return _best(early.drop("rank").unionByName(late), k).select("query_id", "rank", "vec_id", "score")
