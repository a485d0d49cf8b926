"""SimHash near-duplicates by pigeonhole blocks.

Documents become 64-bit fingerprints of their word shingles; equal fingerprints are one class at once, so a large group
of exact copies costs one row. Fingerprints are cut into ``BLOCKS`` blocks. Two that differ in at most ``DISTANCE`` bits
agree in at least ``BLOCKS - DISTANCE`` of them, so every choice of that many blocks is a key, and close pairs share
one. Within a key, Hamming distances are verified and only a spanning forest of the links leaves the task.

A key with more fingerprints than ``GROUP`` is cut into parts of that size by a second hash, and every two parts meet in
a task of their own: nothing is dropped, memory is bounded, and only links leave. Components are found by stars.

Edge cases: a null or empty text has fingerprint zero, linked like any other; documents with fewer words than a shingle
are one shingle; a null doc_id is in no component but its own and keeps its fingerprint (component_id null); repeated
rows have the same result; other columns are ignored; an empty table gives no rows.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import slices
from ripplework.llm.components import components
from ripplework.session import cut_lineage

SHINGLE, DISTANCE, BLOCKS, GROUP = 4, 4, 6, 1024
SEED = 42
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned; bit k is set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = data.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.array([xxh64_intdigest(text[a:b], SEED) for a, b in zip(begins[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = np.array([fingerprint(x or b"", shingle) for x in batch.column("data").to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))})

    return each


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return texts.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of blocks that a close pair may agree in, as signed 64-bit numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(choice) for choice in combinations(single, blocks - distance)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def linked(values: np.ndarray, distance: int, left: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of at most *distance* bits, as index pairs.

    With *left*, links between the first *left* values and the others matter (those within a side may be used as well).
    """
    waiting = np.arange(len(values))
    edges = []
    while len(waiting):
        front = [int(waiting[0])]
        waiting = waiting[1:]
        while front and len(waiting):
            node = front.pop()
            near = np.bitwise_count(values[waiting] ^ values[node]) <= distance
            if near.any():
                reached = waiting[near].tolist()
                edges += [(node, x) for x in reached]
                front += reached
                waiting = waiting[~near]
    return edges


def _links(distance: int):
    """Within rows sorted by (mask, block, part): links of each group, whose size is bounded."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(fps: np.ndarray, cuts: np.ndarray):
            a, b = [], []
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if end - begin > 1:
                    group = np.unique(fps[begin:end])
                    for x, y in linked(group.view(np.uint64), distance):
                        a.append(int(group[x]))
                        b.append(int(group[y]))
            return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        keys, fps = np.empty((0, 3), np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.stack([np.asarray(batch.column(x)) for x in ("mask", "block", "part")], axis=1)
            keys, fps = np.concatenate((keys, more)), np.concatenate((fps, np.asarray(batch.column("fp"))))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(cuts):  # the last group may go on in the next batch
                yield found(fps, np.concatenate(([0], cuts)))
                keys, fps = keys[cuts[-1]:], fps[cuts[-1]:]
        yield found(fps, np.array([0, len(fps)]))

    return each


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """(a, b): enough links of at most *distance* bits between the distinct signed fingerprints *fps* to connect all."""
    if blocks <= distance:
        raise ValueError("more blocks than bits that may differ are needed")
    masks = F.array(*(F.lit(x).cast("long") for x in _masks(blocks, distance)))
    keyed = fps.select("fp", F.posexplode(masks).alias("mask", "bits")).select(
        F.col("mask").cast("long").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("block"), "fp")
    sizes = cut_lineage(keyed.groupBy("mask", "block").count().where("count > 1"))  # a table, so that a skewed join can be split
    keyed = keyed.join(sizes, ["mask", "block"])
    parts = F.ceil(F.col("count") / group).cast("long")
    mine = F.pmod(F.xxhash64("fp"), parts)
    # Part i of n meets every part j in group (min, max): n rows a fingerprint, in groups of two parts' size.
    dealt = keyed.select("mask", "block", "fp", parts.alias("parts"), mine.alias("mine"))
    dealt = dealt.select("mask", "block", "fp", "parts", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("mask", "block", (F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")).alias("part"), "fp")
    return (dealt.repartition("mask", "block", "part").sortWithinPartitions("mask", "block", "part")
            .mapInArrow(_links(distance), "a long, b long"))


def rooted_classes(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """(fp, least, root): each distinct fingerprint of *prints* (doc_id, fp), its smallest id and its component."""
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = components(links(classes.select("fp"), distance, blocks, group))
    return cut_lineage(classes.join(tied.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
                       .select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of *docs*."""
    prints = cut_lineage(fingerprints(docs, shingle))
    rooted = rooted_classes(prints, distance, blocks, group)
    named = cut_lineage(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", shown.alias("fingerprint"),
                                           F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """*docs* with one row of each component: that of the smallest id, nulls last."""
    last = (1 << 63) - 1
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc_id"), "text")
    prints = cut_lineage(fingerprints(keyed, shingle))
    rooted = rooted_classes(prints, distance, blocks, group)
    # The representative is the smallest (id, fingerprint) of the component; repeated rows can still be several.
    first = rooted.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("first")).select(F.col("first.least").alias("near_rank"), F.col("first.fp").alias("near_fp"))
    rows = prints.groupBy(F.col("doc_id").alias("near_rank"), F.col("fp").alias("near_fp")).agg(F.count("*").alias("near_rows"))
    kept = cut_lineage(first.join(rows, ["near_rank", "near_fp"]))
    mark = F.pandas_udf(_prints_of(shingle), "long")
    found = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("near_rank"),
                        mark(F.col("text").cast("binary")).alias("near_fp")).join(kept, ["near_rank", "near_fp"])
    single, repeated = found.where(F.col("near_rows") == 1), found.where(F.col("near_rows") > 1).dropDuplicates(["near_rank", "near_fp"])
    if kept.where(F.col("near_rows") > 1).isEmpty():
        repeated = repeated.limit(0)
    return single.unionByName(repeated).select("row.*")


def _prints_of(shingle: int):
    def each(data: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x or b"", shingle) for x in data], np.uint64).view(np.int64))

    return each
