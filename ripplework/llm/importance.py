"""Resampling by importance towards a target distribution, over hashed word runs.

Texts are split on bytes: a table of 256 bytes lower-cases and blanks separators, ``bytes.split`` gives the words. A run of
words is hashed by ``zlib.crc32``, where the hash of a run seeds that of the run one word longer. Tasks add up their own
counters of buckets, at most one row per bucket and task; one group-by adds the tasks. What reaches the driver is one gain
per bucket, so its size is the number of buckets, a parameter, whatever the corpus holds.

A document's weight is the sum of the gains of its features; its score adds Gumbel noise that depends on its id alone, so
the highest scores are a draw without replacement by weight. Ranks need no global window: scores are sorted by range
partitioning, which breaks ties by id and then by row, so that even a row that makes up a third of the table is spread; a
row's rank is its place in its partition and the sizes of the partitions before.

Edge cases: a null or empty text has no features and weight 0; a null id draws its noise as the text ``null``; repeated
rows are drawn on their own, each with its own rank; an empty target or corpus is smoothed like any other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import plain_words, slices
from ripplework.session import cut_lineage

LONGEST, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Words a task remembers the bucket of, and words it counts before it adds them up by bucket.
MEMO_WORDS = 200_000
_ROW = (1 << 33) - 1


class Buckets(dict):
    """Bucket of each word. Forgets all when full; nothing depends on what it holds."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = crc32(word) % self.buckets
        return found


def longer_runs(words: list[bytes], longest: int, buckets: int) -> Iterator[int]:
    """Buckets of all runs of two to *longest* words. The hash of a run goes on from that of the run a word shorter."""
    hashes = list(map(crc32, words)) if longest > 1 else []
    for size in range(2, longest + 1):
        hashes = [crc32(b" " + word, seed) for seed, word in zip(hashes, words[size - 1:], strict=False)]
        for value in hashes:
            yield value % buckets


def _counted(longest: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: Counter[int] = Counter()
        words_met: Counter[bytes] = Counter()

        def add_up():
            for word, times in words_met.items():
                by_bucket[crc32(word) % buckets] += times
            words_met.clear()

        for batch in (part for whole in batches for part in slices(whole)):
            for data in batch.column("data").to_pylist():
                words = plain_words(data or b"")
                words_met.update(words)
                if longest > 1:
                    by_bucket.update(longer_runs(words, longest, buckets))
                if len(words_met) > MEMO_WORDS:
                    add_up()
        add_up()
        yield pa.record_batch({"bucket": pa.array(list(by_bucket.keys()), pa.int64()), "n": pa.array(list(by_bucket.values()), pa.int64())})

    return count


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all of the column text."""
    counted = texts.select(F.col("text").cast("binary").alias("data")).mapInArrow(_counted(longest, buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of target to corpus, a whole number per bucket."""
    held, wanted = ({r.bucket: r.n for r in bucket_counts(x, longest, buckets).collect()} for x in (corpus, target))
    all_held, all_wanted = sum(held.values()), sum(wanted.values())
    return [math.floor(1000 * math.log((wanted.get(b, 0) + 1) * (all_held + buckets) / ((held.get(b, 0) + 1) * (all_wanted + buckets))))
            for b in range(buckets)]


def _weighed(by_bucket: list[int], longest: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Buckets(len(by_bucket))
        gain = by_bucket.__getitem__
        for batch in (part for whole in batches for part in slices(whole)):
            words_of, features_of, weights = [], [], []
            for data in batch.column("data").to_pylist():
                words = plain_words(data or b"")
                n = len(words)
                words_of.append(n)
                features_of.append(sum(max(n - size, 0) for size in range(longest)))
                weights.append(sum(map(gain, chain(map(memo.__getitem__, words), longer_runs(words, longest, len(by_bucket))))))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(words_of, pa.int64()),
                                   "n_features": pa.array(features_of, pa.int64()), "weight": pa.array(weights, pa.int64())})

    return weigh


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def weigh(docs: DataFrame, by_bucket: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for each row of *docs*."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    weighed = texts.mapInArrow(_weighed(by_bucket, longest), "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """*weighed* with the rank of each row that is drawn: that share of the rows with enough words, highest scores first."""
    rows = cut_lineage(weighed.withColumn("row", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ordered = cut_lineage(rows.where(enough).repartitionByRange(*order).sortWithinPartitions(*order)
                          .withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit(_ROW))
    # One row per partition: their sizes, added up on the driver, say where each partition's ranks begin.
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    begins, at = [], 0
    for number, size in sizes:
        begins.append((number, at))
        at += size
    wanted = percent * at // 100
    places = ordered.join(F.broadcast(ordered.sparkSession.createDataFrame(begins, "part long, begin long")), part == F.col("part"))
    ranked = places.withColumn("rank", F.col("begin") + within + 1).select(
        *weighed.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return ranked.unionByName(rows.where(~enough).drop("row").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of *docs*, drawn towards the texts of *target*."""
    return draw(weigh(docs, gains(docs, target, longest, buckets), longest, seed), percent, least_words)
