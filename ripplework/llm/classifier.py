"""Quality by a factorisation machine.

Inputs of a document are its hashed words, structure statistics (each in steps), and metadata read off the text itself
(size, share of bytes beyond ASCII, lines). Every input has a weight and a vector of ``RANK`` numbers; the inner product
of two inputs' vectors is the weight of their pair. All pairs are scored in linear time, by half the difference of the
square of the sum and the sum of the squares.

The model is fitted by AdaGrad on at most ``SAMPLE_ROWS`` labelled rows drawn by hash, in an order fixed by a seed; their
inputs, some hundred numbers each, are all that reaches the driver. The model's size is fixed, texts are scored where
they are read, whole.

Edge cases: a null or empty text has only its statistics and is scored by them; without usable labels every score is
the starting model's, near a half; labels that are null or of null ids teach nothing; repeated rows are scored alike;
other columns are ignored; an empty table gives no rows. Of several labels for a document the highest counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import held_out, slices
from ripplework.llm.toxicity import labelled

SAMPLE_ROWS, BUCKETS, RANK, EPOCHS, BATCH, RATE, DECAY, SEED = 10_000, 1 << 14, 8, 6, 128, 0.1, 1e-5, 17
THRESHOLD = 0.5
STEPS = 12
MEMO_WORDS = 120_000
_SYMBOLS, _DIGITS, _STOPS, _MARKS = b"#*$%&|<>{}[]\\^~=+@", b"0123456789", b".!?", b",;:'\"()-"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def statistics(data: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Numbers from 0 to 1 that describe the structure of a text."""
    size, count = max(len(data), 1), max(len(words), 1)
    lines = data.split(b"\n")
    share = lambda letters: (len(data) - len(data.translate(None, letters))) / size
    long = sum(len(w) > 20 for w in words)
    lengths = sum(map(len, words)) / count
    return [min(1.0, math.log1p(len(words)) / 12), min(1.0, lengths / 20), math.sqrt(share(_SYMBOLS)), math.sqrt(share(_DIGITS)), math.sqrt(share(_STOPS)),
            math.sqrt(share(_MARKS)), math.sqrt(share(_UPPER)), distinct / count, len(set(lines)) / len(lines), min(1.0, math.log1p(len(data) / len(lines)) / 12),
            min(1.0, math.log1p(len(lines)) / 10), 1 - len(data.decode("utf-8", "replace")) / size,
            math.sqrt(long / count), math.sqrt(data.count(b"http") / count), math.sqrt(data.count(b"  ") / size)]


N_STATISTICS = 15
#: Input numbers: words' buckets, then the steps of each statistic, then the statistics themselves.
N_INPUTS = BUCKETS + N_STATISTICS * STEPS + N_STATISTICS


class Inputs:
    """A text's inputs: sorted numbers and values."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = data.translate(_LOWER).split()
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        distinct = set(words)
        buckets = []
        for word in distinct:
            bucket = memo.get(word)
            if bucket is None:
                bucket = memo[word] = zlib.crc32(word) % BUCKETS
            buckets.append(bucket)
        found, times = np.unique(np.array(buckets, np.int64), return_counts=True)
        values = np.sqrt(times) / math.sqrt(max(len(distinct), 1))
        numbers = np.array(statistics(data, words, len(distinct)))
        steps = BUCKETS + np.arange(N_STATISTICS) * STEPS + np.minimum((numbers * STEPS).astype(np.int64), STEPS - 1)
        plain = BUCKETS + N_STATISTICS * STEPS + np.arange(N_STATISTICS)
        return np.concatenate((found, steps, plain)), np.concatenate((values, np.full(N_STATISTICS, 0.5), numbers))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, inputs: np.ndarray, values: np.ndarray) -> float:
        parts = self.vectors[inputs] * values[:, None]
        total = self.bias + self.weights[inputs] @ values + 0.5 * float((parts.sum(axis=0) ** 2).sum() - (parts ** 2).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, seed: int = SEED) -> Machine:
    """AdaGrad over small batches, in an order that the seed fixes. Both classes weigh alike up to a factor of three."""
    rng = np.random.default_rng(seed)
    weights, vectors, bias = np.zeros(N_INPUTS), rng.normal(0, 0.05, (N_INPUTS, rank)), 0.0
    seen_w, seen_v, seen_b = np.full(N_INPUTS, 1e-3), np.full((N_INPUTS, rank), 1e-3), 1e-3
    ones = labels.mean() if len(labels) else 0.5
    weigh = np.where(labels > 0, 1.0, min(3.0, max(1.0, ones / max(1 - ones, 1e-9))))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            picked = order[at:at + BATCH]
            inputs = np.concatenate([rows[i][0] for i in picked])
            values = np.concatenate([rows[i][1] for i in picked])
            sizes = np.array([len(rows[i][0]) for i in picked])
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            parts = vectors[inputs] * values[:, None]
            sums = np.add.reduceat(parts, begins, axis=0)
            totals = bias + np.add.reduceat(weights[inputs] * values, begins) + 0.5 * ((sums ** 2).sum(axis=1) - np.add.reduceat((parts ** 2).sum(axis=1), begins))
            error = weigh[picked] * (1 / (1 + np.exp(-np.clip(totals, -30, 30))) - labels[picked]) / len(picked)
            each = np.repeat(error, sizes)
            own, where = np.unique(inputs, return_inverse=True)
            slope_w = np.bincount(where, each * values) + DECAY * weights[own]
            spread = (each * values)[:, None] * (np.repeat(sums, sizes, axis=0) - parts)
            slope_v = np.stack([np.bincount(where, spread[:, f]) for f in range(rank)], axis=1) + DECAY * vectors[own]
            seen_w[own] += slope_w ** 2
            seen_v[own] += slope_v ** 2
            seen_b += error.sum() ** 2
            weights[own] -= RATE * slope_w / np.sqrt(seen_w[own])
            vectors[own] -= RATE * slope_v / np.sqrt(seen_v[own])
            bias -= RATE * error.sum() / math.sqrt(seen_b)
    return Machine(bias, weights, vectors)


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = Inputs()
    for batch in (part for whole in batches for part in slices(whole)):
        found = [read(data or b"") for data in batch.column("data").to_pylist()]
        yield pa.record_batch({"inputs": pa.array([x.astype("<i4").tobytes() for x, _ in found], pa.binary()),
                               "values": pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary()), "label": batch.column("label")})


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    sample = labelled(docs, labels, "quality", rows).select(F.col("text").cast("binary").alias("data"), "label")
    found = sample.mapInArrow(_inputs, "inputs binary, values binary, label int").toArrow()
    # In one order whatever the tasks' order was; the sample is bounded, so it is put in order here.
    rows_read = sorted(zip(*(found.column(x).to_pylist() for x in ("label", "inputs", "values")), strict=True))
    pairs = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(b, "<f4").astype(float)) for _, a, b in rows_read]
    return fit(pairs, np.array([label > 0 for label, _, _ in rows_read], float))


def _scores(machine: Machine):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Inputs()
        for batch in (part for whole in batches for part in slices(whole)):
            scores = [machine.score(*read(data or b"")) for data in batch.column("data").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())})

    return each


def score_quality(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of *docs* (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return texts.mapInArrow(_scores(machine), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
