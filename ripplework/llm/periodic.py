"""Periodic runs of words by string synchronising sets.

A run is a longest stretch of words with smallest period q that repeats at least ``exponent`` times. For each dyadic scale
t (4, 8, 16, ...) a synchronising set holds positions chosen by what follows them alone: of the t + 1 windows of t words
that begin at i to i + t, the least-hashed one is the first or the last. So equal texts of 2t words are chosen alike, and
any stretch of 3t words holds a chosen position, unless all its windows lie in a highly periodic region (period t / exponent or less),
whose windows are left out of the choice. Two chosen positions that follow one another with equal context (the next 2t
words) propose their distance as a period between t and 2t. A run of such a period has a chosen position in its first t
words and its like a period on, and no equal context comes between, so it is proposed. Periods below the first scale
are omitted there; their regions are found separately by comparing each word with its neighbours at that distance. Every
proposal is extended and checked word by word, so hashes decide nothing.

Documents are scanned in batches of some ten thousand words, put end to end with separators that equal nothing; a scale
only keeps documents long enough for it. A document is one task's, and its memory is proportional to its words.

Edge cases: a null or empty text has no words and no runs; repeated rows give a row each; a null doc_id is an ordinary
document; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import mixed, slices, sliding_min, true_runs

LEAST, EXPONENT, FIRST_SCALE = 6, 4, 4
#: Words scanned together; a longer document is scanned alone.
BATCH_WORDS = 60_000
_ODD, _GOLDEN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = 64

Run = tuple[int, int, int]


class _Numbers(dict):
    """A number for each word, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of 2 * *size* words from those of *size*. What reaches past the end holds the last separator."""
    behind = np.zeros_like(names)
    behind[:-size] = names[size:]
    return mixed(names * _ODD + mixed(behind + _GOLDEN))


def _length_equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many words *a* and *b* begin with in common, in steps that double."""
    at, step, least = 0, _STEP, min(len(a), len(b))
    while at < least:
        differ = np.flatnonzero(a[at:at + step] != b[at:at + step]) if at + step <= least else np.flatnonzero(a[at:least] != b[at:least])
        if len(differ):
            return at + int(differ[0])
        at, step = min(at + step, least), 2 * step
    return least


def _primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of two periods has none that divides it."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            shift = period // factor
            if np.array_equal(words[start:start + period], words[start + shift:start + shift + period]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _short_periods(words: np.ndarray, below: int, exponent: int) -> list[Run]:
    """(start, end, period) of highly periodic regions of each period under *below*."""
    out = []
    for period in range(1, min(below, len(words))):
        for a, b in true_runs(words[:-period] == words[period:]):
            if b - a + period >= exponent * period and _primitive(words, a, period):
                out.append((a, b + period, period))
    return out


def _proposed(names: np.ndarray, contexts: np.ndarray, periodic: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of neighbouring members of the synchronising set that have equal contexts, by period."""
    order = mixed(names ^ _GOLDEN)
    order[periodic] = _NEVER
    least = sliding_min(order, scale + 1)
    chosen = np.flatnonzero((least != _NEVER) & ((least == order[:len(least)]) | (least == order[scale:])))
    by_context = chosen[np.argsort(contexts[chosen], kind="stable")]
    first, second = by_context[:-1], by_context[1:]
    good = (contexts[first] == contexts[second]) & (second - first >= scale) & (second - first < 2 * scale)
    first, period = first[good], (second - first)[good]
    ranked = np.lexsort((first, period))
    return first[ranked], period[ranked]


def _extended(words: np.ndarray, backwards: np.ndarray, first: np.ndarray, period: np.ndarray, exponent: int) -> Iterator[Run]:
    """Longest stretches of the proposed periods around the proposed positions, each once."""
    seen = (0, 0, 0)
    count = len(words)
    for at, p in zip(first.tolist(), period.tolist(), strict=True):
        if seen[2] == p and seen[0] <= at and at + p < seen[1]:
            continue
        right = _length_equal(words[at:], words[at + p:])
        left = _length_equal(backwards[count - at - p:], backwards[count - at:])
        seen = (at - left, at + p + right, p)
        if seen[1] - seen[0] >= exponent * p and _primitive(words, seen[0], p):
            yield seen


def find_runs(documents: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[Run]]:
    """(start, length, period) of the runs of each document, by start and period. *exponent* is 4 or more."""
    if exponent < 4:
        raise ValueError("a synchronising position is certain only in runs of four periods and more")
    numbers = _Numbers()
    sizes = np.array([len(x) + 1 for x in documents], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    words = np.empty(int(sizes.sum()), np.int64)
    for begin, document in zip(begins.tolist(), documents, strict=True):
        words[begin:begin + len(document)] = list(map(numbers.__getitem__, document))
    words[begins + sizes - 1] = len(numbers) + np.arange(len(documents))
    which = np.arange(len(documents))
    found: set[tuple[int, int, int, int]] = set()

    def keep(runs_: list[Run]) -> None:
        owners = np.searchsorted(begins, np.array([x[0] for x in runs_], np.int64), "right") - 1
        for (start, end, period), at in zip(runs_, owners.tolist(), strict=True):
            found.add((int(which[at]), start - int(begins[at]), end - int(begins[at]), period))

    keep(_short_periods(words, FIRST_SCALE, exponent))
    names, scale = mixed((words.astype(np.uint64) + np.uint64(1)) * _GOLDEN), 1
    while scale < FIRST_SCALE:
        names, scale = _doubled(names, scale), 2 * scale
    while True:
        enough = sizes > exponent * scale
        if not enough.any():
            break
        if not enough.all():
            kept = np.repeat(enough, sizes)
            words, names, sizes, which = words[kept], names[kept], sizes[enough], which[enough]
            begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        periodic = np.zeros(len(words), bool)
        place = dict(zip(which.tolist(), begins.tolist(), strict=True))
        for number, start, end, period in found:
            if exponent * period <= scale <= end - start and number in place:
                periodic[place[number] + start:place[number] + end - scale + 1] = True
        contexts = _doubled(names, scale)
        keep(list(_extended(words, words[::-1], *_proposed(names, contexts, periodic, scale), exponent)))
        names, scale = contexts, 2 * scale
    out: list[list[Run]] = [[] for _ in documents]
    for number, start, end, period in sorted(found, key=lambda x: (x[0], x[1], x[3])):
        if end - start >= least:
            out[number].append((start, end - start, period))
    return out


def collapsed(words: list[bytes], runs_: list[Run]) -> list[bytes]:
    """*words* with the first period of each run only."""
    if not runs_:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs_:
        kept[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _scanned(least: int, exponent: int, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None):
    def row_group(ids: list[int | None], documents: list[list[bytes]]) -> pa.RecordBatch:
        found = find_runs(documents, least, exponent)
        return pa.record_batch({
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(map(len, documents), pa.int64()),
            "runs": pa.array([[{"start": s, "length": n, "period": p} for s, n, p in x] for x in found], _RUNS),
            "collapsed": pa.array([b" ".join(collapsed(*x)) for x in zip(documents, found, strict=True)], pa.binary())})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, documents, held = [], [], 0
        for batch in (part for whole in batches for part in slices(whole, 64)):
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                words = (data or b"").split()
                words = words if prepare is None else prepare(doc_id, words)
                if ids and held + len(words) > BATCH_WORDS:
                    yield row_group(ids, documents)
                    ids, documents, held = [], [], 0
                ids.append(doc_id)
                documents.append(words)
                held += len(words)
        if ids:
            yield row_group(ids, documents)

    return scan


def with_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT,
              prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of *docs*; *prepare* may change a document's words first."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return texts.mapInArrow(_scanned(least, exponent, prepare), SCHEMA)
