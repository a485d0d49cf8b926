"""What the operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks. ``bytes.split()`` cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\r\x0b\x0c"
_WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")

#: What each byte becomes before words of letters and digits are split: A-Z lower case, ASCII separators blank, others themselves.
PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if x >= 0x80 or chr(x) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for x in range(256))

#: Bytes of rows that a task hands to Python at once; Spark's own limit is sixteen times as much.
BATCH_BYTES = 4 << 20

_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let tasks of this session hand whole texts to Python a few megabytes at a time.

    A batch is held three times and more, as vectors that grow by doubling, as a message and as objects, and neither side gives all
    of it back to the system.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, so that only those are Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def word_spans(data: bytes) -> list[tuple[int, int]]:
    """Where each word begins and ends, in bytes."""
    return [match.span() for match in _WORD_BYTES.finditer(data)]


def plain_words(data: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes above 0x7F, with A-Z in lower case."""
    return data.translate(PLAIN).split()


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers, so that their order is that of a random hash."""
    values = values ^ (values >> _SHIFT)
    values = values * _MIX_1
    values = values ^ (values >> _SHIFT)
    values = values * _MIX_2
    return values ^ (values >> _SHIFT)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each *width* consecutive values, by doubling."""
    reach, lowest = 1, values
    while 2 * reach <= width:
        lowest = np.minimum(lowest[:-reach], lowest[reach:])
        reach *= 2
    if reach < width:
        rest = width - reach
        lowest = np.minimum(lowest[:-rest], lowest[rest:])
    return lowest


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal neighbours."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cuts = np.flatnonzero(values[1:] != values[:-1])
    return np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(values) - 1]))


def true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def union_spans(starts: np.ndarray, stops: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered runs of half-open intervals over ``range(length)``."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    return true_runs(np.cumsum(change)[:length] > 0)
