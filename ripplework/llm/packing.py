"""Cost-balanced packing of documents into training sequences.

A document becomes token ids and one closing id. Full pieces of the sequence length stand alone. The rests are packed
in batches of bounded size within the task that encoded them, so no id crosses the network: in descending length each
goes to the sequence of lowest estimated attention cost, ``linear * n + quadratic * n * n`` summed over its pieces, that
still has room. A batch opens just as many sequences as its tokens need; a rest that fits nowhere whole is cut over the
gaps. What lies in part-filled sequences waits for the next batch, when as many tokens again have come in; as all gaps of a
batch are smaller than one sequence, fewer sequences wait than a sequence has tokens. Only the last batch of a task can leave
a sequence part empty; it is cut at powers of two, which need no padding.

Sequence ids are the task's number and a count within it. A lost task packs the same rows again to the same ids.

Edge cases: a null or empty text is one piece, the closing id; repeated rows are packed as rows of their own; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import slices
from ripplework.llm.tokens import encoder_of

SEQUENCE_TOKENS = 2048
CLOSING_ID = 1
#: Tokens of new rests a task gathers before it packs them (four bytes each).
BATCH_TOKENS = 2_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Sequence ids of a task start at its number times this.
IDS_PER_TASK = 1 << 36


def assign(lengths: list[int], sequence: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (which rest, tokens of it before, tokens). Every token is in exactly one place."""
    count = -(-sum(lengths) // sequence)
    room, cost = np.full(count, sequence, np.int64), np.zeros(count)
    filled: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    homeless = []
    for rest in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[rest]
        at = int(np.argmin(np.where(room >= length, cost, np.inf)))
        if room[at] < length:
            homeless.append(rest)
            continue
        filled[at].append((rest, 0, length))
        room[at] -= length
        cost[at] += linear * length + quadratic * length * length
    gaps = iter(np.argsort(-room, kind="stable").tolist())
    at = next(gaps, None)
    for rest in homeless:
        done = 0
        while done < lengths[rest]:
            while room[at] == 0:
                at = next(gaps)
            take = int(min(room[at], lengths[rest] - done))
            filled[at].append((rest, done, take))
            room[at] -= take
            done += take
    return filled


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One part-filled sequence as sequences whose lengths are powers of two."""
    left, out = sum(x[2] for x in pieces), []
    queue = list(reversed(pieces))
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out.append([])
        while want:
            which, begin, length = queue.pop()
            take = min(length, want)
            out[-1].append((which, begin, take))
            want -= take
            if take < length:
                queue.append((which, begin + take, length - take))
    return out


def _pack(path: str, sequence: int, batch_tokens: int, closing: int):
    end = int(closing).to_bytes(4, "little")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        number = TaskContext.get().partitionId() * IDS_PER_TASK
        rests: list[tuple[int | None, int, int, bytes]] = []
        fresh, rows = 0, []

        def put(doc_id, start, ids, total, offset):
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, number, offset))

        def settle(last: bool):
            nonlocal number, fresh, rests
            filled = assign([len(ids) // 4 for *_, ids in rests], sequence)
            # Part-filled sequences: all their pieces wait for the next batch, or are cut at powers of two at the end.
            waiting = []
            for pieces in filled:
                used = sum(x[2] for x in pieces)
                if used < sequence:
                    waiting += pieces
                else:
                    emit(pieces)
            if last:
                spread, room = [[]], sequence
                for which, begin, length in waiting:
                    while length:
                        take = min(length, room)
                        spread[-1].append((which, begin, take))
                        begin, length, room = begin + take, length - take, room - take
                        if not room:
                            spread, room = [*spread, []], sequence
                for pieces in spread:
                    for part in powers_of_two(pieces):
                        emit(part)
                waiting = []
            rests = [(rests[w][0], rests[w][1] + b, rests[w][2], rests[w][3][4 * b:4 * (b + n)]) for w, b, n in waiting]
            fresh = 0

        def emit(pieces):
            nonlocal number
            offset = 0
            for which, begin, length in pieces:
                doc_id, start, total, ids = rests[which]
                put(doc_id, start + begin, ids[4 * begin:4 * (begin + length)], total, offset)
                offset += length
            if pieces:
                number += 1

        def flushed():
            nonlocal rows
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            rows = []
            return pa.record_batch({name: pa.array(column, pa.int64()) for name, column in zip(names, columns, strict=True)})

        for batch in (part for whole_batch in batches for part in slices(whole_batch)):
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                ids = encoder.ids(data or b"", end)
                total = len(ids) // 4
                whole = total - total % sequence
                for start in range(0, whole, sequence):
                    put(doc_id, start, ids[4 * start:4 * (start + sequence)], total, 0)
                    number += 1
                if whole < total:
                    rests.append((doc_id, whole, total, ids[4 * whole:]))
                    fresh += total - whole
                if fresh >= batch_tokens:
                    settle(last=False)
            yield flushed()
        settle(last=True)
        yield flushed()

    return pack


def pack_documents(docs: DataFrame, path: str, sequence: int = SEQUENCE_TOKENS, batch_tokens: int = BATCH_TOKENS, closing: int = CLOSING_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long)."""
    if sequence & (sequence - 1):
        raise ValueError("the sequence length has to be a power of two")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return texts.mapInArrow(_pack(path, sequence, batch_tokens, closing),
                            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
