"""Suffix-array dedup of byte strings with a logarithmic family of indexes.

A level of the family is an array of suffixes on disk, in the order of their first ``KEPT`` bytes over its files, with document
and place. Only suffixes at anchors are kept: the least-hashed 32-byte gram of each 400-byte string, about one in 185
bytes. Equal 400-byte strings have equal anchors at equal places, so none is missed.

Batches arrive one after the other. Each gets a level of its own, which is scanned against itself and every existing level:
a sort-merge join of distinct heads gives those that occur twice. Then, as long as the last two levels hold equally many
batches, they are merged into one of twice the size, so there are never more levels than the logarithm of the number
of batches and one, and every suffix is rewritten as often at most. Merges wait for the next batch, so the last one
pays for none.

Heads met twice are candidates for long matches. The text around each candidate (the union of the 400-byte strings it
anchors) is sent to its head, where rolling hashes of all those strings are counted: a string is a duplicate if another
occurrence has its hash. A head with more than ``GROUP`` occurrences is dealt into parts of about that size, and its
occurrences are put into suffix order first: sorted by the text from the anchor on, then by the text before it backwards. The
longest common prefixes with the neighbours in both orders bound how far a match can reach on either side. A string that
reaches beyond a bound occurs once and is left alone; strings met twice in a part are settled there; the others, few
at the edges of what is shared, go on as rows with their hashes and are counted over all parts by a pre-aggregated
group-by. So no task ever holds an unbounded group, and what many share is not written out for each. Texts that occur
twice as a whole are duplicates from end to end; one copy of each stands in the family for all.

Edge cases: a null text counts as empty; texts under 400 bytes are never touched; repeated rows are copies of each
other; a null doc_id is an ordinary document; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import mixed, runs, slices, sliding_min, true_runs, union_spans
from ripplework.session import cut_lineage

LENGTH, HEAD, KEPT, GROUP, BATCHES = 400, 32, 16, 256, 4
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random-looking number for each byte value.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Bytes hashed at once: bounds the memory a giant document takes.
SLICE = 1 << 22


def _powers(base: int, count: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    out = np.ones(count, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of all substrings of a length, by prefix sums. Tables grow to the longest slice seen."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def prefixes(self, data: bytes) -> np.ndarray:
        count = len(data)
        if len(self.up) < count:
            size = 1 << (count - 1).bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        sums = np.zeros(count + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * self.down[:count], out=sums[1:])
        return sums

    def hashes(self, sums: np.ndarray, length: int) -> np.ndarray:
        count = len(sums) - length
        return (sums[length:] - sums[:-length]) * self.up[:count] if count > 0 else np.empty(0, np.uint64)


def anchored(data: bytes, rolling: Rolling, length: int, head: int) -> Iterator[tuple[int, int, int]]:
    """(place of the head, first string, last string) for each run of neighbouring strings with one anchor."""
    width = length - head + 1
    for begin in range(0, max(len(data) - length + 1, 0), SLICE):
        part = data[begin:begin + SLICE + length - 1]
        grams = mixed(rolling.hashes(rolling.prefixes(part), head))
        least = sliding_min(grams, width)
        first, last = runs(least)
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            at = np.flatnonzero(grams[a:b + width] == least[a])
            place = begin + a + int(at[0])
            if len(at) > 1 and a < b:  # the anchor repeats, and strings within the run may: two entries make it a candidate
                yield place, begin + a, begin + (a + b) // 2
                a = (a + b) // 2 + 1
            yield place, begin + a, begin + b


def _suffixes(length: int, head: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in (part for whole in batches for part in slices(whole)):
            out: list[list] = [[], [], [], [], []]
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("data").to_pylist(), strict=True):
                for place, a, b in anchored(data, rolling, length, head):
                    for column, value in zip(out, (data[place:place + min(head, KEPT)], digest, a, b, place), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), *(pa.array(x, pa.int64()) for x in out[2:])],
                                  names=["head", "digest", "low", "high", "place"])

    return each


def _sorted(suffixes: DataFrame) -> DataFrame:
    """A level: suffixes in text order over its files, each once. Ties go by document, which also spreads a very common head."""
    return cut_lineage(suffixes.repartitionByRange("head", "digest").distinct().sortWithinPartitions("head", "digest"))


class Family:
    """The levels, the largest first, as (batches held, table)."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.shared: list[DataFrame] = []

    def insert(self, suffixes: DataFrame) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, _sorted(a.unionByName(b))))
        new = _sorted(suffixes)
        heads = new.groupBy("head").agg(F.count("*").alias("n"))
        found = heads.where("n > 1").select("head")
        for _, level in self.levels:
            found = found.unionByName(heads.select("head").join(level.select("head").distinct(), "head"))
        self.shared.append(cut_lineage(found.distinct()))
        self.levels.append((1, new))

    def suffixes(self) -> DataFrame:
        out = self.levels[0][1]
        for _, level in self.levels[1:]:
            out = out.unionByName(level)
        return out

    def shared_heads(self) -> DataFrame:
        out = self.shared[0]
        for more in self.shared[1:]:
            out = out.unionByName(more)
        return out.distinct()


def _segments(length: int):
    """The text around each candidate."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            for digest, data, places in zip(batch.column("digest").to_pylist(), batch.column("data").to_pylist(), batch.column("places").to_pylist(), strict=True):
                yield pa.record_batch({
                    "head": pa.array([x["head"] for x in places], pa.binary()), "digest": pa.array([digest] * len(places), pa.binary()),
                    "n": pa.array([x["n"] for x in places], pa.int64()), "low": pa.array([x["low"] for x in places], pa.int64()),
                    "at": pa.array([x["place"] - x["low"] for x in places], pa.int64()),
                    "segment": pa.array([data[x["low"]:x["high"] + length] for x in places], pa.binary())})

    return each


def _common(a: bytes, b: bytes) -> int:
    """How many bytes *a* and *b* begin with in common."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least
    return int(np.argmax(np.frombuffer(a, np.uint8, least) != np.frombuffer(b, np.uint8, least)))


def _reaches(order: str, reach: str):
    """Rows sorted by (head, *order*) with *reach*: the longest common prefix of *order* with a neighbour of the same head.

    The first and last row of a task may have a neighbour in another task; theirs is all they have, an upper bound too.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose neighbour behind is not known yet: (row, head, text, reach so far)
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, texts = batch.column("head").to_pylist(), batch.column(order).to_pylist()
            found = [0] * len(heads)
            if held is None:
                found[0] = len(texts[0])
            else:
                row, head, text, so_far = held
                if head == heads[0]:
                    found[0] = _common(text, texts[0])
                    so_far = max(so_far, found[0])
                yield _with(row, reach, [so_far])
            for i in range(1, len(heads)):
                if heads[i] == heads[i - 1]:
                    both = _common(texts[i - 1], texts[i])
                    found[i - 1], found[i] = max(found[i - 1], both), both
            last = len(heads) - 1
            yield _with(batch.slice(0, last), reach, found[:last])
            held = (batch.slice(last), heads[last], texts[last], found[last])
        if held is not None:
            yield _with(held[0], reach, [len(held[2])])

    return each


def _with(batch: pa.RecordBatch, name: str, values: list[int]) -> pa.RecordBatch:
    columns = [pa.array(values, pa.int64()) if x == name else batch.column(x) for x in batch.schema.names]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


_SEGMENT = "head binary, digest binary, n long, low long, at long, segment binary"


def _bounded(hot: DataFrame) -> DataFrame:
    """Occurrences of hot heads with how far a match can reach before (*left*) and from (*right*) the anchor."""
    def ordered(rows: DataFrame, key: str, text, reach: str) -> DataFrame:
        keys = ["head", key, "digest", "low"]
        return rows.withColumn(key, text).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
            _reaches(key, reach), f"{_SEGMENT}, right long, left long, {key} binary").drop(key)

    zero = F.lit(0).cast("long")
    behind = ordered(hot.withColumn("right", zero).withColumn("left", zero), "text", F.expr("substring(segment, cast(at as int) + 1)"), "right")
    return ordered(behind, "text", F.expr("encode(reverse(decode(substring(segment, 1, cast(at as int)), 'ISO-8859-1')), 'ISO-8859-1')"), "left")


_FOUND = pa.schema([("digest", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("hash", pa.int64())])
_MEMBERS = ("head", "part", "parts", "digest", "low", "at", "left", "right", "segment")


def _string_hashes(rolling: Rolling, segment: bytes, length: int, salt: int) -> np.ndarray:
    return mixed(rolling.hashes(rolling.prefixes(segment), length) ^ np.uint64(salt))


def _matches(length: int):
    """Within rows sorted by (head, part): runs of strings that occur twice, as (digest, low, high).

    Where a head has several parts, a string met once may be in another part: if the bounds of its row allow that, it is
    given with its hash, and so, without a place, is each string met twice. Parts are bounded, and taken some thousand rows
    at a time.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        rolling = Rolling()

        def found(rows: list[tuple]):
            rows = list({(row[0], row[3], row[4]): row for row in rows}.values())
            digests, lows, highs, open_hashes = [], [], [], []
            if rows:
                each_row = [_string_hashes(rolling, row[-1], length, xxh64_intdigest(row[0])) for row in rows]
                own, where, times = np.unique(np.concatenate(each_row), return_inverse=True, return_counts=True)
                again, shared = times[where] > 1, np.zeros(len(own), bool)
                at = 0
                for (_, _, parts, digest, low, anchor, left, right, _), hashes in zip(rows, each_row, strict=True):
                    twice = again[at:at + len(hashes)]
                    spans = [(low + a, low + b - 1, None) for a, b in true_runs(twice)]
                    if parts > 1:
                        shared[where[at:at + len(hashes)][twice]] = True
                        # A string that begins l bytes before the anchor has its like only if l <= left and length - l <= right.
                        once = np.flatnonzero(~twice)
                        once = once[(once >= anchor - left) & (once <= anchor - length + right)]
                        spans += zip((low + once).tolist(), (low + once).tolist(), hashes[once].view(np.int64).tolist(), strict=True)
                    digests += [digest] * len(spans)
                    for a, b, number in spans:
                        lows.append(a)
                        highs.append(b)
                        open_hashes.append(number)
                    at += len(hashes)
                witnesses = own[shared].view(np.int64).tolist()
                for column in (digests, lows, highs):
                    column += [None] * len(witnesses)
                open_hashes += witnesses
            return pa.record_batch([pa.array(x, t) for x, t in zip((digests, lows, highs, open_hashes), _FOUND.types, strict=True)], schema=_FOUND)

        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(x).to_pylist() for x in _MEMBERS), strict=True)
            if len(held) > 4096:
                keep = len(held) - 1
                while keep and held[keep - 1][:2] == held[-1][:2]:
                    keep -= 1
                yield found(held[:keep])
                held = held[keep:]
        yield found(held)

    return each


def duplicates(docs: DataFrame, length: int = LENGTH, head: int = HEAD, batches: int = BATCHES, group: int = GROUP) -> DataFrame:
    """(digest, is_copy, starts, ends) per distinct text: runs of places where strings that occur elsewhere start."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("rank"),
                        F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.col("text").cast("binary").alias("data"))
    texts = texts.where(F.octet_length("data") >= length)
    # How many rows a text has, the smallest id among them, and how many rows have that one.
    ranked = texts.groupBy("digest", "rank").agg(F.count("*").alias("times"))
    copies = cut_lineage(ranked.groupBy("digest").agg(F.sum("times").alias("count"), F.min("rank").alias("rank"), F.min_by("times", "rank").alias("times")))
    suffixes = cut_lineage(texts.select("digest", "data").mapInArrow(_suffixes(length, head), "head binary, digest binary, low long, high long, place long")
                           .withColumn("batch", F.pmod(F.xxhash64("digest"), F.lit(batches))))
    family = Family()
    for number in range(batches):
        family.insert(suffixes.where(F.col("batch") == number).drop("batch"))
    occurring = cut_lineage(family.suffixes().join(cut_lineage(family.shared_heads()), "head", "left_semi"))
    counts = cut_lineage(occurring.groupBy("head").agg(F.count("*").alias("n")))
    places = occurring.join(counts, "head").groupBy("digest").agg(F.collect_list(F.struct("head", "n", "low", "high", "place")).alias("places"))
    # One document speaks for each text, and one row for a document that is repeated.
    one_each = texts.join(cut_lineage(places.join(copies, "digest").select("digest", "rank", "times", "places")), ["digest", "rank"])
    repeated = one_each.where("times > 1").dropDuplicates(["digest"])
    one_each = one_each.where("times = 1").unionByName(repeated).select("digest", "data", "places")
    segments = cut_lineage(one_each.mapInArrow(_segments(length), _SEGMENT))
    hot = _bounded(segments.where(F.col("n") > group))
    few = segments.where(F.col("n") <= group).withColumn("right", F.lit(0).cast("long")).withColumn("left", F.lit(0).cast("long"))
    parts = F.ceil(F.col("n") / group).cast("long")
    members = few.unionByName(hot).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("digest", "low"), F.col("parts"))).select(*_MEMBERS)
    found = cut_lineage(members.repartition("head", "part").sortWithinPartitions("head", "part")
                        .mapInArrow(_matches(length), "digest binary, low long, high long, hash long"))
    opened = found.where(F.col("hash").isNotNull())
    again = cut_lineage(opened.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    common = opened.where(F.col("digest").isNotNull()).join(again, "hash", "left_semi").drop("hash")
    small = found.where(F.col("hash").isNull()).drop("hash")
    runs_ = small.unionByName(common).groupBy("digest").agg(F.collect_list("low").alias("starts"), F.collect_list("high").alias("ends"))
    return copies.select("digest", (F.col("count") > 1).alias("is_copy")).join(runs_, "digest", "left").where(F.col("is_copy") | F.col("starts").isNotNull())


def removed_bytes(count: int, is_copy: bool | None, starts: list[int] | None, ends: list[int] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Half-open runs of bytes that duplicate strings cover."""
    if is_copy and count >= length:
        return [(0, count)]
    if not starts:
        return []
    return union_spans(np.asarray(starts, np.int64), np.asarray(ends, np.int64) + length, count)


def with_duplicates(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id of each row of *docs*, with data (the text), is_copy, starts and ends."""
    found = cut_lineage(duplicates(docs, length, **how))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.col("text").cast("binary").alias("data"))
    return keyed.join(found, "digest", "left").drop("digest")
