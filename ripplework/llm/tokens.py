"""Token counts by overlap resynchronisation.

A document longer than a chunk is cut into chunks that overlap. Each chunk is encoded on its own, with offsets, by
whichever task gets it; neighbours are spliced where both encodings agree on a boundary that provably cannot move.
A boundary is proven where ASCII white space precedes a token: the tokenizer drops white space, its normaliser never
joins characters across it, and no token or special string contains it. Chunk edges may cut a word, so the first and last word of a
piece never count unless the document itself begins or ends there. Where an overlap holds no common boundary (a long
run without blanks), that document is encoded again with overlaps eight times as wide, at last as one piece.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import array
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplework.llm.common import slices, word_spans
from ripplework.session import cut_lineage

CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 1 << 9
#: Words in a generation of a worker's memory, some 60 MB; it has two.
MEMO_WORDS = 250_000


class WordEncoder:
    """Ids of a tokenizer that drops white space and case, remembered by word.

    The library does all encoding, so special strings and Unicode forms are its business. Words of letters, and such
    words before one mark, are sent to it many in a line, and its answer is cut where tokens end a word; if it does not
    have as many ends as words, and for all other words, each word is sent by itself. The memory has two generations
    and forgets the older when the younger is full; nothing depends on what it holds. A worker keeps it from task to task.
    """

    MARKS = b".,;:!?"

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        steps = (described.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if not any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") for x in steps):
            raise ValueError("the tokenizer has to drop white space, so that words are encoded independently")
        if any(len(x["content"].split()) != 1 or x["lstrip"] or x["rstrip"] or x["single_word"] for x in described["added_tokens"]):
            raise ValueError("special tokens with white space, or that take some, tie words together")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lowers = any(x.get("type") == "Lowercase" for x in (described.get("normalizer") or {}).get("normalizers", []))
        # Special strings are matched as written, so texts that may hold one keep their case.
        self.guards = sorted({x["content"][:2].encode() for x in described["added_tokens"]})
        suffix = described["model"].get("end_of_word_suffix") or ""
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
        self.limit = limit
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.marks = {mark: self._one_by_one([bytes([mark])])[0] for mark in self.MARKS}

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([word.decode("utf-8", "replace") for word in words], add_special_tokens=False)
        return [array.array("I", encoding.ids).tobytes() for encoding in found]

    def _in_line(self, words: list[bytes]) -> list[bytes]:
        ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._one_by_one(words)
        data, stops = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _learn(self, missing: set[bytes]) -> None:
        memo, older = self.memo, self.older
        bases: list[bytes] = []
        parts: list[tuple[bytes, bytes]] = []
        others: list[bytes] = []
        for word in missing:
            if word in older:
                memo[word] = older[word]
                continue
            if word.isalpha():  # ASCII letters only
                bases.append(word)
                parts.append((word, b""))
                continue
            mark = self.marks.get(word[-1], b"")
            base = word[:-1] if mark else word
            text = base.decode("utf-8", "replace")
            # Normal form and lower case may put a mark behind a letter, which would join the one behind it.
            if base.isalpha() or (text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()):
                known = memo.get(base) or older.get(base)
                if known is not None:
                    memo[word] = known + mark
                    continue
                bases.append(base)
                parts.append((word, mark))
            else:
                others.append(word)
        for at in range(0, len(bases), 2048):
            for (word, mark), ids in zip(parts[at:at + 2048], self._in_line(bases[at:at + 2048]), strict=True):
                memo[word] = ids + mark
        if others:
            memo.update(zip(others, self._one_by_one(others), strict=True))

    def _cased(self, data: bytes) -> bytes:
        return data.lower() if self.lowers and not any(guard in data for guard in self.guards) else data

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        found = list(map(self.memo.get, words))
        if None in found:
            holes = [place for place, ids in enumerate(found) if ids is None]
            missing = {words[place] for place in holes}
            if len(self.memo) + len(missing) > self.limit:
                self.older, self.memo = self.memo, {}
            self._learn(missing)
            for place in holes:
                found[place] = self.memo[words[place]]
        return found

    def ids(self, data: bytes, closing: bytes = b"") -> bytes:
        """Ids of a text, and *closing* behind them."""
        found = self._known(self._cased(data).split())
        found.append(closing)
        return b"".join(found)

    def counts(self, words: list[bytes]) -> list[int]:
        return [len(ids) >> 2 for ids in self._known(words)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """This worker's encoder."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _whole(path: str, key: str = "doc_id"):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column("data").to_pylist()
            yield pa.record_batch({
                key: batch.column(key), "n_bytes": pa.array([len(x or b"") for x in texts], pa.int64()),
                "n_tokens": pa.array([len(encoder.ids(x)) >> 2 if x else 0 for x in texts], pa.int64())})

    return count


def cut(data: bytes, chunk: int, overlap: int) -> Iterator[tuple[int, int, bytes]]:
    """(nominal start, first byte held, bytes held) of each chunk; every overlap is held by both neighbours in full."""
    for start in range(0, max(len(data), 1), chunk):
        first = max(0, start - overlap)
        yield start, first, data[first:start + chunk + overlap]


def _chunks(chunk: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = row["data"]
                for start, first, held in cut(data, chunk, row["overlap"]):
                    yield pa.record_batch({
                        "key": pa.array([row["key"]], pa.int64()), "doc_id": pa.array([row["doc_id"]], pa.int64()),
                        "n_bytes": pa.array([len(data)], pa.int64()), "overlap": pa.array([row["overlap"]], pa.int64()),
                        "start": pa.array([start], pa.int64()), "first": pa.array([first], pa.int64()), "held": pa.array([held], pa.binary())})

    return split


def boundaries(encoder: WordEncoder, held: bytes, first: int, start: int, chunk: int, overlap: int, n_bytes: int):
    """Tokens of a piece, and its proven boundaries in the left and the right overlap: (offset, tokens before it).

    The first word held may be the rest of a cut word, and the end of what is held may cut the last: neither its begin
    (first word) nor the tokens after it (last word) are believed, unless the document begins or ends there.
    """
    spans = word_spans(held)
    sizes = encoder.counts([held[a:b] for a, b in spans])
    left, right, before = [], [], 0
    for (a, _), size in zip(spans, sizes, strict=True):
        offset = first + a
        if a > 0 and start > 0 and offset < start + overlap:
            left.append((offset, before))
        if a > 0 and offset >= start + chunk - overlap and start + chunk < n_bytes:
            right.append((offset, before))
        before += size
    return before, left, right


_SEAM = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("before", T.LongType())]))
_PIECES = T.StructType([T.StructField("key", T.LongType()), T.StructField("seam", T.LongType()), T.StructField("ahead", _SEAM),
                        T.StructField("behind", _SEAM), T.StructField("last_total", T.LongType())])


def _encode(path: str, chunk: int):
    """Rows by seam: what the chunk before it and the chunk behind it know of it. The last chunk also gives its total."""
    side = pa.list_(pa.struct([("offset", pa.int64()), ("before", pa.int64())]))
    schema = pa.schema([("key", pa.int64()), ("seam", pa.int64()), ("ahead", side), ("behind", side), ("last_total", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                total, left, right = boundaries(encoder, row["held"], row["first"], row["start"], chunk, row["overlap"], row["n_bytes"])
                left, right = ([{"offset": a, "before": b} for a, b in side] for side in (left, right))
                if row["start"] > 0:
                    rows.append({"key": row["key"], "seam": row["start"], "ahead": [], "behind": left, "last_total": 0})
                if row["start"] + chunk < row["n_bytes"]:
                    rows.append({"key": row["key"], "seam": row["start"] + chunk, "ahead": right, "behind": [], "last_total": 0})
                else:
                    rows.append({"key": row["key"], "seam": -1, "ahead": [], "behind": [], "last_total": total})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return encode


def _spliced(pieces: DataFrame) -> DataFrame:
    """(key, n_tokens) per document; n_tokens is null where some seam has no common boundary.

    A chunk counts from the boundary at its start to the one at its end. Summed by seam: the tokens that the chunk
    before has up to the boundary, less those that the chunk behind has up to it, plus all of the last chunk.
    """
    seams = pieces.groupBy("key", "seam").agg(
        F.flatten(F.collect_list("ahead")).alias("ahead"), F.flatten(F.collect_list("behind")).alias("behind"),
        F.sum("last_total").alias("last_total"))
    offsets = lambda side: F.transform(side, lambda x: x["offset"])
    seams = seams.withColumn("common", F.array_min(F.array_intersect(offsets("ahead"), offsets("behind"))))
    before = lambda side: F.get(F.filter(side, lambda x: x["offset"] == F.col("common")), F.lit(0))["before"]
    part = F.when(F.col("seam") < 0, F.col("last_total")).otherwise(before("ahead") - before("behind"))
    return seams.select("key", part.alias("part")).groupBy("key").agg(
        F.when(F.count(F.when(F.col("part").isNull(), 1)) == 0, F.sum("part")).alias("n_tokens"))


def _huge(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Counts of the documents above a chunk, whose text is chunked over the cluster."""
    texts = cut_lineage(texts.withColumn("key", F.monotonically_increasing_id()))
    waiting, counted = texts.withColumn("overlap", F.lit(overlap).cast("long")), None
    while True:
        chunks = waiting.select("key", "doc_id", "data", "overlap").mapInArrow(
            _chunks(chunk), "key long, doc_id long, n_bytes long, overlap long, start long, first long, held binary")
        found = cut_lineage(_spliced(chunks.repartition("key", "start").mapInArrow(_encode(path, chunk), _PIECES)))
        done = found.where(F.col("n_tokens").isNotNull())
        counted = done if counted is None else counted.unionByName(done)
        failed = found.where(F.col("n_tokens").isNull()).select("key")
        overlap *= 8
        if failed.isEmpty():
            break
        # An overlap as long as the document makes every chunk hold all of it, which always aligns unless it is one word.
        waiting = texts.join(failed, "key").withColumn("overlap", F.lit(overlap).cast("long"))
        whole = waiting.where(F.octet_length("data") <= overlap)
        counted = counted.unionByName(whole.mapInArrow(_whole(path, "key"), "key long, n_bytes long, n_tokens long").drop("n_bytes"))
        waiting = waiting.where(F.octet_length("data") > overlap)
    return texts.join(counted, "key").select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), "n_tokens")


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of *docs* (doc_id, text), without begin, end or added tokens."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    huge = F.coalesce(F.octet_length("data") > chunk, F.lit(False))
    short = texts.where(~huge).mapInArrow(_whole(path), "doc_id long, n_bytes long, n_tokens long")
    return short.unionByName(_huge(texts.where(huge), path, chunk, overlap))
