"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against the reference made of all documents with a smaller id. The reference is indexed in
blocks: a block holds all 13-word windows with one anchor, the least hash of the window's five-word grams. Equal windows
have equal anchors, so a window's block is known from its own words, and a document is factored against just those
blocks that can hold a part of it. Blocks that only one document feeds are dropped before any window is written.

Within a document, neighbouring windows with one anchor form a phrase. A phrase that a smaller document has too, whole,
is a factor (or part of one: factors that touch are one span). At the border of a longer match phrases differ, as the
text around the match does; so where one anchor has several phrases, the windows of each phrase's first document are
looked up one by one, which checks every window across a border between two factors. No other windows are written:
those of a later document are in a phrase known whole, and an anchor with one phrase has no border. The words covered
are exactly those of duplicate windows.

Scale: anchors (one in five windows) are all that is shuffled for every document; phrases are written only for
documents and blocks shared by two, and single windows only at borders. All are pre-aggregated to their smallest document before
the shuffle, and the joins back are plain equi-joins that a skew split can cut, so a passage in a third of all documents
is not one task's work. Exact copies of a whole text are one factor, found by digest, and send nothing.

Windows and phrases are compared by 64-bit hash within a block whose anchor is another 64-bit hash.

Edge cases: a null text has no words; documents shorter than a window are never touched; a null doc_id counts as larger
than any other; rows with equal ids are one document as far as windows go; other columns are ignored; an empty table
gives no rows.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplework.llm.common import mixed, runs, sliding_min, slices, union_spans, word_spans
from ripplework.session import cut_lineage

WINDOW, GRAM = 13, 5
MEMO_WORDS = 120_000
_BASE = 0x9E3779B97F4A7C15
LAST_RANK = (1 << 63) - 1


class WindowHasher:
    """Hashes of a document's windows and of their anchors; word hashes are remembered."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        from xxhash import xxh64_digest

        self.digest, self.window, self.gram = xxh64_digest, window, gram
        self.memo: dict[bytes, bytes] = {}
        self.powers = np.array([pow(_BASE, j, 1 << 64) for j in range(window)], np.uint64)

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        memo, digest = self.memo, self.digest
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = []
        for word in words:
            found = memo.get(word)
            if found is None:
                found = memo[word] = digest(word)
            out.append(found)
        return np.frombuffer(b"".join(out), "<u8")

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(window hash, anchor) of each window, as signed numbers."""
        count = len(words) - self.window + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = self.word_hashes(words)
        grams = np.zeros(len(words) - self.gram + 1, np.uint64)
        for j in range(self.gram):
            grams += hashes[j:j + len(grams)] * self.powers[j]
        windows = grams[:count].copy()
        for j in range(self.gram, self.window):
            windows += hashes[j:j + count] * self.powers[j]
        anchors = sliding_min(mixed(grams), self.window - self.gram + 1)
        return mixed(windows).view(np.int64), anchors.view(np.int64)


def _anchors(window: int, gram: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher(window, gram)
        for batch in (part for whole in batches for part in slices(whole)):
            found = [np.unique(hasher((data or b"").split())[1]) for data in batch.column("data").to_pylist()]
            sizes = [len(x) for x in found]
            yield pa.record_batch({"anchor": pa.array(np.concatenate(found) if found else np.empty(0, np.int64)),
                                   **{key: pa.array(np.repeat(np.asarray(batch.column(key)), sizes)) for key in ("rank", "text_hash")}})

    return each


def _phrases(window: int, gram: int):
    """Runs of neighbouring windows with one anchor, where that anchor is wanted."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher(window, gram)
        for batch in (part for whole in batches for part in slices(whole)):
            wanted_all = batch.column("anchors")
            for row, (rank, text_hash, data) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("rank", "text_hash", "data")), strict=True)):
                windows, anchors = hasher((data or b"").split())
                first, last = runs(anchors)
                taken = np.isin(anchors[first], np.asarray(wanted_all[row].values))
                first, last = _split(first[taken], last[taken], window)
                sizes = last - first + 1
                # The first and the last window of a run hold all its words.
                phrase = mixed(windows[first].view(np.uint64) + mixed(windows[last].view(np.uint64) + sizes.astype(np.uint64)))
                inside = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(sizes) else np.empty(0, np.int64)
                yield pa.record_batch({
                    "anchor": pa.array(anchors[first]), "phrase": pa.array(phrase.view(np.int64)), "rank": pa.array(np.full(len(first), rank, np.int64)),
                    "text_hash": pa.array(np.full(len(first), text_hash, np.int64)), "start": pa.array(first.astype(np.int64)),
                    "windows": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(windows[inside]))})

    return each


def _split(first: np.ndarray, last: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut, from their begin, to at most *most* windows; only periodic text has longer ones."""
    parts = (last - first) // most + 1
    if not len(parts) or parts.max() == 1:
        return first, last
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(first, parts) + most * nth
    return begin, np.minimum(begin + most - 1, np.repeat(last, parts))


def _key() -> list:
    """What tells documents apart: rank (the id, nulls last) and a hash of the text, should an id be repeated."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_RANK)).alias("rank"), F.xxhash64(F.col("text")).alias("text_hash")]


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(rank, text_hash, is_copy, starts, counts, references) per document that has any: runs of duplicate windows, in no
    order, by first window, number of windows and the smallest document that has them. A copy of a smaller document's
    whole text lists none."""
    texts = docs.select(*_key(), F.col("text").cast("binary").alias("data"))
    ids = cut_lineage(texts.select("rank", "text_hash", F.unhex(F.md5("data")).alias("digest")))
    first = cut_lineage(ids.groupBy("digest").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = cut_lineage(ids.join(first, "digest").where(F.col("rank") > F.col("first")).select("rank", "text_hash").distinct())

    # Hashed once, read twice.
    anchors = cut_lineage(texts.mapInArrow(_anchors(window, gram), "anchor long, rank long, text_hash long"))
    blocks = cut_lineage(anchors.groupBy("anchor").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low < high").select("anchor"))
    fed = anchors.join(blocks, "anchor", "left_semi").groupBy("rank", "text_hash").agg(F.collect_set("anchor").alias("anchors"))
    wanted = fed.join(copies, ["rank", "text_hash"], "left_anti")
    originals = texts.join(cut_lineage(wanted), ["rank", "text_hash"])
    phrases = cut_lineage(originals.select("rank", "text_hash", "data", "anchors").mapInArrow(
        _phrases(window, gram), "anchor long, phrase long, rank long, text_hash long, start long, windows array<long>"))
    first_seen = cut_lineage(phrases.groupBy("anchor", "phrase").agg(F.min("rank").alias("reference")))
    varied = cut_lineage(first_seen.groupBy("anchor").count().where("count > 1").select("anchor", F.lit(True).alias("varies")))
    known = cut_lineage(first_seen.join(varied, "anchor", "left"))
    again = F.col("rank") > F.col("reference")
    judged = cut_lineage(phrases.join(known, ["anchor", "phrase"]).where(again | F.col("varies")).select(
        "anchor", "rank", "text_hash", "start", "reference", again.alias("again"), F.size("windows").alias("n"), F.when(~again, F.col("windows")).alias("windows")))
    whole = judged.where("again").select("rank", "text_hash", "start", "n", "reference")
    asked = judged.where(~F.col("again")).select("anchor", "rank", "text_hash", "start", F.posexplode("windows").alias("at", "window"))
    index = cut_lineage(asked.groupBy("anchor", "window").agg(F.min("rank").alias("reference"), F.max("rank").alias("high"))
                        .where("reference < high").drop("high"))
    single = asked.join(index, ["anchor", "window"]).where(F.col("reference") < F.col("rank")).select(
        "rank", "text_hash", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"), "reference")
    # A set: a row repeated any number of times lists what one text holds.
    found = whole.unionByName(single).groupBy("rank", "text_hash").agg(F.collect_set(F.struct("start", "n", "reference")).alias("runs")).select(
        "rank", "text_hash", F.col("runs.start").alias("starts"), F.col("runs.n").alias("counts"), F.col("runs.reference").alias("references"))
    return found.withColumn("is_copy", F.lit(False)).unionByName(copies.withColumn("is_copy", F.lit(True)), allowMissingColumns=True)


def with_factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """*columns* of each row of *docs*, with data (the text), is_copy, starts and counts."""
    found = cut_lineage(factors(docs, window, gram).select("rank", "text_hash", "is_copy", "starts", "counts"))
    keyed = docs.select(*columns, *_key(), F.col("text").cast("binary").alias("data"))
    return keyed.join(found, ["rank", "text_hash"], "left").drop("rank", "text_hash")


def removed_words(count: int, is_copy: bool | None, starts: Sequence[int] | None, counts: Sequence[int] | None, window: int = WINDOW) -> list[tuple[int, int]]:
    """Half-open runs of words that duplicate windows cover."""
    if is_copy:
        return [(0, count)] if count >= window else []
    if starts is None or not len(starts):
        return []
    first = np.asarray(starts, np.int64)
    return union_spans(first, first + np.asarray(counts, np.int64) + window - 1, count)


def kept_text(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """*data* without the words of *spans* and the blanks that follow them."""
    if not spans:
        return data
    starts = [a for a, _ in word_spans(data)]
    out, at = [], 0
    for begin, end in spans:
        out.append(data[at:starts[begin]])
        at = starts[end] if end < len(starts) else len(data)
    return b"".join(out) + data[at:]


def _cleaned(window: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts, changed = [], []
            for data, is_copy, starts, counts in zip(*(batch.column(x).to_pylist() for x in ("data", "is_copy", "starts", "counts")), strict=True):
                spans = [] if data is None else removed_words(len(data.split()), is_copy, starts, counts, window)
                texts.append(None if data is None else kept_text(data, spans).decode("utf-8", "replace"))
                changed.append(bool(spans))
            yield pa.record_batch({"others": batch.column("others"), "text": pa.array(texts, pa.string()), "changed": pa.array(changed)})

    return each


def without_duplicates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """*docs* with the words of duplicate windows taken out of ``text``, and ``n_chars``, where there is one, counted anew
    for texts that changed. A document that loses all its words stays, empty."""
    others = [x for x in docs.columns if x != "text"]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("others"))
    found = with_factors(packed, window, gram, ("others",)).select("others", "data", "is_copy", "starts", "counts")
    schema = T.StructType([found.schema["others"], T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
    found = found.mapInArrow(_cleaned(window), schema)
    changed = F.col("changed")
    columns = {x: F.col("others")[x] for x in others} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(columns[x].alias(x) for x in docs.columns))


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for begin, end in spans:
        out += words[at:begin]
        at = end
    return out + words[at:]
