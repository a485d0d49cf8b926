"""Sketches of key sets: which rows may hold one of many keys, told without a shuffle.

Keys are noted as bits of a sketch, which is broadcast. Its size follows the number of keys up to 32 MB; with more keys it
lets more rows pass. Keys are read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a sketch for each key, and at most for all; a row of it holds ``SKETCH_WORDS`` longs.
SKETCH_KEY, SKETCH_MOST, SKETCH_WORDS = 16, 28, 64


def _sketched(frame: DataFrame, keys: DataFrame, columns: list[str], how: str) -> tuple[DataFrame, Column]:
    """*frame* joined with the sketch of *keys*, and whether a row may equal one of them in *columns*."""
    bits = 1 << min(SKETCH_MOST, max(12, (SKETCH_KEY * keys.count()).bit_length()))
    bit = F.pmod(F.xxhash64(*columns), F.lit(bits))
    slot, word = F.shiftright(bit, 12), F.shiftright(bit, 6).bitwiseAND(F.lit(SKETCH_WORDS - 1)).cast("int")
    place = bit.bitwiseAND(F.lit(63)).cast("int")
    words = keys.select(slot.alias("slot"), word.alias("word"), place.alias("place")).groupBy("slot", "word").agg(
        F.expr("bit_or(shiftleft(1L, place))").alias("bits"))
    sketch = words.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found")).select(
        "slot", F.transform(F.sequence(F.lit(0), F.lit(SKETCH_WORDS - 1)), lambda at: F.coalesce(F.try_element_at("found", at), F.lit(0).cast("long"))).alias("sketch"))
    return frame.withColumn("slot", slot).join(F.broadcast(sketch), "slot", how), F.getbit(F.get("sketch", word), place) == 1


def candidates(frame: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of *frame* that may equal one of *keys* in *columns*: none is lost, few others stay."""
    joined, may = _sketched(frame, keys, columns, "inner")
    return joined.where(may).select(frame.columns)


def apart(frame: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of *frame* that equal none of *keys* in *columns* for sure, and all others."""
    joined, may = _sketched(frame, keys, columns, "left")
    may = F.coalesce(may, F.lit(False))
    return joined.where(~may).select(frame.columns), joined.where(may).select(frame.columns)
