"""Innermost interval containing a point, without pairing points and intervals.

A scope of a source file holds other scopes, so every line lies in many intervals and the
wanted one is the shortest. A join on ``start <= point <= end`` would emit every pair. Here
both sides are cut along the same radix tree instead: an interval becomes the few aligned
blocks that tile it, a point becomes the one block per level that holds it, and each block
keeps only its shortest interval. What is left is one equi-join on the block with at most one
match per level, so a file or user holding a third of all rows spreads over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIX_BITS = 2


def levels_for(span: int) -> int:
    """Levels of a radix tree wide enough for offsets below *span*."""
    return max(1, -(-int(span).bit_length() // RADIX_BITS))


def _blocks_of_interval(start: Column, end: Column, levels: int) -> Column:
    """The aligned blocks that tile ``[start, end]``, as (level, block) structs.

    At each level the ragged children on either side are emitted and the rest is handed up.
    """
    radix = 1 << RADIX_BITS
    nothing = F.array().cast("array<struct<level:int,block:bigint>>")

    def run(level: Column, low: Column, high: Column) -> Column:
        blocks = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(blocks, lambda b: F.struct(level.cast("int").alias("level"), b.alias("block")))

    state = F.struct(start.cast("bigint").alias("lo"), end.cast("bigint").alias("hi"), nothing.alias("out"))

    def step(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        up_lo = F.shiftright(lo + (radix - 1), RADIX_BITS)
        up_hi = F.shiftright(hi + 1, RADIX_BITS) - 1
        whole = up_lo <= up_hi
        last = level == levels - 1
        stop = last | ~whole
        left = run(level, lo, F.when(stop, hi).otherwise(F.shiftleft(up_lo, RADIX_BITS) - 1))
        right = F.when(stop, nothing).otherwise(
            run(level, F.shiftleft(up_hi + 1, RADIX_BITS), hi)
        )
        return F.struct(
            F.when(stop, F.lit(1).cast("bigint")).otherwise(up_lo).alias("lo"),
            F.when(stop, F.lit(0).cast("bigint")).otherwise(up_hi).alias("hi"),
            F.when(lo > hi, acc["out"]).otherwise(F.concat(acc["out"], left, right)).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), state, step, lambda acc: acc["out"])


def innermost_interval(
    points: DataFrame,
    intervals: DataFrame,
    *,
    keys: Sequence[str],
    point_id: Sequence[str],
    at: str,
    start: str,
    end: str,
    order: Sequence[str],
    carry: Sequence[str],
    levels: int,
) -> DataFrame:
    """Each point with *carry* of the shortest interval holding it; NULL where none does.

    *at*, *start* and *end* are non-negative whole offsets below ``4 ** levels``. Equal spans
    are decided by the smallest *order*.
    """
    ranked = F.struct((F.col(end) - F.col(start)).alias("span"), *[F.col(name) for name in order])
    best = (
        intervals.where(F.col(start) <= F.col(end))
        .select(*keys, ranked.alias("rank"), F.struct(*carry).alias("found"),
                F.explode(_blocks_of_interval(F.col(start), F.col(end), levels)).alias("cut"))
        .groupBy(*keys, F.col("cut.level").alias("level"), F.col("cut.block").alias("block"))
        .agg(F.min(F.struct("rank", "found")).alias("best"))
    )
    held_by = F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)),
        lambda n: F.struct(
            n.cast("int").alias("level"),
            F.floor(F.col(at) / F.pow(F.lit(1 << RADIX_BITS), n)).cast("bigint").alias("block"),
        ),
    )
    cut = points.select(
        *points.columns, F.explode(held_by).alias("cut")
    ).select(*points.columns, F.col("cut.level").alias("level"), F.col("cut.block").alias("block"))
    rest = [name for name in points.columns if name not in point_id]
    joined = cut.join(best, [*keys, "level", "block"], "left").groupBy(*point_id).agg(
        *[F.first(name).alias(name) for name in rest], F.min("best").alias("best")
    )
    return joined.select(
        *points.columns, *[F.col(f"best.found.{name}").alias(name) for name in carry]
    )
