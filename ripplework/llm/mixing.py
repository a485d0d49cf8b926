"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

Leaves are the distinct (domain, language, source). A budget of tokens flows down the tree by the children's weights,
each child capped at what it can give: its tokens times the epochs allowed. Since a node's cap is the sum of its
leaves' caps, a shortage is made up by siblings first, and reaches a parent's siblings only when the parent is empty.
The children of a node are levelled in closed form: in ascending order of cap per weight, the first ones whose cap the
level reaches give all they have, and the rest share what is left by weight. Everything is in whole tokens, so less
than one token per child is lost to rounding.

A leaf gives whole epochs of its documents and a prefix of the next one, in the order of a hash of (seed, epoch,
document): documents as long as their running sum of tokens stays within the rest. The prefix is found as one hash per
leaf: sums over 256 hash buckets (pre-aggregated before the shuffle) tell the bucket in which the rest runs out, the same
again within it, and only the rows of that 65 536th part of a leaf are ordered. Documents then meet their leaf's line in one join, which carries texts once.

Edge cases: nulls in the path columns are a branch of their own; a null text, or one without words, has no tokens and
comes with its leaf's prefix (a leaf without any tokens gives nothing); repeated rows are rows, ties of the hash that
are taken together or not at all; extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework.llm.common import WORD
from ripplework.session import cut_lineage

BUCKET_DIGITS, BUCKET_ROUNDS = 2, 2

#: What the corpus is mixed to: whole-number weights of the children by level (others weigh one), the part of all tokens
#: that is taken, and the seed of the epochs' orders.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "fr": 1, "es": 1}, "source": {"src1": 3, "src2": 2}}
SHARE, SEED = 0.6, 20_261


def source_tree() -> dict[str, Column]:
    """Domain, language, source. A domain is a group of sources, told by their number."""
    number = F.regexp_extract("source", r"(\d{1,9})$", 1)
    domain = F.when(number != "", F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}



def words_as_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def epoch_key(doc_id: Column, seed: int, epoch: Column) -> Column:
    """Where a document stands in an epoch's order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _weight(weights: Mapping[str, int], name: Column) -> Column:
    out = F.lit(1)
    for key, value in weights.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("decimal(18,0)")


def _levelled(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Rows with budget (the parent's), cap and weight get ``budget``: their share of it."""
    group = Window.partitionBy(*(F.col(x) for x in parent))
    upto = group.orderBy((F.col("cap") / F.col("weight").cast("double")).asc(), F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    sums = children.select("*", (F.col("budget") - F.sum("cap").over(upto) + F.col("cap")).alias("left_budget"),
                           (F.sum("weight").over(group) - F.sum("weight").over(upto) + F.col("weight")).alias("left_weight"))
    # A child is full if its cap is at most its share of what those before it leave; the full ones come first.
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    full = sums.withColumn("is_full", wide("cap") * wide("left_weight") <= wide("left_budget") * wide("weight"))
    full = full.select("*", (F.col("budget") - F.sum(F.when(F.col("is_full"), F.col("cap")).otherwise(0)).over(group)).alias("open_budget"),
                       F.sum(F.when(F.col("is_full"), 0).otherwise(F.col("weight"))).over(group).alias("open_weight"))
    share = F.expr("cast(open_budget as decimal(19,0)) * cast(weight as decimal(19,0)) div cast(open_weight as decimal(19,0))")
    return full.select(*parent, name, F.when(F.col("is_full"), F.col("cap")).otherwise(share).cast("long").alias("budget"))


def leaf_budgets(leaves: DataFrame, path: Sequence[str], share: float, epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """(path columns, tokens, budget) of *leaves* (path columns, tokens): the tokens each leaf is to give."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    capped = leaves.withColumn("cap", F.col("tokens") * epochs)
    level = None
    for depth, name in enumerate(path):
        children = capped.groupBy(*path[:depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(weights.get(name, {}), F.col(name)))
        if level is None:
            children = children.withColumn("budget", F.lit(int(total * share)).cast("long"))
        else:
            children = _joined(children, level, path[:depth])
        level = _levelled(children, path[:depth], name)
    return _joined(leaves, level, path)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner equi-join in which null keys match, with the keys once."""
    renamed = right.select(*(F.col(x).alias(f"mix_{x}") if x in keys else F.col(x) for x in right.columns))
    condition = F.lit(True)
    for x in keys:
        condition = condition & left[x].eqNullSafe(renamed[f"mix_{x}"])
    return left.join(renamed, condition).drop(*(f"mix_{x}" for x in keys))


def leaf_lines(rows: DataFrame, budgets: DataFrame, path: Sequence[str], seed: int) -> DataFrame:
    """(path columns, mix_full, mix_line): whole epochs of each leaf, and the last key of the next one that it gives.

    *rows* holds path columns, doc_id and tokens of every document.
    """
    plan = budgets.select(*path, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("mix_full"),
                          F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("room"))
    keyed = cut_lineage(_joined(rows, plan.select(*path, "mix_full"), path).select(
        *path, "tokens", epoch_key(F.col("doc_id"), seed, F.col("mix_full")).alias("key")))
    # Digit by digit: the bucket in which the rest runs out, and what is left of it there. No leaf has more than
    # 16 ** BUCKET_DIGITS buckets at once.
    ends = plan.select(*path, F.lit("").alias("bucket"), "room")
    upto = Window.partitionBy(*path).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for digits in range(BUCKET_DIGITS, BUCKET_DIGITS * BUCKET_ROUNDS + 1, BUCKET_DIGITS):
        inside = _joined(keyed.withColumn("bucket", F.substring("key", 1, digits - BUCKET_DIGITS)), ends, [*path, "bucket"])
        sums = inside.groupBy(*path, F.substring("key", 1, digits).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.first("room").alias("room"))
        past = sums.withColumn("upto", F.sum("tokens").over(upto)).where(F.col("upto") > F.col("room"))
        ends = cut_lineage(past.groupBy(*path).agg(F.min("bucket").alias("bucket"), F.min_by(F.col("room") - F.col("upto") + F.col("tokens"), "bucket").alias("room")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS * BUCKET_ROUNDS))
    within = _joined(keyed, ends, [*path, "bucket"])
    # Repeated rows and null ids share a key: they are summed before a task holds the keys of one bucket per leaf.
    running = Window.partitionBy(*path).orderBy("key")
    lines = (within.groupBy(*path, "key").agg(F.sum("tokens").alias("tokens"), F.first("room").alias("room")).withColumn("running", F.sum("tokens").over(running)).where(F.col("running") <= F.col("room"))
             .groupBy(*path).agg(F.max("key").alias("last")))
    # No row of the last bucket fits: the line is the bucket's own prefix, above all earlier keys and below its own.
    found = ends.select(*path, "bucket")
    condition = F.lit(True)
    renamed = lines.select(*(F.col(x).alias(f"mix_{x}") for x in path), "last")
    for x in path:
        condition = condition & found[x].eqNullSafe(renamed[f"mix_{x}"])
    line = found.join(renamed, condition, "left").select(*path, F.coalesce("last", "bucket").alias("mix_line"))
    return _joined(plan.select(*path, "mix_full"), line, path)


def mix(docs: DataFrame, path: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], share: float, epochs: int, seed: int,
        tokens: Column | None = None) -> DataFrame:
    """Each row of *docs* with ``mix_tokens`` and ``mix_copies``, how many times the mixture takes it.

    *path* names the tree's levels from the top, each with the column it is read from. *share* is the budget as a part
    of all tokens, *weights* the children's whole-number weights by level and name (others have one).
    """
    size = words_as_tokens(F.col("text")) if tokens is None else tokens
    levels = {f"node_{name}": column.cast("string") for name, column in path.items()}
    names = list(levels)
    rows = cut_lineage(docs.select(*(column.alias(name) for name, column in levels.items()), F.col("doc_id"), size.alias("tokens")))
    leaves = cut_lineage(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    budgets = cut_lineage(leaf_budgets(leaves, names, share, epochs, {f"node_{k}": v for k, v in weights.items()}))
    lines = cut_lineage(leaf_lines(rows, budgets, names, seed))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), size.alias("size"), *(column.alias(name) for name, column in levels.items()))
    condition = F.lit(True)
    renamed = lines.select(*(F.col(x).alias(f"mix_{x}") for x in names), "mix_full", "mix_line")
    for x in names:
        condition = condition & packed[x].eqNullSafe(renamed[f"mix_{x}"])
    taken = F.col("mix_full") + (epoch_key(F.col("id"), seed, F.col("mix_full")) <= F.col("mix_line")).cast("long")
    return packed.join(renamed, condition, "left").select(
        *(F.col("row")[x].alias(x) for x in docs.columns if x not in ("mix_tokens", "mix_copies")),
        F.col("size").alias("mix_tokens"), F.coalesce(taken, F.lit(0)).cast("long").alias("mix_copies"))
