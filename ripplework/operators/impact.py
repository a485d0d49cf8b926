"""The impact walk: from changed symbols outward, ring by ring.

Resolution of a call does not depend on the walk, so calls are resolved once and each ring is
one equi-join of the frontier with them. What makes the answer deterministic is the order in
which a file-by-file walk would have met each call; it is carried as a sortable value:

    ord = [(self first, source, line, call name, call ordinal), ...]    one entry per ring

Arrays of structs compare element by element, so ``min_by(…, ord)`` picks exactly the first
arrival with map-side combining, and no ring needs a global sort or a row number.

The chain of files and the evidence of a route are told from ``ord``, the names its calls
reached (``trail``) and the seed's own evidence (``origin``); only these are carried, shuffled
and written, and the rest is spelled out once a route is known to be wanted.

Relations
    direct   repo, path, symbol, category, confidence, reason, line, evidence     distance 0
    seeds    repo, path, name, propagation, ord, evidence
    calls    repo, source, line, call_name, ordinal, target, names, confidence, caller
    edges    repo, source_path, target_path                    distinct import relationships
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework import model
from ripplework.functions import paths as P
from ripplework.functions.sketch import candidates
from ripplework.functions.wording import is_obligation
from ripplework.operators.intervals import innermost_interval, levels_for
from ripplework.session import cut_lineage

STEP = "array<struct<away:int,source:string,line:int,name:string,ordinal:int>>"
EVIDENCES = "array<struct<kind:string,path:string,line:int,detail:string>>"


@dataclass(frozen=True)
class Walk:
    """What a walk found: one row per symbol, one per further reason it was reached for."""

    nodes: DataFrame
    reaches: DataFrame
    evidence: DataFrame
    truncated: DataFrame


def _map(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(item) for pair in pairs.items() for item in pair]), key)


def evidence_of(kind: str, path: Column, line: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), path.alias("path"), line.cast("int").alias("line"), detail.alias("detail"))


# ------------------------------------------------------------------------------- direct


def direct_nodes(changes: DataFrame, symbol_changes: DataFrame, import_changes: DataFrame) -> DataFrame:
    """The session's own findings: one per symbol change, and file-level ones.

    *changes* is (repo, path, status, analysed); *symbol_changes* is (repo, path,
    qualified_name, change, line_start, detail); *import_changes* is (repo, path, added,
    removed) for files whose import set moved.
    """
    category = F.coalesce(P.classify_file("path"), F.lit("direct"))
    per_file = symbol_changes.select("repo", "path").distinct().withColumn("has_symbols", F.lit(True))
    moved = import_changes.select("repo", "path", "added", "removed")
    files = changes.join(per_file, ["repo", "path"], "left").join(moved, ["repo", "path"], "left")
    imports_moved = F.coalesce(F.col("added") + F.col("removed"), F.lit(0)) > 0

    whole = files.where("has_symbols is null").select(
        "repo", "path", F.lit(None).cast("string").alias("symbol"), category.alias("category"),
        F.when(~F.col("analysed"), F.concat(F.lit("file_"), "status"))
        .when(imports_moved, "imports_changed").otherwise("content_changed").alias("reason"),
        F.lit(None).cast("int").alias("line"),
        F.array(evidence_of("file_change", F.col("path"), F.lit(None),
                            F.concat("status", F.lit(" during this session")))).cast(EVIDENCES).alias("evidence"))
    symbols = symbol_changes.join(changes.select("repo", "path", "status"), ["repo", "path"]).select(
        "repo", "path", F.col("qualified_name").alias("symbol"), category.alias("category"),
        F.when(F.col("status") == "deleted", "file_deleted")
        .otherwise(F.concat(F.lit("symbol_"), "change")).alias("reason"),
        F.col("line_start").cast("int").alias("line"),
        F.array(evidence_of("symbol_change", F.col("path"), F.col("line_start"), F.col("detail")))
        .cast(EVIDENCES).alias("evidence"))
    imports = files.where(F.col("has_symbols") & imports_moved).select(
        "repo", "path", F.lit(None).cast("string").alias("symbol"), category.alias("category"),
        F.lit("imports_changed").alias("reason"), F.lit(None).cast("int").alias("line"),
        F.array(evidence_of("import_statement", F.col("path"), F.lit(None), F.concat(
            F.lit("+"), F.col("added").cast("string"), F.lit(" -"), F.col("removed").cast("string"),
            F.lit(" import(s)")))).cast(EVIDENCES).alias("evidence"))
    return whole.unionByName(symbols).unionByName(imports)


def seeds_of(symbol_changes: DataFrame) -> DataFrame:
    """What starts the walk: every changed symbol but the added ones, in file and line order."""
    return symbol_changes.where(F.col("change").isin(*model.SEED_PROPAGATION)).select(
        "repo", "path", F.col("qualified_name").alias("name"),
        _map(model.SEED_PROPAGATION, F.col("change")).alias("propagation"),
        F.array(F.struct(
            F.lit(0).alias("away"), F.col("path").alias("source"),
            F.coalesce("line_start", F.lit(0)).cast("int").alias("line"),
            F.col("qualified_name").alias("name"), F.lit(0).alias("ordinal"))).cast(STEP).alias("ord"),
        F.array(evidence_of("symbol_change", F.col("path"), F.col("line_start"), F.col("detail")))
        .cast(EVIDENCES).alias("evidence"))


# --------------------------------------------------------------------------------- calls


def attribute_callers(resolved_calls: DataFrame, symbols: DataFrame, max_bytes: int = model.MAX_FILE_BYTES) -> DataFrame:
    """Resolved calls with ``caller``: the innermost symbol around the call, NULL at module level.

    A file of at most *max_bytes* has no more lines than that.
    """
    found = innermost_interval(
        resolved_calls.withColumn("at", F.col("line").cast("bigint")),
        symbols.select("repo", "path", F.col("qualified_name").alias("caller"),
                       F.col("line_start").cast("bigint").alias("from_line"),
                       F.col("line_end").cast("bigint").alias("to_line"), F.col("ordinal").alias("symbol_ordinal")),
        keys=["repo", "path"], point_id=["repo", "path", "ordinal"], at="at", start="from_line",
        end="to_line", order=["symbol_ordinal"], carry=["caller"], levels=levels_for(max_bytes + 2))
    return found.drop("at")


def focus(changed: DataFrame, edges: DataFrame, max_depth: int = model.MAX_DEPTH) -> DataFrame:
    """(repo, path): files that reach a changed one over at most *max_depth* imports.

    Edges are narrow, so finding this set first is cheap, and only its calls have to be
    resolved: a session that touches little costs little, whatever the repository holds.
    """
    seen = cut_lineage(changed.select("repo", "path").distinct())
    ring = seen
    for _ in range(max_depth):
        importers = edges.join(ring.withColumnRenamed("path", "target_path"), ["repo", "target_path"], "left_semi").select(
            "repo", F.col("source_path").alias("path")).distinct()
        ring = cut_lineage(importers.join(seen, ["repo", "path"], "left_anti"))
        if ring.isEmpty():
            break
        seen = seen.unionByName(ring)
    return seen


def walkable_calls(called: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Calls the walk can follow: into the same file, or into a file the caller's file imports.

    One row per (call, candidate name), keyed for the ring join. Without *edges* all calls are kept; the walk is then
    given the edges and looks up those of the calls it meets.
    """
    shaped = called.select(
        "repo", F.col("path").alias("source"), "line", F.col("name").alias("call_name"), "ordinal", "target",
        "names", "confidence", "caller")
    return (shaped if edges is None else _along(shaped, edges)).select(
        *[name for name in shaped.columns if name != "names"], F.posexplode("names").alias("name_position", "name"))


def _along(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """*calls* (repo, source, target, ...) within a file or along one of *edges*."""
    inside = calls.where("source = target")
    across = calls.where("source <> target").join(
        edges.select("repo", F.col("source_path").alias("source"), F.col("target_path").alias("target")),
        ["repo", "source", "target"], "left_semi")
    return inside.unionByName(across.select(inside.columns))


# ---------------------------------------------------------------------------------- walk


def _met(frontier: DataFrame, calls: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Calls that reach the frontier, with its columns; only rows that may are shuffled."""
    calls = calls.withColumnRenamed("target", "path")
    reached = []
    # A frontier entry without a name stands for its whole file: any call into it counts.
    for entries, called, key in ((frontier.where("name is not null"), calls, ["repo", "path", "name"]),
                                 (frontier.where("name is null").drop("name"), calls.where("name_position = 0"), ["repo", "path"])):
        if entries.isEmpty():
            continue
        near = candidates(called, entries, key)
        if edges is not None:
            near = cut_lineage(near)
            wanted = near.where("source <> path").select("repo", F.col("source").alias("source_path"), F.col("path").alias("target_path"))
            known = candidates(edges.select(wanted.columns), wanted, wanted.columns)
            near = _along(near.withColumnRenamed("path", "target"), known).withColumnRenamed("target", "path")
        reached.append(entries.join(near, key))
    if not reached:
        return frontier.join(calls, ["repo", "path", "name"]).limit(0)
    return reduce(DataFrame.unionByName, reached)


def _arrivals(frontier: DataFrame, calls: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Every call that reaches the frontier, classified and ordered."""
    step = F.struct(
        F.when(F.col("source") == F.col("path"), 0).otherwise(1).alias("away"), F.col("source"),
        F.col("line").cast("int").alias("line"), F.col("call_name").alias("name"),
        F.col("ordinal").cast("int").alias("ordinal"))
    return _met(frontier, calls, edges).select(
        "repo", F.col("source").alias("at_path"), F.col("caller").alias("at_symbol"),
        F.concat("ord", F.array(step)).alias("ord"), "propagation", "confidence",
        F.concat("trail", F.array("name")).alias("trail"), "origin")


CARRIED = ["propagation", "confidence", "trail", "origin"]
KEY = ["repo", "at_path", "at_symbol"]


def _category(path: str) -> Column:
    return F.coalesce(P.classify_file(path), _map({k: v[0] for k, v in model.REACHED_AS.items()}, F.col("propagation")))


def _reason() -> Column:
    return _map({k: v[1] for k, v in model.REACHED_AS.items()}, F.col("propagation"))


def _chain(order: Column) -> Column:
    """The files of a route: each step was met in one of them."""
    return F.transform(order, lambda step: step["source"])


def _evidence() -> Column:
    """What the seed brought, then a call for each further step of the route."""
    def called(name: Column, at: Column) -> Column:
        step = F.get("ord", at + 1)
        return evidence_of("call_expression", step["source"], step["line"], F.concat(
            step["name"], F.lit(" reaches "), F.get("ord", at)["source"], F.lit("#"), name))

    return F.concat("origin", F.transform("trail", called).cast(EVIDENCES))


def walk(direct: DataFrame, seeds: DataFrame, calls: DataFrame, max_depth: int = model.MAX_DEPTH, edges: DataFrame | None = None) -> Walk:
    """Expand *seeds* over *calls* for at most *max_depth* rings, at least one.

    With *edges*, a call into another file is followed only along one of them.
    """
    if max_depth < 1:
        raise ValueError("a walk has at least one ring")
    known = direct.select(
        "repo", F.col("path").alias("at_path"), F.col("symbol").alias("at_symbol")).distinct()
    visited = cut_lineage(known)
    calls = cut_lineage(calls)
    frontier = cut_lineage(seeds.select(
        "repo", "path", "name", "propagation", "ord", F.array().cast("array<string>").alias("trail"), F.col("evidence").alias("origin")))
    rings: list[DataFrame] = []
    firsts: list[DataFrame] = []
    cut_short = None

    for depth in range(1, max_depth + 1):
        arrived = cut_lineage(_arrivals(frontier, calls, edges).withColumn("distance", F.lit(depth)))
        if arrived.isEmpty():
            frontier = None
            break
        rings.append(arrived)
        fresh = cut_lineage(_first_arrivals(arrived, visited))
        if fresh.isEmpty():
            frontier = None
            break
        firsts.append(fresh)
        visited = visited.unionByName(fresh.select(*KEY))
        frontier = fresh.select(
            "repo", F.col("at_path").alias("path"), F.col("at_symbol").alias("name"),
            F.lit("indirect").alias("propagation"), "ord", "trail", "origin")
    if frontier is not None:
        cut_short = frontier.select("repo").distinct().withColumn("truncated", F.lit(True))

    return _assemble(direct, rings, firsts, cut_short, arrived.limit(0))


def _first_arrivals(arrived: DataFrame, visited: DataFrame) -> DataFrame:
    """The first arrival at each (path, symbol) that is not recorded yet; a NULL symbol equals a NULL symbol.

    Recorded ones are rows of the same grouping, so that wide rows are shuffled once and need no join after it.
    """
    met = arrived.select(*KEY, F.struct("ord", "distance", *CARRIED).alias("first"), F.lit(False).alias("recorded"))
    known = visited.select(*KEY, F.lit(None).cast(met.schema["first"].dataType).alias("first"), F.lit(True).alias("recorded"))
    return met.unionByName(known).groupBy(*KEY).agg(
        F.min_by("first", "first.ord").alias("first"), F.bool_or("recorded").alias("recorded")).where("not recorded").select(*KEY, "first.*")


def _assemble(direct: DataFrame, rings: list[DataFrame], firsts: list[DataFrame],
              cut_short: DataFrame | None, empty_ring: DataFrame) -> Walk:
    spark = direct.sparkSession
    own = direct.select(
        "repo", "path", "symbol", "category", F.lit("confirmed").alias("confidence"),
        F.lit(0).alias("distance"), "reason", F.array("path").alias("chain"), "evidence",
        F.lit(None).cast(STEP).alias("ord"))
    nodes = own
    for first in firsts:
        nodes = nodes.unionByName(first.select(
            "repo", F.col("at_path").alias("path"), F.col("at_symbol").alias("symbol"), _category("at_path").alias("category"),
            "confidence", "distance", _reason().alias("reason"), _chain(F.col("ord")).alias("chain"), _evidence().alias("evidence"), "ord"))

    arrived = reduce(DataFrame.unionByName, rings, empty_ring).select(
        "repo", F.col("at_path").alias("path"), F.col("at_symbol").alias("symbol"), "distance", "ord", *CARRIED)
    taken = nodes.where("ord is not null").select(
        F.col("repo").alias("n_repo"), F.col("path").alias("n_path"), F.col("symbol").alias("n_symbol"),
        F.col("ord").alias("n_ord"))
    # Everything that arrived but is not a node's own first route is a further reach.
    further = arrived.join(
        taken,
        (F.col("repo") == F.col("n_repo")) & (F.col("path") == F.col("n_path"))
        & F.col("symbol").eqNullSafe(F.col("n_symbol")) & (F.col("ord") == F.col("n_ord")), "left_anti")
    # A propagation has one reason of its own, and with the path one category.
    reaches = further.groupBy("repo", "path", "symbol", "propagation").agg(
        F.min(F.struct("distance", "ord", "confidence")).alias("first"), F.count("*").alias("arrivals"),
    ).select("repo", "path", "symbol", _reason().alias("reason"), _category("path").alias("category"), "first.distance", "first.confidence",
             _chain(F.col("first.ord")).alias("chain"), "arrivals", F.struct("first.distance", "first.ord").alias("position"))
    # Evidence stays a relation of its own: a symbol with a million call sites has a million
    # rows here, never one row with a million entries.
    evidence = (
        nodes.select("repo", "path", "symbol", F.lit(None).cast("string").alias("reach_reason"),
                     F.struct("distance", F.coalesce("ord", F.array().cast(STEP)).alias("ord")).alias("position"),
                     F.posexplode("evidence").alias("entry_position", "entry"))
        .unionByName(further.select(
            "repo", "path", "symbol", _reason().alias("reach_reason"),
            F.struct("distance", "ord").alias("position"), F.posexplode(_evidence()).alias("entry_position", "entry")))
        .groupBy("repo", "path", "symbol", "reach_reason", "entry")
        .agg(F.min(F.struct("position", "entry_position")).alias("position"))
        .select("repo", "path", "symbol", "reach_reason", "entry.kind", F.col("entry.path").alias("evidence_path"),
                "entry.line", "entry.detail", "position")
    )
    if cut_short is None:
        cut_short = spark.createDataFrame([], "repo string, truncated boolean")
    return Walk(nodes.drop("ord"), reaches, evidence, cut_short)


def add_dangling(found: Walk, dangling: DataFrame) -> Walk:
    """Imports left broken by the session: a reach where the file is recorded, else a node."""
    shaped = dangling.select(
        "repo", "path", F.lit(None).cast("string").alias("symbol"),
        F.coalesce(P.classify_file("path"), F.lit("indirect")).alias("category"),
        F.lit("confirmed").alias("confidence"), F.lit(1).alias("distance"),
        F.lit("dangling_import").alias("reason"), F.array("target", "path").alias("chain"),
        F.array(evidence_of("import_statement", F.col("path"), F.col("line"), F.concat(
            F.lit("still imports "), "module", F.lit(" although its file is gone")))).cast(EVIDENCES).alias("evidence"),
        F.struct("target", F.coalesce("line", F.lit(0)).cast("int").alias("line"), "module").alias("place"))
    recorded = found.nodes.where("symbol is null").select("repo", "path").distinct().withColumn("there", F.lit(True))
    tagged = shaped.join(recorded, ["repo", "path"], "left")
    first = tagged.where("there is null").groupBy("repo", "path").agg(
        F.min_by(F.struct("symbol", "category", "confidence", "distance", "reason", "chain", "evidence", "place"),
                 "place").alias("first")).select("repo", "path", "first.*")
    # The first broken import of an unrecorded file is its node, all others are reaches.
    others = tagged.join(first.select("repo", "path", "place"), ["repo", "path", "place"], "left_anti")
    nodes = found.nodes.unionByName(first.select(found.nodes.columns))
    empty_ord = F.array().cast(STEP)
    reaches = found.reaches.unionByName(
        others.groupBy("repo", "path", "symbol", "reason").agg(
            F.min_by(F.struct("category", "distance", "confidence", "chain"), "place").alias("first"),
            F.count("*").alias("arrivals"))
        .select("repo", "path", "symbol", "reason", "first.*", "arrivals",
                F.struct(F.lit(model.MAX_DEPTH + 1).alias("distance"), empty_ord.alias("ord")).alias("position")))

    def rows(frame: DataFrame, reason: Column) -> DataFrame:
        return frame.select("repo", "path", "symbol", reason.alias("reach_reason"), F.explode("evidence").alias("e")).select(
            "repo", "path", "symbol", "reach_reason", "e.kind", F.col("e.path").alias("evidence_path"), "e.line", "e.detail",
            F.struct(F.struct(F.lit(model.MAX_DEPTH + 1).alias("distance"), empty_ord.alias("ord")).alias("position"),
                     F.lit(0).alias("entry_position")).alias("position"))
    evidence = found.evidence.unionByName(rows(first, F.lit(None).cast("string"))).unionByName(
        rows(others, F.lit("dangling_import")).distinct())
    return Walk(nodes, reaches, evidence, found.truncated)


# ------------------------------------------------------------------------------- report


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    """Report order: obligations before possibilities, near before far, certain before doubtful."""
    rank = lambda table, name: _map({k: str(v) for k, v in table.items()}, F.col(name)).cast("int")
    return nodes.orderBy(
        "repo", rank(model.CATEGORY_RANK, "category"), "distance", rank(model.CONFIDENCE_RANK, "confidence"),
        "path", F.coalesce("symbol", F.lit("")))


def requiring_review(nodes: DataFrame, reaches: DataFrame) -> DataFrame:
    """Nodes whose own reason, or any reason they were reached for, is an obligation."""
    bound = reaches.where(is_obligation(F.col("reason"))).select(
        F.col("repo").alias("r_repo"), F.col("path").alias("r_path"), F.col("symbol").alias("r_symbol")).distinct()
    return nodes.join(
        bound,
        (F.col("repo") == F.col("r_repo")) & (F.col("path") == F.col("r_path"))
        & F.col("symbol").eqNullSafe(F.col("r_symbol")), "left",
    ).where(is_obligation(F.col("reason")) | F.col("r_repo").isNotNull()).select(nodes.columns)


def totals(nodes: DataFrame, review: DataFrame) -> DataFrame:
    """Per repository: nodes, files, review count and one counter per category."""
    counted = nodes.groupBy("repo").agg(
        F.count("*").alias("nodes"), F.count_distinct("path").alias("files"),
        *[F.count_if(F.col("category") == name).alias(name) for name in model.CATEGORY_RANK])
    return counted.join(
        review.groupBy("repo").agg(F.count("*").alias("requiring_review")), "repo", "left"
    ).withColumn("requiring_review", F.coalesce("requiring_review", F.lit(0)))


def impacted_files(nodes: DataFrame) -> DataFrame:
    return nodes.select("repo", "path").distinct()


def deepest(nodes: DataFrame, reaches: DataFrame) -> DataFrame:
    """The deepest distance among nodes and reaches."""
    return nodes.select("repo", "distance").unionByName(reaches.select("repo", "distance")).groupBy("repo").agg(
        F.max("distance").alias("max_depth"))


def preview(nodes: DataFrame, limit: int = model.PREVIEW_ROWS) -> DataFrame:
    """The first *limit* findings of each category, and how many there are in all."""
    place = Window.partitionBy("repo", "category").orderBy("distance", "path", F.coalesce("symbol", F.lit("")))
    shown = nodes.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit)
    total = nodes.groupBy("repo", "category").agg(F.count("*").alias("in_category"))
    return shown.join(total, ["repo", "category"]).withColumn(
        "more", F.greatest(F.col("in_category") - limit, F.lit(0)))
