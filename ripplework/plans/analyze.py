"""One analysis, end to end: two versions of a tree in, findings out.

``before`` holds the baseline contents of the changed files, ``after`` the whole current tree,
``changes`` the change set. Everything in between is a relation; the contents are read by the
analyzers only and dropped there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework import model
from ripplework.functions import paths as P
from ripplework.functions.text import digest
from ripplework.operators import findings as D
from ripplework.operators import graph as G
from ripplework.operators import impact as I
from ripplework.operators import resolve as R
from ripplework.operators import symbols as Y
from ripplework.operators.analyze import Analysis, analyze_files
from ripplework.operators.lines import as_text
from ripplework.session import cut_lineage

#: Lines that may name a package, a namespace or a module.
HEAD_LINES = "(?m)^[^\\n]*\\b(?:package|namespace|module|mod)\\b[^\\n]*$"


@dataclass(frozen=True)
class Report:
    """What one analysis found, as relations."""

    changes: DataFrame
    modules: DataFrame
    symbol_changes: DataFrame
    import_changes: DataFrame
    edges: DataFrame
    edge_changes: DataFrame
    module_changes: DataFrame
    walk: I.Walk
    dangling: DataFrame
    external: DataFrame
    limitations: DataFrame
    findings: DataFrame


@dataclass(frozen=True)
class Tree:
    """The current tree, analysed and linked."""

    files: DataFrame
    heads: DataFrame
    aliases: DataFrame
    bases: DataFrame
    names: DataFrame
    index: DataFrame
    analysis: Analysis
    resolved: DataFrame


def file_heads(tree: DataFrame) -> DataFrame:
    """The lines of C-family sources and ``go.mod`` that may name a package or module, wherever they stand."""
    head = F.array_join(F.regexp_extract_all(as_text(F.col("content").cast("binary")), F.lit(HEAD_LINES), F.lit(0)), "\n")
    return tree.where(P.c_family_of("path").isNotNull() | (F.col("path") == "go.mod")).select("repo", "path", head.alias("head"))


def reused_analysis(after: DataFrame, known: Analysis, max_bytes: int = model.MAX_FILE_BYTES) -> Analysis:
    """The analysis of *after*, taking from *known* what the same path of the same repository held with the same digest."""
    stamped = after.select("repo", "path", digest(F.coalesce(F.col("content").cast("binary"), F.lit(b""))).alias("digest"))
    same = cut_lineage(stamped.join(known.modules.select("repo", "path", "digest"), ["repo", "path", "digest"], "left_semi").select("repo", "path"))
    fresh = analyze_files(after.join(same, ["repo", "path"], "left_anti"), max_bytes)
    pairs = ((getattr(known, name).join(same, ["repo", "path"], "left_semi"), getattr(fresh, name)) for name in ("modules", "symbols", "imports", "calls"))
    return Analysis(*[old.unionByName(new) for old, new in pairs])


def build_tree(after: DataFrame, max_bytes: int = model.MAX_FILE_BYTES, known: Analysis | None = None, cache: str | None = None) -> Tree:
    """Analyse and link the whole current tree; contents that *known* or the *cache* has are not parsed again."""
    files = after.select("repo", "path")
    heads = cut_lineage(file_heads(after))
    configs = after.where(P.leaf("path") == "tsconfig.json").select("repo", "path", as_text(F.col("content")).alias("content"))
    aliases, bases = cut_lineage(R.alias_table(configs)), cut_lineage(R.base_urls(configs))
    files = cut_lineage(files)
    names = cut_lineage(R.module_names(files))
    index = cut_lineage(R.build_index(files, heads, names))
    analysis = _kept(analyze_files(after, max_bytes, cache) if known is None else reused_analysis(after, known, max_bytes))
    candidates = R.import_candidates(analysis.imports, R.importing_names(files, names), aliases, bases)
    resolved = cut_lineage(R.resolve_candidates(candidates, index))
    return Tree(files, heads, aliases, bases, names, index, analysis, resolved)


def _kept(analysis: Analysis) -> Analysis:
    return Analysis(*[cut_lineage(frame) for frame in (analysis.modules, analysis.symbols, analysis.imports, analysis.calls)])


def _under_new_path(frame: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows of the old version under the path the file has now."""
    return frame.join(moved, ["repo", "path"], "left").withColumn("path", F.coalesce("now", "path")).drop("now")


def session_changes(tree: Tree, before: Analysis, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(modules, symbol changes, import changes) of the changed files that have an analyzer."""
    language = F.coalesce(P.language_of("path"), P.c_family_of("path"))
    analysed = changes.where(language.isNotNull()).select("repo", "path", "status", "original_path")
    moved = analysed.where("original_path is not null").select("repo", F.col("original_path").alias("path"), F.col("path").alias("now"))
    touched = analysed.select("repo", "path")
    symbol_changes = Y.diff_symbols(
        _under_new_path(before.symbols, moved).join(touched, ["repo", "path"], "left_semi"),
        tree.analysis.symbols.join(touched, ["repo", "path"], "left_semi"))
    import_changes = Y.diff_imports(
        _under_new_path(before.imports, moved).join(touched, ["repo", "path"], "left_semi"),
        tree.analysis.imports.join(touched, ["repo", "path"], "left_semi"))
    errors = (
        tree.analysis.modules.select("repo", "path", F.col("digest").alias("after_digest"), F.col("parse_error").alias("now_error")))
    old = _under_new_path(before.modules.select("repo", "path", F.col("digest").alias("before_digest"), F.col("parse_error").alias("then_error")), moved)
    modules = analysed.join(errors, ["repo", "path"], "left").join(old, ["repo", "path"], "left").select(
        "repo", "path", "status", "original_path", "before_digest",
        F.coalesce("after_digest", digest(F.lit(""))).alias("after_digest"),
        F.coalesce("now_error", "then_error").alias("parse_error"))
    return modules, symbol_changes, import_changes


def _edge_changes(tree: Tree, before: Analysis, modules: DataFrame) -> DataFrame:
    """Relationships of changed files before and after, both resolved against the current tree."""
    moved = modules.where("original_path is not null").select("repo", F.col("original_path").alias("path"), F.col("path").alias("now"))
    touched = modules.select("repo", "path")
    # Departed files are named among the current packages, like any other file.
    listed = before.modules.select("repo", "path").distinct()
    names = R.importing_names(listed, R.module_names(listed, R.package_directories(tree.files)))
    candidates = R.import_candidates(before.imports, names, tree.aliases, tree.bases)
    then = R.resolve_candidates(candidates, tree.index)
    then = _under_new_path(then, moved).join(touched, ["repo", "path"], "left_semi")
    now = tree.resolved.join(touched, ["repo", "path"], "left_semi")

    def edges(frame: DataFrame) -> DataFrame:
        return G.first_edges(frame.where("target is not null").select(
            "repo", F.col("path").alias("source_path"), F.col("target").alias("target_path"), "module", "line", "ordinal"))

    return G.graph_diff(edges(then), edges(now))


def _dangling(tree: Tree, before: DataFrame, modules: DataFrame) -> DataFrame:
    """Unresolved imports that a departed file would have answered.

    No current file answers any of their candidates, so only the keys departed files provided
    have to be looked up, however large the tree is. Rust modules that are declared but have
    no file still end the climb.
    """
    departed = cut_lineage(G.departed_paths(modules))
    unresolved = G.unresolved_imports(tree.resolved)
    root = tree.heads.where("path = 'go.mod'")
    heads = root.unionByName(file_heads(before).join(departed, ["repo", "path"], "left_semi"))
    packages = R.package_directories(tree.files.unionByName(departed))
    gone = R.build_index(departed, heads, R.module_names(departed, packages))
    ends = tree.index.where("path is null")
    # Written once: it is read twice, and made of much that is read twice.
    index = cut_lineage(gone.unionByName(ends.join(gone.select("repo", "language", "key"), ["repo", "language", "key"], "left_anti")))
    candidates = R.import_candidates(unresolved, R.importing_names(tree.files, tree.names), tree.aliases, tree.bases)
    return G.dangling_imports(R.resolve_candidates(candidates, index), departed)


def _limitations(tree: Tree, before: Analysis, modules: DataFrame, walk: I.Walk, external: DataFrame, max_depth: int) -> DataFrame:
    place = lambda part, path, ordinal: [F.lit(part).alias("part"), path.alias("path"), ordinal.cast("int").alias("ordinal")]
    nothing, zero = F.lit(""), F.lit(0)
    found = walk.truncated.select("repo", *place(0, nothing, zero), F.lit(
        f"the walk ended after {max_depth} ring(s), its limit; what lies further out is not listed").alias("text"))
    outside = external.groupBy("repo").agg(F.count("*").alias("k")).select("repo", *place(1, nothing, zero), F.concat(
        F.col("k").cast("string"), F.lit(" import(s) lead out of the repository, and what is reached through them is unknown")).alias("text"))
    broken = modules.where("parse_error is not null").select("repo", *place(2, F.col("path"), zero), F.concat(
        "path", F.lit(": "), "parse_error", F.lit("; nothing is known of the symbols in it")).alias("text"))
    impacted = walk.nodes.select("repo", "path").distinct().join(modules.select("repo", "path", "status"), ["repo", "path"])
    now = G.dynamic_limitations(tree.analysis.imports, tree.analysis.calls, impacted.where("status <> 'deleted'"))
    gone = G.dynamic_limitations(before.imports, before.calls, impacted.where("status = 'deleted'"))
    dynamic = now.unionByName(gone).select(
        "repo", F.lit(3).alias("part"), "path", (F.col("part") * (1 << 24) + F.col("ordinal")).cast("int").alias("ordinal"), "text")
    return G.capped_limitations(found.unionByName(outside).unionByName(broken).unionByName(dynamic), ["part", "path", "ordinal"])


def analyze_change(before: DataFrame, after: DataFrame, changes: DataFrame, max_depth: int = model.MAX_DEPTH,
                   max_bytes: int = model.MAX_FILE_BYTES, tree: Tree | None = None, cache: str | None = None) -> Report:
    """The whole analysis; *tree* is :func:`build_tree` of the same *after*, if it was built before."""
    tree = build_tree(after, max_bytes, cache=cache) if tree is None else tree
    old = _kept(analyze_files(before, max_bytes, cache))
    modules, symbol_changes, import_changes = (cut_lineage(frame) for frame in session_changes(tree, old, changes))
    edges = G.import_edges(tree.resolved)
    related = cut_lineage(G.relationships(edges))
    near = I.focus(symbol_changes, related, max_depth)
    nearby = lambda frame: frame.join(near, ["repo", "path"], "left_semi")
    called = I.attribute_callers(
        R.resolve_calls(nearby(tree.analysis.calls), nearby(tree.resolved), tree.analysis.symbols), nearby(tree.analysis.symbols), max_bytes)
    calls = I.walkable_calls(called, related)
    listed = changes.join(modules.select("repo", "path", F.lit(True).alias("known")), ["repo", "path"], "left").select(
        "repo", "path", "status", F.coalesce("known", F.lit(False)).alias("analysed"))
    direct = cut_lineage(I.direct_nodes(listed, symbol_changes, Y.import_change_counts(import_changes)))
    dangling = cut_lineage(_dangling(tree, before, modules))
    walk = I.add_dangling(I.walk(direct, I.seeds_of(symbol_changes), calls, max_depth), dangling)
    external = cut_lineage(G.external_imports(G.unresolved_imports(tree.resolved), dangling))
    limitations = _limitations(tree, old, modules, walk, external, max_depth)
    return Report(
        changes=changes, modules=modules, symbol_changes=symbol_changes, import_changes=import_changes, edges=edges,
        edge_changes=_edge_changes(tree, old, modules), module_changes=G.module_changes(modules), walk=walk, dangling=dangling,
        external=external, limitations=limitations, findings=D.findings(walk.nodes, walk.reaches))
