"""Stored sessions read back as one model: their files, findings, concerns, and what could not be read.

Every relation is keyed by session, so one read answers for one session or for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework import model
from ripplework.functions import wording as W
from ripplework.operators import findings as D
from ripplework.operators import graph as G
from ripplework.operators import impact as I
from ripplework.operators import snapshot as S
from ripplework.operators import symbols as Y
from ripplework.session import cut_lineage
from ripplework.sinks.store import Store


@dataclass(frozen=True)
class Delivery:
    """Stored sessions; an artifact that is not there leaves its relation empty and a row in ``gaps``."""

    sessions: DataFrame
    files: DataFrame
    findings: DataFrame
    roots: DataFrame
    concerns: DataFrame
    summaries: DataFrame
    gaps: DataFrame


def load_delivery(store: Store, session_id: str | None = None) -> Delivery:
    """The session *session_id*, or all that are committed."""
    def read(name: str) -> DataFrame:
        # The operators key by repository; here a session stands in its place.
        return store.artifact_rows(name, session_id, sessions).withColumn("repo", F.col("session_id")).drop("session_id")

    def keyed(frame: DataFrame) -> DataFrame:
        return frame.withColumnRenamed("repo", "session_id")

    sessions = store.sessions()
    sessions = cut_lineage(sessions if session_id is None else sessions.where(F.col("session_id") == session_id))
    gaps = cut_lineage(store.gaps(session_id))
    changes, modules, nodes, reaches, symbols, imports = (read(name) for name in ("changes", "modules", "nodes", "reaches", "symbols", "imports"))
    found = D.findings(nodes, reaches)
    units = cut_lineage(_units(sessions, read, changes, modules, nodes, reaches))
    removed = G.module_changes(modules).where("change = 'module_removed'").select("repo", "path")
    record = D.Record(
        units=units, findings=found, missing=gaps.select(F.col("session_id").alias("repo"), "artifact"), modules_removed=removed,
        test_runs=read("tests"), verdicts=read("intent"))
    return Delivery(
        sessions=sessions, files=keyed(_files(changes, modules, symbols, imports)), findings=keyed(found), roots=keyed(ordered_roots(found)),
        concerns=keyed(D.concerns(record)), summaries=keyed(_summaries(units, changes, symbols, nodes, reaches)), gaps=gaps)


def _units(sessions: DataFrame, read, changes: DataFrame, modules: DataFrame, nodes: DataFrame, reaches: DataFrame) -> DataFrame:
    """One row a session with the counts that concerns are raised from."""
    withheld = S.withheld_files(read("captured"), changes)
    counts = {
        "unresolved_imports": read("external").groupBy("repo").agg(F.sum("imports")),
        "limitations": read("limitations").groupBy("repo").agg(F.count("*")),
        "parse_errors": modules.where("parse_error is not null").groupBy("repo").agg(F.count("*")),
        "not_read": withheld.groupBy("repo").agg(F.count("*")),
        "pre_existing": read("pre_existing").groupBy("repo").agg(F.count("*")),
        "truncated": read("truncated").groupBy("repo").agg(F.lit(True)),
        "max_depth": I.deepest(nodes, reaches)}
    units = sessions.select(F.col("session_id").alias("repo"))
    for name, counted in counts.items():
        units = units.join(counted.toDF("repo", name), "repo", "left")
    return units


def _files(changes: DataFrame, modules: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Changed files with the counts of their symbols and imports, and a line on each."""
    counted = symbols.groupBy("repo", "path").agg(*[F.count_if(F.col("change") == name).alias(name) for name in model.SYMBOL_CHANGES])
    moved = Y.import_change_counts(imports).select("repo", "path", F.col("added").alias("imports_added"), F.col("removed").alias("imports_removed"))
    joined = changes.join(modules.select("repo", "path", "parse_error"), ["repo", "path"], "left").join(
        counted, ["repo", "path"], "left").join(moved, ["repo", "path"], "left")
    numbers = [*model.SYMBOL_CHANGES, "imports_added", "imports_removed"]
    filled = joined.select(
        "repo", "path", "status", "original_path", "insertions", "deletions", "contents_withheld", "note", "parse_error",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in numbers])
    line = W.file_detail(F.col("parse_error"), F.col("contents_withheld"), {name: F.col(name) for name in model.SYMBOL_CHANGES},
                         F.col("imports_added"), F.col("imports_removed"), F.col("note"), F.col("status"))
    return filled.withColumn("detail", line)


def ordered_roots(found: DataFrame) -> DataFrame:
    """(repo, root, findings, place): what reached something, by the first finding in report order.

    ``place`` sorts; it is the smallest (category, distance, confidence, path, symbol) among the findings of a root.
    """
    rank = lambda table, name: F.try_element_at(
        F.create_map(*[F.lit(item) for pair in table.items() for item in pair]), F.col(name))
    place = F.struct(
        rank(model.CATEGORY_RANK, "category").alias("category"), "distance", rank(model.CONFIDENCE_RANK, "confidence").alias("confidence"),
        "path", F.coalesce("symbol", F.lit("")).alias("symbol"))
    first = found.groupBy("repo", "root").agg(F.min(place).alias("place"))
    return D.impact_roots(found).join(first, ["repo", "root"])


def _summaries(units: DataFrame, changes: DataFrame, symbols: DataFrame, nodes: DataFrame, reaches: DataFrame) -> DataFrame:
    """(repo, changes, symbols, impact): a line on each artifact."""
    review = I.totals(nodes, I.requiring_review(nodes, reaches)).select(
        "repo", F.col("files").alias("impacted_files"), "requiring_review", *model.CATEGORY_RANK)
    joined = units.join(S.totals(changes), "repo", "left").join(Y.symbol_totals(symbols).select(
        "repo", *[F.col(name).alias(f"symbols_{name}") for name in model.SYMBOL_CHANGES]), "repo", "left").join(review, "repo", "left")
    number = lambda name: F.coalesce(name, F.lit(0))
    return joined.select(
        "repo", W.changes_summary(number("files"), number("insertions"), number("deletions"), number("pre_existing")).alias("changes"),
        W.symbols_summary({name: number(f"symbols_{name}") for name in model.SYMBOL_CHANGES}, number("parse_errors")).alias("symbols"),
        W.impact_summary(number("requiring_review"), {name: number(name) for name in model.CATEGORY_RANK if name != "direct"},
                         F.coalesce("truncated", F.lit(False)), F.col("max_depth")).alias("impact"))
