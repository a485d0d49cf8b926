"""Command line: init, status, sessions, show, graph, analyze, intent, impact, export, watch."""

from __future__ import annotations

import argparse
import sys
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework import model
from ripplework.operators import findings as D
from ripplework.operators import graph as G
from ripplework.operators import impact as I
from ripplework.operators import intent as N
from ripplework.operators import maps as M
from ripplework.operators import snapshot as S
from ripplework.plans.analyze import analyze_change, build_tree
from ripplework.plans.delivery import load_delivery
from ripplework.session import cut_lineage, local_session
from ripplework.sinks import export as E
from ripplework.sinks.store import Store
from ripplework.sources import git
from ripplework.sources.config import STATE_DIRECTORY, Config, ConfigError, load_config
from ripplework.sources.runner import run_tests
from ripplework.sources.scaffold import initialise
from ripplework.sources.tree import at_revision, listing, raw_output, read_tree

#: Readings of a tree that keeps changing before one is taken as it is.
SNAPSHOT_TRIES = 5
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


class Workspace:
    """One repository on this machine, its store, and its relations."""

    def __init__(self, root: Path, spark: SparkSession) -> None:
        self.root, self.spark = root, spark
        self.repo = root.name
        self.config: Config = load_config(root)
        self.store = Store(spark, str(root / STATE_DIRECTORY))

    def entries(self) -> DataFrame:
        raw = raw_output(self.spark, self.repo, git.status_text(self.root))
        from ripplework.functions.paths import is_ignored
        return git.parse_status(raw).where(~is_ignored("path", self.config.ignore))

    def current(self) -> DataFrame:
        """The working tree, narrowed to what git lists and the configuration does not ignore."""
        read = read_tree(self.spark, str(self.root), self.repo, self.config.analysis.max_bytes, (".git", *self.config.ignore))
        return read.join(listing(self.spark, self.repo, self.root), ["repo", "path"], "left_semi")

    def token(self) -> str:
        """A fingerprint of the tree: commit, status entries, and sizes and times of their files."""
        rows = sorted((row["path"], row["kind"], row["original_path"]) for row in self.entries().collect())
        entries = [(kind, path, original) for path, kind, original in rows]
        stats = [(path, *self._stat(path)) for path, _, _ in rows]
        shape = "head string, entries array<struct<kind:string,path:string,original_path:string>>, stats array<struct<path:string,size:long,mtime_ns:long>>"
        frame = self.spark.createDataFrame([(git.head_commit(self.root), entries, stats)], shape)
        return frame.select(git.state_token(F.col("head"), F.col("entries"), git.stat_signature(F.col("stats")))).first()[0]

    def _stat(self, path: str) -> tuple[int | None, int | None]:
        try:
            found = (self.root / path).lstat()
        except OSError:
            return None, None
        return found.st_size, found.st_mtime_ns

    def snapshot(self, tries: int = SNAPSHOT_TRIES) -> tuple[DataFrame, DataFrame, str | None]:
        """(entries, current tree, commit) as they were at one moment: read again until nothing changed meanwhile.

        A session is analysed on its snapshot and the next baseline is taken from the same, so what is edited during
        the analysis belongs to the next session. After *tries* the last reading is used, as an editor that never rests
        must not keep sessions open.
        """
        for _ in range(max(tries, 1)):
            before = self.token()
            commit, entries, current = git.head_commit(self.root), cut_lineage(self.entries()), cut_lineage(self.current())
            if self.token() == before:
                break
        return entries, current, commit

    def capture(self, snapshot: tuple[DataFrame, DataFrame, str | None] | None = None) -> None:
        """Record a snapshot of the tree as the baseline of the next session."""
        entries, current, commit = snapshot or self.snapshot()
        captured, blobs = (cut_lineage(frame) for frame in S.capture(entries, current, self.config.secrets.exclude_paths, self.config.analysis.max_bytes))
        self.store.write_state("captured", captured)
        self.store.write_state("blobs", blobs)
        self.store.write_state("baseline", self.spark.createDataFrame(
            [(self.repo, commit, commit or EMPTY_TREE, time.time())], "repo string, commit string, base_revision string, at double").join(
                S.entry_counts(entries), "repo", "left"))

    def baseline_artifacts(self) -> dict[str, DataFrame]:
        """What the session began from, as it is kept with the session; read before the next baseline replaces it."""
        base = self.store.state("baseline")
        for name in ("tracked_changes", "untracked_files"):
            base = base.withColumn(name, F.coalesce(F.col(name), F.lit(0)) if name in base.columns else F.lit(None).cast("bigint"))
        return {"baseline": cut_lineage(base), "captured": cut_lineage(self.store.state("captured"))}

    def session(self, snapshot: tuple[DataFrame, DataFrame, str | None]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, float] | None:
        """(before, after, changes, pre-existing, start) since the stored baseline; None when there is none."""
        baseline = self.store.state("baseline")
        if baseline is None:
            return None
        base = baseline.first()
        captured, blobs = self.store.state("captured"), self.store.state("blobs")
        revision = base["base_revision"]
        raw = lambda *a: raw_output(self.spark, self.repo, git.run_git(self.root, "diff", *a, "-z", revision))
        globs, limit = self.config.secrets.exclude_paths, self.config.analysis.max_bytes
        from ripplework.functions.paths import is_ignored
        seen = S.git_changes(git.parse_name_status(raw("--name-status")), git.parse_numstat(raw("--numstat")), globs)
        entries, current, _ = snapshot
        as_text = current.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
        text_blobs = blobs.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
        untracked = entries.where("kind = 'untracked'").select("repo", "path")
        changes = S.collect_changes(seen, captured, text_blobs, as_text, untracked, globs, limit).where(~is_ignored("path", self.config.ignore))
        old = changes.select("repo", F.coalesce("original_path", "path").alias("path"))
        committed = at_revision(self.spark, str(self.root), revision, old.unionByName(captured.select("repo", "path")).distinct())
        before = S.baseline_source(old.distinct(), captured, blobs, committed).where("content is not null")
        text_committed = committed.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
        return before, current, changes, S.pre_existing_changes(captured, text_blobs, text_committed), base["at"]

    def chosen(self, session: str | None) -> str | None:
        return session or self.store.latest()


def _print_impact(nodes: DataFrame, everything: bool) -> None:
    shown = I.preview(nodes, 1 << 30 if everything else model.PREVIEW_ROWS)
    for row in shown.orderBy("category", "rank").toLocalIterator():
        print(f"  {row['category']:<14} {row['path']}{'#' + row['symbol'] if row['symbol'] else ''}  {row['reason']}")
        if row["more"] and row["rank"] == model.PREVIEW_ROWS:
            print(f"  … and {row['more']} more")


def _init(work: Workspace, args: argparse.Namespace) -> int:
    for name, made in initialise(work.root).items():
        print(f"{name}: {'created' if made else 'kept'}")
    return 0


def _status(work: Workspace, args: argparse.Namespace) -> int:
    counts = S.entry_counts(work.entries()).first()
    print(f"{work.root}: {git.head_commit(work.root) or 'no commit yet'}{', git is busy' if git.is_busy(work.root) else ''}")
    print(f"{counts['tracked_changes'] if counts else 0} tracked change(s), {counts['untracked_files'] if counts else 0} untracked file(s)")
    session = work.store.latest()
    if session is not None:
        row = load_delivery(work.store, session).summaries.first()
        print(f"last session {session}")
        for name in ("changes", "symbols", "impact"):
            print(f"  {name}: {row[name]}")
    return 0


def _sessions(work: Workspace, args: argparse.Namespace) -> int:
    lines = work.store.listing().join(load_delivery(work.store).summaries, "session_id").orderBy(F.desc("started_at"), "session_id")
    for row in lines.toLocalIterator():
        print(f"{row['session_id']}  {row['started_at']}  {row['status']}  {row['changes']}; {row['symbols']}; {row['impact']}")
    for row in work.store.damaged().orderBy("file").toLocalIterator():
        print(f"not readable: {row['file']} ({row['why']})", file=sys.stderr)
    return 0


def _show(work: Workspace, args: argparse.Namespace) -> int:
    """A stored session: its files, what each of them led to, and what a reader should know."""
    session = work.chosen(args.session)
    if session is None:
        print("No session recorded.", file=sys.stderr)
        return 1
    delivery = load_delivery(work.store, session)
    for row in delivery.files.orderBy("path").toLocalIterator():
        print(f"  {row['status']:<14} {row['path']}  {row['detail']}")
    for row in delivery.roots.orderBy("place", "root").toLocalIterator():
        print(f"  {row['root']} led to {row['findings']} finding(s)")
    if args.file:
        for row in D.findings_from(delivery.findings, F.lit(args.file)).orderBy("distance", "path", "symbol").toLocalIterator():
            print(f"    {row['path']}{'#' + row['symbol'] if row['symbol'] else ''}  {row['reason']}")
    for row in delivery.concerns.orderBy("position", "title").toLocalIterator():
        print(f"  {row['severity']}: {row['title']} — {row['detail']}")
    return 0


def _graph(work: Workspace, args: argparse.Namespace) -> int:
    tree = build_tree(work.current(), work.config.analysis.max_bytes)
    edges = G.import_edges(tree.resolved)
    print(f"{tree.analysis.modules.count()} module(s), {edges.count()} import(s), {G.unresolved_imports(tree.resolved).count()} unresolved")
    for row in G.most_imported(edges).toLocalIterator():
        print(f"  {row['imports']:>6}  {row['target_path']}")
    return 0


def _verdict(work: Workspace, task: str, changes: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """The task held against every changed file, its symbols and imports: one row."""
    named = symbols.groupBy("repo", "path").agg(F.collect_set("qualified_name").alias("symbols"))
    brought = imports.groupBy("repo", "path").agg(F.collect_set("rendered").alias("imports"))
    none = F.array().cast("array<string>")
    facts = changes.select("repo", "path").join(named, ["repo", "path"], "left").join(brought, ["repo", "path"], "left").select(
        "repo", "path", F.coalesce("symbols", none).alias("symbols"), F.coalesce("imports", none).alias("imports"))
    return cut_lineage(N.verdicts(work.spark.createDataFrame([(work.repo, task)], "repo string, task string"), facts))


def _test_run(work: Workspace, report_nodes: DataFrame, changes: DataFrame) -> DataFrame | None:
    """The outcome of the configured test run, or None where none is configured."""
    if not work.config.tests.enabled:
        return None
    tests = D.select_tests(report_nodes, changes).orderBy("priority", "path")
    run = run_tests(str(work.root), work.config.tests, [row["path"] for row in tests.toLocalIterator()])
    print(f"tests: {run.status}{' — ' + run.note if run.note else ''}")
    frame = work.spark.createDataFrame(
        [(work.repo, run.status, list(run.command), run.exit_code, run.duration_seconds, run.output_tail, run.output_truncated, run.note)],
        "repo string, status string, command array<string>, exit_code int, duration_seconds double, output_tail string, "
        "output_truncated boolean, note string")
    return frame.withColumn("failed", F.coalesce(F.expr("try_cast(regexp_extract(output_tail, '([0-9]+) failed', 1) as int)"), F.lit(0)))


def _analyze(work: Workspace, args: argparse.Namespace) -> int:
    snapshot = work.snapshot()
    found = work.session(snapshot)
    if found is None:
        work.capture(snapshot)
        print("Baseline recorded; run analyze again after changing something.")
        return 0
    before, after, changes, pre_existing, started = found
    if changes.isEmpty():
        print("Nothing changed since the baseline.")
        return 0
    changes = changes.persist()
    report = analyze_change(before, after, changes, work.config.analysis.impact_max_depth, work.config.analysis.max_bytes)
    session_id = f"{time.strftime('%Y%m%d-%H%M%S')}-{uuid.uuid4().hex[:6]}"
    settled = work.spark.createDataFrame(
        [(work.repo, session_id, started, time.time())], "repo string, session_id string, started_at double, settled_at double")
    more = {**work.baseline_artifacts(), "pre_existing": cut_lineage(pre_existing)}
    if args.intent:
        more["intent"] = _verdict(work, args.intent, report.changes, report.symbol_changes, report.import_changes)
    run = _test_run(work, report.walk.nodes, changes)
    if run is not None:
        more["tests"] = run
    work.store.write_session(settled, report, more, args.trigger if "trigger" in args else "analyze")
    _print_impact(report.walk.nodes, False)
    for row in report.limitations.orderBy("rank").toLocalIterator():
        print(f"  limit: {row['text']}")
    print(f"{more['pre_existing'].count()} change(s) pre-date this session")
    if args.intent:
        print(f"task: {model.RELATEDNESS_LABELS[more['intent'].first()['relatedness']]}")
    work.capture(snapshot)
    print(f"session {session_id}")
    return 0


def _intent(work: Workspace, args: argparse.Namespace) -> int:
    session = work.chosen(args.session)
    changes = work.store.artifact("changes", session) if session else None
    if changes is None:
        print("No session recorded.", file=sys.stderr)
        return 1
    found = _verdict(work, args.task, changes, work.store.artifact_rows("symbols", session), work.store.artifact_rows("imports", session))
    row = found.first()
    work.store.write_artifacts({"intent": found}, work.spark.createDataFrame([(work.repo, session)], "repo string, session_id string"))
    work.store.append_events(work.spark.createDataFrame(
        [(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), session, args.task, row["relatedness"])], "at string, session_id string, task string, relatedness string"
    ).select("at", F.lit("intent_compared").alias("kind"), "session_id", F.to_json(F.struct("task", "relatedness")).alias("detail")))
    print(f"{model.RELATEDNESS_LABELS[row['relatedness']]}: {row['related_files']} of {row['changed_files']} file(s), {row['unmatched_tokens']} word(s) unmatched")
    return 0


def _impact(work: Workspace, args: argparse.Namespace) -> int:
    session = work.chosen(args.session)
    nodes = work.store.artifact("nodes", session) if session else None
    if nodes is None:
        print("No session recorded.", file=sys.stderr)
        return 1
    if args.json:
        for line in I.ordered_nodes(nodes.drop("session_id")).toJSON().toLocalIterator():
            print(line)
    else:
        _print_impact(nodes, args.all)
    return 0


def _export(work: Workspace, args: argparse.Namespace) -> int:
    session = work.chosen(args.session)
    nodes = work.store.artifact("nodes", session) if session else None
    if nodes is None:
        print("No session recorded.", file=sys.stderr)
        return 1
    reaches, changes, edges = (work.store.artifact(name, session) for name in ("reaches", "changes", "edges"))
    files = changes.select("repo", "path", "status", F.coalesce("note", F.col("status")).alias("detail"))
    moved = changes.where("status in ('added', 'deleted')").select(
        "repo", "path", F.when(F.col("status") == "added", "module_added").otherwise("module_removed").alias("change"))
    graph = M.evidence_graph(files, moved, edges, nodes, reaches)
    kept, drawn, omitted = (M.change_map if args.view == "change" else M.before_after)(*graph)
    layered = M.layers(kept, drawn)
    boxes = M.placed(layered)
    if args.format == "json":
        documents = E.to_json(args.view, layered, drawn, omitted)
    else:
        documents = (E.to_svg if args.format == "svg" else E.to_excalidraw)(args.view, boxes, M.routed(boxes, drawn), omitted)
    row = documents.first()
    target = Path(args.output) if args.output else work.root / STATE_DIRECTORY / f"{session}-{args.view}.{args.format}"
    target.write_text((row["document"] if row else E.empty_document(args.view, args.format, work.repo)) + "\n", encoding="utf-8")
    print(target)
    return 0


def _watch(work: Workspace, args: argparse.Namespace) -> int:
    """Sample the tree and close a session once it has been quiet for long enough."""
    activity = work.config.activity
    if work.store.state("baseline") is None:
        work.capture()
    last, active_at, started = None, None, None
    while True:
        try:
            token = work.token()
        except git.GitError:
            time.sleep(activity.poll_interval_seconds)
            continue
        now = time.monotonic()
        if last is not None and token != last:
            active_at, started = now, started or now
        elif started and now - active_at >= activity.quiet_period_seconds and now - started >= activity.minimum_session_seconds:
            _analyze(work, argparse.Namespace(intent=None, trigger="watch"))
            active_at = started = None
        last = token
        time.sleep(activity.poll_interval_seconds if started else activity.idle_poll_interval_seconds)


COMMANDS = {"init": _init, "status": _status, "sessions": _sessions, "show": _show, "graph": _graph, "analyze": _analyze,
            "intent": _intent, "impact": _impact, "export": _export, "watch": _watch}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ripplework", description=__doc__)
    top.add_argument("--path", default=".")
    commands = top.add_subparsers(dest="command", required=True)
    made = {name: commands.add_parser(name) for name in COMMANDS}
    made["analyze"].add_argument("--intent")
    made["intent"].add_argument("--task", required=True)
    made["impact"].add_argument("--json", action="store_true")
    made["impact"].add_argument("--all", action="store_true")
    made["export"].add_argument("--format", choices=("json", "svg", "excalidraw"), default="excalidraw")
    made["export"].add_argument("--view", choices=("change", "before-after"), default="change")
    made["export"].add_argument("--output")
    made["show"].add_argument("--file")
    for name in ("show", "intent", "impact", "export"):
        made[name].add_argument("--session")
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    root = git.discover(args.path)
    if root is None:
        print("Not inside a git repository.", file=sys.stderr)
        return 1
    try:
        return COMMANDS[args.command](Workspace(root, local_session("ripplework")), args)
    except KeyboardInterrupt:
        return 130
    except (ConfigError, git.GitError) as problem:
        print(f"{type(problem).__name__}: {problem}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
