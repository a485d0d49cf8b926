"""The session store: append-only evidence, artifacts by session, a record written last.

A session exists once its record does. Artifacts of a session without one are the leavings of
a failed attempt; readers never see them, and a replay writes the same identifiers again.

What cannot be read is kept apart and never fails a reader: damaged lines and files are listed by
:meth:`Store.damaged`, and :meth:`Store.gaps` holds the rows of every artifact against the number
noted when it was written.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.storagelevel import StorageLevel

from ripplework.operators import impact as I
from ripplework.operators.graph import external_modules
from ripplework.plans.analyze import Report

RECORD = "session_id string, repo string, started_at string, stabilised_at string, status string, changed_files long"
EVENT = "at string, kind string, session_id string, detail string"
NOTED = "session_id string, repo string, artifact string, rows long, at double"
# The artifacts of a session, in writing order; the record comes after all of them.
_CHANGE = ("repo string, path string, status string, original_path string, insertions int, deletions int, "
           "binary boolean, tracked boolean, contents_withheld boolean, note string")
_ROUTE = "category string, confidence string, distance int, reason string, chain array<string>"
ARTIFACTS = {
    "baseline": "repo string, commit string, base_revision string, tracked_changes long, untracked_files long",
    "captured": "repo string, path string, size long, tracked boolean, digest string, withheld_reason string, absent boolean",
    "changes": _CHANGE,
    "pre_existing": _CHANGE,
    "modules": "repo string, path string, status string, original_path string, parse_error string",
    "symbols": "repo string, path string, qualified_name string, kind string, change string, line_start int, line_end int, detail string",
    "imports": "repo string, path string, rendered string, change string",
    "nodes": f"repo string, path string, symbol string, {_ROUTE}, evidence array<struct<kind:string,path:string,line:int,detail:string>>",
    "reaches": f"repo string, path string, symbol string, {_ROUTE}, arrivals long",
    "evidence": "repo string, path string, symbol string, reach_reason string, kind string, evidence_path string, line int, detail string",
    "edges": "repo string, source_path string, target_path string, module string, line int, change string",
    "limitations": "repo string, rank int, text string",
    "external": "repo string, module string, imports long",
    "truncated": "repo string",
    "intent": "repo string, task string, relatedness string, tokens long, changed_files long, related_files long, "
              "unmatched_tokens long, note string",
    "tests": "repo string, status string, command array<string>, exit_code int, duration_seconds double, output_tail string, "
             "output_truncated boolean, failed int, note string",
}
#: Artifacts that a session without a task or without a test run never has.
OPTIONAL = ("intent", "tests")

# What the event of a session tells: the artifact a count is taken of, and how.
_DETAILS = {
    "insertions": ("changes", "coalesce(sum(insertions), 0)"), "deletions": ("changes", "coalesce(sum(deletions), 0)"),
    "contents_withheld": ("changes", "count_if(contents_withheld)"), "pre_existing_files": ("pre_existing", "count(*)"),
    **{counter: ("symbols", f"count_if(change = '{change}')") for counter, change in (
        ("signature_changes", "signature_changed"), ("body_changes", "body_changed"), ("symbols_added", "added"), ("symbols_removed", "removed"))},
    "impact_nodes": ("nodes", "count(*)"), "truncated": ("truncated", "count(*)"),
    "intent": ("intent", "max(task)"), "tests": ("tests", "max(status)"),
}
DETAIL = ("changed_files", *_DETAILS)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # ------------------------------------------------------------------------- evidence

    def append_events(self, events: DataFrame) -> None:
        """Add rows of (at, kind, session_id, detail) to the log; nothing is ever rewritten."""
        events.select("at", "kind", "session_id", "detail").write.mode("append").json(self._path("events"))

    def events(self) -> DataFrame:
        return self._read("events", EVENT)

    def write_artifacts(self, relations: Mapping[str, DataFrame], sessions: DataFrame) -> None:
        """Replace artifacts of the given (repo, session_id), partition by partition, then note how many rows each has."""
        keys, held, noted = sessions.select("repo", "session_id"), [], []
        try:
            for name in (name for name in ARTIFACTS if name in relations):
                keyed = _whole(name, relations[name]).join(keys, "repo").persist(StorageLevel.DISK_ONLY)
                held.append(keyed)
                keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(self._path(f"artifacts/{name}"))
                counted = keyed.groupBy("session_id").agg(F.count("*").alias("rows"))
                noted.append(keys.join(counted, "session_id", "left").select(
                    "session_id", "repo", F.lit(name).alias("artifact"), F.coalesce("rows", F.lit(0)).alias("rows")))
            if noted:
                reduce(DataFrame.unionByName, noted).withColumn("at", F.lit(time.time())).write.mode("append").json(self._path("noted"))
        finally:
            for keyed in held:
                keyed.unpersist()

    def artifact(self, name: str, session_id: str | None = None, sessions: DataFrame | None = None) -> DataFrame | None:
        """One artifact of committed sessions, or None when there is none. *sessions* are those, if they were read before."""
        rows = self._rows(name)
        if rows is None:
            return None
        rows = rows if session_id is None else rows.where(F.col("session_id") == session_id)
        return rows.join((self.sessions() if sessions is None else sessions).select("session_id"), "session_id", "left_semi")

    def artifact_rows(self, name: str, session_id: str | None = None, sessions: DataFrame | None = None) -> DataFrame:
        """The same, without rows where there is no such artifact."""
        rows = self.artifact(name, session_id, sessions)
        return self.spark.createDataFrame([], f"session_id string, {ARTIFACTS[name]}") if rows is None else rows

    def _rows(self, name: str) -> DataFrame | None:
        try:
            # A session that found nothing leaves no file behind; the schema is known regardless.
            return self.spark.read.schema(f"{ARTIFACTS[name]}, session_id string").option(
                "ignoreCorruptFiles", "true").parquet(self._path(f"artifacts/{name}"))
        except AnalysisException:
            return None

    # ------------------------------------------------------------------------- sessions

    def write_session(self, settled: DataFrame, report: Report, more: Mapping[str, DataFrame] | None = None, trigger: str = "watch") -> None:
        """All artifacts in fixed order, then the records, then the events.

        *more* holds what the analysis does not know of: the baseline, what it captured, changes that pre-date the session,
        the verdict on a task, a test run.
        """
        external = external_modules(report.external).join(
            report.external.groupBy("repo", "module").agg(F.count("*").alias("imports")), ["repo", "module"])
        self.write_relations(settled, {
            "changes": report.changes, "modules": report.modules, "symbols": report.symbol_changes, "imports": report.import_changes,
            "nodes": report.walk.nodes, "reaches": report.walk.reaches, "evidence": report.walk.evidence, "edges": report.edge_changes,
            "limitations": report.limitations, "external": external, "truncated": report.walk.truncated.select("repo").distinct(), **(more or {})}, trigger)

    def write_relations(self, settled: DataFrame, relations: Mapping[str, DataFrame], trigger: str = "watch") -> None:
        """Sessions of (repo, session_id, started_at, settled_at) from relations keyed by repo; ``changes`` has to be among them."""
        relations = {name: _whole(name, rows) for name, rows in relations.items()}
        self.write_artifacts(relations, settled)
        counted = relations["changes"].groupBy("repo").agg(F.count("*").alias("changed_files"))
        moment = lambda name: F.date_format(F.timestamp_seconds(name), "yyyy-MM-dd'T'HH:mm:ssXXX")
        records = settled.join(counted, "repo", "left").select(
            "session_id", "repo", moment("started_at").alias("started_at"), moment("settled_at").alias("stabilised_at"),
            F.lit("stabilized").alias("status"), F.coalesce("changed_files", F.lit(0)).alias("changed_files"))
        fresh = records.join(self.sessions().select("session_id"), "session_id", "left_anti")
        fresh.write.mode("append").json(self._path("sessions"))
        told = self.events().where("kind = 'session_stabilised'").select("session_id")
        described = records.join(told, "session_id", "left_anti").join(self._details(settled, relations), "repo", "left").select(
            "*", F.lit(trigger).alias("trigger"), F.col("repo").alias("repository"))
        self.append_events(described.select(
            F.col("stabilised_at").alias("at"), F.lit("session_stabilised").alias("kind"), "session_id",
            F.to_json(F.struct("trigger", "repository", *DETAIL)).alias("detail")))

    @staticmethod
    def _details(repos: DataFrame, relations: Mapping[str, DataFrame]) -> DataFrame:
        """(repo, counts...) of what a session's event tells; a count is null where its artifact was not given."""
        told = repos.select("repo").distinct()
        for artifact in dict.fromkeys(source for source, _ in _DETAILS.values()):
            counts = {name: count for name, (source, count) in _DETAILS.items() if source == artifact}
            if artifact in relations:
                counted = relations[artifact].groupBy("repo").agg(*[F.expr(count).alias(name) for name, count in counts.items()])
                told = told.join(counted, "repo", "left").fillna(0, list(counts))
            else:
                told = told.select("*", *[F.lit(None).cast("string" if name in OPTIONAL else "bigint").alias(name) for name in counts])
        return told

    def sessions(self) -> DataFrame:
        """Readable session records, one per identifier; damaged ones are skipped."""
        rows = self._read("sessions", RECORD)
        return rows.where("session_id is not null").dropDuplicates(["session_id"])

    def listing(self) -> DataFrame:
        """Session records, newest first."""
        return self.sessions().orderBy(F.desc("started_at"), "session_id")

    def latest(self) -> str | None:
        row = self.sessions().agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("s")).first()
        return row["s"]

    def missing(self, session_id: str) -> list[str]:
        """Artifacts this session lacks in whole or in part; what they feed is omitted, not guessed."""
        lacking = {row["artifact"] for row in self.gaps(session_id).collect()}
        return [name for name in ARTIFACTS if name in lacking]

    def gaps(self, session_id: str | None = None) -> DataFrame:
        """(session_id, repo, artifact, why): what committed sessions should have and cannot show.

        The rows there are held against the number noted when they were written, so a damaged file is found by what it lost.
        """
        sessions = self.sessions().select("session_id", "repo")
        sessions = sessions if session_id is None else sessions.where(F.col("session_id") == session_id)
        due = sessions.select("session_id", "repo", F.explode(F.array(*map(F.lit, ARTIFACTS))).alias("artifact"))
        noted = self._read("noted", NOTED).groupBy("session_id", "artifact").agg(F.max_by("rows", "at").alias("noted"))
        there = [
            (rows if session_id is None else rows.where(F.col("session_id") == session_id)).groupBy("session_id").agg(
                F.count("*").alias("rows")).select("session_id", F.lit(name).alias("artifact"), "rows")
            for name in ARTIFACTS if (rows := self._rows(name)) is not None]
        nothing = self.spark.createDataFrame([], "session_id string, artifact string, rows long")
        found = due.join(noted, ["session_id", "artifact"], "left").join(
            reduce(DataFrame.unionByName, there, nothing), ["session_id", "artifact"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
        why = F.when(F.col("noted").isNull() & ~F.col("artifact").isin(*OPTIONAL), "not recorded").when(
            F.col("rows") < F.col("noted"), F.concat(F.col("rows").cast("string"), F.lit(" of "), F.col("noted").cast("string"), F.lit(" row(s) can be read")))
        return found.select("session_id", "repo", "artifact", why.alias("why")).where("why is not null")

    def damaged(self) -> DataFrame:
        """(file, session_id, why, text): lines that are no record, and artifact files that cannot be opened.

        Of an artifact only the list of its files and their footers are read. A file damaged behind a good footer shows in
        :meth:`gaps` or fails its reader.
        """
        found = []
        for name, schema in (("sessions", RECORD), ("events", EVENT), ("noted", NOTED)):
            rows = self._lines(name, schema)
            if rows is not None:
                found.append(rows.where("damaged is not null").select(
                    "file", "session_id", F.lit("not a record").alias("why"), F.col("damaged").alias("text")))
        for name in ARTIFACTS:
            rows = self._rows(name)
            if rows is None:
                continue
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(
                self._path(f"artifacts/{name}")).select(F.col("_metadata.file_path").alias("file"))
            opened = rows.select(F.col("_metadata.file_path").alias("file")).distinct()
            found.append(files.join(opened, "file", "left_anti").select(
                "file", F.regexp_extract("file", "session_id=([^/]+)/", 1).alias("session_id"), F.lit("cannot be opened").alias("why"),
                F.lit(None).cast("string").alias("text")))
        return reduce(DataFrame.unionByName, found, self.spark.createDataFrame([], "file string, session_id string, why string, text string"))

    def summary(self, session_id: str) -> DataFrame | None:
        nodes, reaches = self.artifact("nodes", session_id), self.artifact("reaches", session_id)
        if nodes is None or reaches is None:
            return None
        return I.totals(nodes, I.requiring_review(nodes, reaches))

    # --------------------------------------------------------------------------- state

    def write_state(self, name: str, rows: DataFrame) -> None:
        """Replace a small table that is not part of any session, such as the rolling baseline."""
        rows.write.mode("overwrite").parquet(self._path(f"state/{name}"))

    def state(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(f"state/{name}"))
        except AnalysisException:
            return None

    def _read(self, name: str, schema: str) -> DataFrame:
        """The whole records of a table of lines; damaged ones are kept apart."""
        rows = self._lines(name, schema)
        return self.spark.createDataFrame([], schema) if rows is None else rows.where("damaged is null").drop("damaged", "file")

    def _lines(self, name: str, schema: str) -> DataFrame | None:
        try:
            # Parsed as a column: a JSON scan whose query needs nothing but the damaged text is refused.
            parsed = F.from_json("value", f"{schema}, damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged"})
            return self.spark.read.text(self._path(name)).select(parsed.alias("r"), F.col("_metadata.file_path").alias("file")).select("r.*", "file")
        except AnalysisException:
            return None


def _whole(name: str, rows: DataFrame) -> DataFrame:
    """*rows* with the columns and types of an artifact; what they do not have is null."""
    declared = [part.split(" ", 1) for part in ARTIFACTS[name].split(", ")]
    return rows.select(*[(F.col(column) if column in rows.columns else F.lit(None)).cast(kind).alias(column) for column, kind in declared])
