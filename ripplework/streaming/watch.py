"""The watch loop as one streaming query: observe, settle, analyse, write, go on.

A session is told by its repository, its start and its end, all of which Spark gives again when it replays a batch
after a failure, so a replay writes the same identifiers again and the store takes none twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ripplework import model
from ripplework.operators.analyze import Analysis
from ripplework.plans.analyze import analyze_change, build_tree
from ripplework.session import cut_lineage
from ripplework.sinks.store import Store
from ripplework.streaming.quiescence import observe_stream, settled_sessions, with_state_store

OBSERVATION = "repo string, seq long, at double, token string"
ACTIVE_POLL, IDLE_POLL = "2 seconds", "5 seconds"


@dataclass
class Watcher:
    """Closes sessions as they settle. Files whose contents an earlier session analysed are not parsed again.

    *collect* answers (before, after, changes) for the sessions it is given, each of another repository. A repository
    that settles several times in a batch is closed as often, in order.
    """

    spark: SparkSession
    store: Store
    collect: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]
    max_depth: int = model.MAX_DEPTH
    known: Analysis | None = None
    #: A folder that keeps what contents hold, by digest. With one, nothing is carried from session to session in memory.
    cache: str | None = None
    #: Answers what only the sampler knows of the same sessions: artifacts such as ``baseline`` and ``pre_existing``.
    more: Callable[[DataFrame], Mapping[str, DataFrame]] | None = None

    def close(self, states: DataFrame, batch: int) -> None:
        order = Window.partitionBy("repo").orderBy("settled_at", "started_at")
        settled = settled_sessions(states).withColumn("session_id", session_id()).withColumn("turn", F.row_number().over(order)).persist()
        try:
            turns = settled.agg(F.max("turn")).first()[0] or 0
            for turn in range(1, turns + 1):
                self._close(settled.where(F.col("turn") == turn).drop("turn"))
        finally:
            settled.unpersist()

    def _close(self, settled: DataFrame) -> None:
        before, after, changes = self.collect(settled)
        tree = build_tree(after, known=self.known, cache=self.cache)
        report = analyze_change(before, after, changes, self.max_depth, tree=tree, cache=self.cache)
        self.store.write_session(settled, report, self.more(settled) if self.more else None)
        if self.cache is None:
            self.known = tree.analysis if self.known is None else self._with_others(tree.analysis, settled)

    def _with_others(self, fresh: Analysis, settled: DataFrame) -> Analysis:
        """What is known of the repositories just analysed, and what was known of all others."""
        repos = settled.select("repo")
        return Analysis(*[cut_lineage(getattr(self.known, name).join(repos, "repo", "left_anti").unionByName(getattr(fresh, name)))
                          for name in ("modules", "symbols", "imports", "calls")])


def session_id() -> Column:
    return F.sha2(F.concat_ws("|", "repo", F.col("started_at").cast("string"), F.col("settled_at").cast("string")), 256)


def watch_folder(watcher: Watcher, samples: str, checkpoint: str, quiet: float = model.QUIET_SECONDS,
                 minimum: float = model.MINIMUM_SESSION_SECONDS, files_per_trigger: int = 100,
                 available_now: bool = False) -> StreamingQuery:
    """Watch a folder that samplers drop (repo, seq, at, token) JSON lines into."""
    with_state_store(watcher.spark)
    source = watcher.spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_trigger).json(samples)
    writer = observe_stream(source, quiet, minimum).writeStream.foreachBatch(watcher.close).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=ACTIVE_POLL)).start()
