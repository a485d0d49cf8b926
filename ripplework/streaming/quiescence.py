"""When has a repository settled? Sessions by quiet gap, in batch and as a stream.

The batch forms cut every key's history into time buckets first. Inside a bucket the rows are
windowed in parallel; between buckets only a summary per bucket is carried. A repository that
holds a third of all observations is so spread over its buckets instead of sorted by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ripplework import model

STATE = "last_token string, active_at double, started_at double, last_at double"
OBSERVED = "repo string, seq long, at double, token string, state string, started_at double, settled_at double"


def _bucket(at: str, seconds: float) -> Column:
    return F.floor(F.col(at) / F.lit(float(seconds))).cast("bigint").alias("bucket")


def gap_sessions(activity: DataFrame, gap: float, bucket: float = 86_400.0) -> DataFrame:
    """(repo, started, ended, observations): activity no more than *gap* seconds apart.

    *activity* is (repo, at) in seconds. Sessions are found per bucket. Only the first and the last of
    a bucket can go on across its boundaries, so those are stitched and all others are done.
    """
    local = Window.partitionBy("repo", "bucket").orderBy("at")
    opened = activity.select("repo", "at", _bucket("at", max(bucket, gap))).withColumn(
        "fresh", F.coalesce((F.col("at") - F.lag("at").over(local) > gap).cast("int"), F.lit(1)))
    pieces = opened.withColumn("piece", F.sum("fresh").over(local.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        "repo", "bucket", "piece").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    edge = (F.col("piece") == 1) | (F.col("piece") == F.max("piece").over(Window.partitionBy("repo", "bucket")))
    told = pieces.withColumn("edge", edge)
    inner = told.where("not edge").select("repo", F.col("first").alias("started"), F.col("last").alias("ended"), F.col("n").alias("observations"))
    over = Window.partitionBy("repo").orderBy("first")
    stitched = told.where("edge").withColumn(
        "fresh", F.coalesce((F.col("first") - F.lag("last").over(over) > gap).cast("int"), F.lit(1))).withColumn(
        "session", F.sum("fresh").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return inner.unionByName(stitched.groupBy("repo", "session").agg(
        F.min("first").alias("started"), F.max("last").alias("ended"), F.sum("n").alias("observations")).drop("session"))


def quiescence_states(observations: DataFrame, quiet: float = model.QUIET_SECONDS,
                      minimum: float = model.MINIMUM_SESSION_SECONDS, bucket: float = 86_400.0) -> DataFrame:
    """*observations* (repo, seq, at, token) with the detector's ``state`` after each.

    Holds while ``quiet >= minimum``: a quiet period then implies the minimum age, so a state
    depends on the previous token, the previous time and the last activity alone. Otherwise
    use the stateful stream.
    """
    if quiet < minimum:
        raise ValueError("the closed form needs quiet >= minimum; use observe_stream")
    local = Window.partitionBy("repo", "bucket").orderBy("at", "seq")
    seen = observations.select("repo", "seq", F.col("at").cast("double").alias("at"), "token").withColumn(
        "bucket", _bucket("at", bucket)).withColumn("prev_token", F.lag("token").over(local)).withColumn(
        "prev_at", F.lag("at").over(local))
    place = F.struct("at", "seq")
    summary = seen.groupBy("repo", "bucket").agg(
        F.min_by(F.struct("token", "at"), place).alias("head"), F.max_by(F.struct("token", "at"), place).alias("tail"),
        F.max(F.when(F.col("prev_token") != F.col("token"), F.col("at"))).alias("inner"))
    over = Window.partitionBy("repo").orderBy("bucket")
    carried = summary.withColumn("carry", F.lag("tail").over(over)).withColumn(
        "active", F.coalesce("inner", F.when(F.col("carry.token") != F.col("head.token"), F.col("head.at")))).select(
        "repo", "bucket", "carry",
        F.last("active", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("carry_active"))
    joined = seen.join(carried, ["repo", "bucket"]).select(
        "repo", "seq", "at", "token", "bucket", "carry_active",
        F.coalesce("prev_token", "carry.token").alias("prev_token"), F.coalesce("prev_at", "carry.at").alias("prev_at"))
    moved = F.coalesce(F.col("prev_token") != F.col("token"), F.lit(False))
    active = F.coalesce(
        F.max(F.when(moved, F.col("at"))).over(local.rowsBetween(Window.unboundedPreceding, 0)), F.col("carry_active"))
    settled = F.col("at") - F.col("active_at") >= quiet
    before = F.col("prev_at") - F.col("active_at") >= quiet
    return joined.withColumn("moved", moved).withColumn("active_at", active).select(
        "repo", "seq", "at", "token",
        F.when(F.col("prev_token").isNull() | F.col("active_at").isNull(), "idle").when(F.col("moved"), "active")
        .when(settled & before, "idle").when(settled, "stable").otherwise("quieting").alias("state"))


class Detector(StatefulProcessor):
    """The quiet-period machine of one repository, kept in the stream's state.

    A micro-batch hands over the rows of its own trigger only, which the source's rate limit
    bounds; they are put in order and observed one after another.
    """

    def __init__(self, quiet: float, minimum: float) -> None:
        self.quiet, self.minimum = quiet, minimum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("detector", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        token, active_at, started_at, last_at = self.kept.get() if self.kept.exists() else (None, None, None, None)
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        states, started, settled = [], [], []
        for at, seen in zip(batch["at"], batch["token"], strict=True):
            begun, done = started_at, None
            if token is None:
                state = "idle"
            elif seen != token:
                state, active_at = "active", at
                begun = started_at = at if started_at is None else started_at
            elif started_at is None:
                state = "idle"
            elif at - active_at >= self.quiet and at - started_at >= self.minimum:
                # Settled: the session ends here and the token stays, so it is not found twice.
                state, done, started_at, active_at = "stable", at, None, None
            else:
                state = "quieting"
            token, last_at = seen, at
            states.append(state)
            started.append(begun)
            settled.append(done)
        self.kept.update((token, active_at, started_at, last_at))
        yield pd.DataFrame({
            "repo": key[0], "seq": batch["seq"], "at": batch["at"], "token": batch["token"], "state": states,
            "started_at": pd.array(started, dtype="Float64"), "settled_at": pd.array(settled, dtype="Float64")})

    def close(self) -> None:
        pass


def observe_stream(observations: DataFrame, quiet: float = model.QUIET_SECONDS,
                   minimum: float = model.MINIMUM_SESSION_SECONDS) -> DataFrame:
    """A stream of (repo, seq, at, token) to its states; ``settled_at`` marks a closed session.

    Needs the RocksDB state store (see :func:`with_state_store`).
    """
    return observations.select("repo", "seq", F.col("at").cast("double").alias("at"), "token").groupBy("repo").transformWithStateInPandas(
        statefulProcessor=Detector(quiet, minimum), outputStructType=OBSERVED, outputMode="Append", timeMode="None")


def with_state_store(spark) -> None:
    """Keep stream state in RocksDB, on executors' disks and in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def settled_sessions(states: DataFrame) -> DataFrame:
    """(repo, started_at, settled_at, token): the sessions that have settled."""
    return states.where("settled_at is not null").select("repo", "started_at", "settled_at", "token")
