"""Queries over activity: sessions, states, tokens and git output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.plans.registry import query, table
from ripplework.session import shared_folder
from ripplework.sources import git as S
from ripplework.streaming import quiescence as Q

QUIET = 3600


def _observations(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo"), F.col("event_id").alias("seq"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("token"))


@query("gap_sessions", f"""
WITH e AS (SELECT 'u' || user_id AS repo, epoch_us(ts) // 1000000 AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY repo ORDER BY t) <= {QUIET} THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY repo ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT repo, min(t) AS started, max(t) AS ended, count(*) AS observations FROM s GROUP BY repo, sid""")
def gap_sessions(spark, folder):
    return Q.gap_sessions(_observations(table(spark, folder, "events")), QUIET).select("repo", "started", "ended", "observations")


STATES_SQL = f"""
WITH o AS (SELECT 'u' || user_id AS repo, event_id AS seq, epoch_us(ts) // 1000000 AS t, event_type AS tok,
             lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS p FROM events),
a AS (SELECT *, (p IS NOT NULL AND tok <> p) AS act FROM o),
b AS (SELECT *, max(CASE WHEN act THEN t END) OVER (PARTITION BY repo ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS la FROM a),
c AS (SELECT *, (NOT act AND la IS NOT NULL AND t - la >= {QUIET}) AS elig FROM b),
d AS (SELECT *, sum(CASE WHEN elig THEN 1 ELSE 0 END) OVER (PARTITION BY repo, la ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS ec FROM c)
SELECT repo, seq, CASE WHEN p IS NULL OR la IS NULL THEN 'idle' WHEN act THEN 'active' WHEN elig AND ec = 1 THEN 'stable'
  WHEN ec >= 1 THEN 'idle' ELSE 'quieting' END AS state FROM d"""


@query("quiescence_states", STATES_SQL)
def quiescence_states(spark, folder):
    return Q.quiescence_states(_observations(table(spark, folder, "events")), QUIET, 2).select("repo", "seq", "state")


@query("stream_quiescence", STATES_SQL)
def stream_quiescence(spark: SparkSession, folder: str) -> DataFrame:
    """The same states from a stream over the event file, with the detector in stream state."""
    Q.with_state_store(spark)
    source = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").option(
        "maxFilesPerTrigger", 1).parquet(folder)
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    states = Q.observe_stream(_observations(source), QUIET, 2)
    states.writeStream.format("parquet").option("path", f"{place}/states").option("checkpointLocation", f"{place}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(Q.OBSERVED).parquet(f"{place}/states").select("repo", "seq", "state")


def _statuses(spark: SparkSession, folder: str) -> DataFrame:
    """An order as git status output: returned lines are renames, open ones untracked."""
    part = F.concat(F.lit("dir one/p"), F.col("l_partkey").cast("string"))
    zeros = "N... 100644 100644 100644 0000 0000"
    record = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit(f"2 R. {zeros} R100 "), part, F.lit("\x00"), F.lit("2 old/s"), F.col("l_suppkey").cast("string")))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit(f"1 .M {zeros} "), part))
        .otherwise(F.concat(F.lit("? "), part)))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", record.alias("record")))).alias("r"))
    return lines.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("repo"),
        F.concat(F.lit("# branch.oid abc"), F.col("l_orderkey").cast("string"), F.lit("\x00"),
                 F.array_join(F.transform("r", lambda x: F.concat(x["record"], F.lit("\x00"))), "")).alias("output"))


@query("parse_status", """
SELECT 'o' || l_orderkey AS repo, CASE l_returnflag WHEN 'R' THEN 'renamed' WHEN 'A' THEN 'changed' ELSE 'untracked' END AS kind,
  'dir one/p' || l_partkey AS path, CASE WHEN l_returnflag = 'R' THEN '2 old/s' || l_suppkey END AS original_path FROM lineitem""")
def parse_status(spark, folder):
    return S.parse_status(_statuses(spark, folder)).drop("pos")


@query("branch_oid", "SELECT DISTINCT 'o' || l_orderkey AS repo, 'abc' || l_orderkey AS head_oid FROM lineitem")
def branch_oid(spark, folder):
    return S.branch_oid(_statuses(spark, folder))


@query("parse_name_status", """
SELECT 'o' || l_orderkey AS repo, 'M' || l_partkey AS path, CASE l_returnflag WHEN 'R' THEN 'renamed' WHEN 'A' THEN 'added' ELSE 'unknown' END AS status,
  CASE WHEN l_returnflag = 'R' THEN 'A' || l_suppkey END AS original_path FROM lineitem""")
def parse_name_status(spark, folder):
    """Paths that look like status letters are still paths."""
    part, supplier = F.concat(F.lit("M"), F.col("l_partkey").cast("string")), F.concat(F.lit("A"), F.col("l_suppkey").cast("string"))
    flag = F.col("l_returnflag")
    record = F.when(flag == "R", F.concat(F.lit("R087\x00"), supplier, F.lit("\x00"), part)).when(
        flag == "A", F.concat(F.lit("A\x00"), part)).otherwise(F.concat(F.lit("X\x00"), part))
    raw = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(record, F.lit("\x00"))), "").alias("output")).select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("repo"), "output")
    return S.parse_name_status(raw).drop("pos")


@query("parse_numstat", """
SELECT DISTINCT 'o' || o_orderkey AS repo, 'f' || o_custkey AS path, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_custkey % 97 AS INTEGER) END AS insertions,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 3 END AS deletions FROM orders""")
def parse_numstat(spark, folder):
    """An order as a numstat record: finished ones are binary, pending ones renames."""
    count = F.when(F.col("o_orderstatus") == "F", "-\t-\t").otherwise(
        F.concat((F.col("o_custkey") % 97).cast("string"), F.lit("\t3\t")))
    path = F.concat(F.lit("f"), F.col("o_custkey").cast("string"))
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("\x00old name\x00"), path)).otherwise(path)
    raw = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("repo"), F.concat(count, name, F.lit("\x00")).alias("output"))
    return S.parse_numstat(raw)


@query("state_token", """
SELECT 'o' || l_orderkey AS repo, sha256(concat_ws(chr(0), 'oid', string_agg('changed' || chr(0) || 'p' || l_partkey || chr(0) || '', chr(0)
    ORDER BY l_linenumber, l_partkey, l_suppkey),
  string_agg('p' || l_partkey || ':' || CASE WHEN l_returnflag = 'R' THEN 'missing' ELSE l_suppkey || ':' || l_linenumber END, chr(10)
    ORDER BY l_linenumber, l_partkey, l_suppkey))) AS token FROM lineitem GROUP BY l_orderkey""")
def state_token(spark, folder):
    """The fingerprint of an order's working tree; returned parts are missing on disk."""
    there = F.col("l_returnflag") != "R"
    entry = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.lit("changed").alias("kind"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"),
        F.lit(None).cast("string").alias("original_path"), F.when(there, F.col("l_suppkey")).alias("size"), F.when(there, F.col("l_linenumber")).alias("mtime_ns"))
    orders = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return orders.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("repo"),
        S.state_token(F.lit("oid"), F.col("e"), S.stat_signature(F.col("e"))).alias("token"))
