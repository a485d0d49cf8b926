"""The query over stored sessions: artifacts are written to a store, and concerns raised from what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.plans.delivery import load_delivery
from ripplework.plans.registry import query, table
from ripplework.session import cut_lineage, shared_folder
from ripplework.sinks.store import ARTIFACTS, OPTIONAL, Store

# Nations are sessions: customers are what was reached, suppliers the changed files, parts of both tell the rest. Every seventh
# nation leaves nothing but its record, and every eighth has no edges recorded.
STORED_SQL = """
WITH n AS (SELECT 's' || n_nationkey AS session_id, n_nationkey AS k, n_nationkey % 7 = 6 AS quiet FROM nation),
c AS (SELECT 'c' || c_custkey AS path, 'core' || c_custkey % 3 AS root, c_custkey % 5 + 1 AS distance, c_acctbal, c_nationkey AS k, CASE
    WHEN c_nationkey % 4 = 1 AND c_acctbal < 0 THEN 'signature_changed' WHEN c_nationkey % 4 = 2 AND c_acctbal < 0 THEN 'symbol_removed'
    WHEN c_nationkey % 5 = 3 AND c_acctbal BETWEEN 0 AND 1000 THEN 'dangling_import' ELSE 'indirect_dependency' END AS reason
  FROM customer WHERE c_nationkey % 7 <> 6),
cc AS (SELECT k, count(*) FILTER (reason = 'signature_changed') AS callers, count(*) FILTER (reason = 'symbol_removed') AS refs,
    count(*) FILTER (reason = 'dangling_import') AS dangling, count(*) FILTER (c_acctbal > 9000 AND k % 3 = 0) AS tests, max(distance) AS depth FROM c GROUP BY k),
d AS (SELECT k, path, root FROM c WHERE reason = 'dangling_import'),
dp AS (SELECT k, string_agg(path, ', ' ORDER BY path) FILTER (r <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || count(*) - 5 || ' more' ELSE '' END AS words
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path) AS r FROM d) GROUP BY k),
dr AS (SELECT k, string_agg(root, ', ' ORDER BY root) AS words FROM (SELECT DISTINCT k, root FROM d) GROUP BY k),
s AS (SELECT 's' || s_suppkey AS path, s_suppkey, s_acctbal, s_nationkey AS k FROM supplier WHERE s_nationkey % 7 <> 6),
g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path) AS r FROM s WHERE s_acctbal < 0),
gn AS (SELECT k, count(*) AS gone, string_agg(path, ', ' ORDER BY path) FILTER (r <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || count(*) - 5 || ' more' ELSE '' END AS words FROM g GROUP BY k),
ss AS (SELECT k, sum(s_suppkey % 3 + 1) FILTER (s_suppkey % 4 = 0) AS outside, count(*) FILTER (s_suppkey % 10 = 0) AS limits,
    count(*) FILTER (s_acctbal > 9000) AS errors, count(*) FILTER (s_acctbal BETWEEN 4000 AND 6000) AS unread,
    count(*) FILTER (s_acctbal < -500) AS earlier, bool_or(k % 6 = 2) AS cut FROM s GROUP BY k),
u AS (SELECT n.session_id, n.k, n.quiet, coalesce(callers, 0) AS callers, coalesce(refs, 0) AS refs, coalesce(dangling, 0) AS dangling, coalesce(tests, 0) AS tests,
    depth, dp.words AS importers, dr.words AS targets, coalesce(gone, 0) AS gone, gn.words AS gone_names, coalesce(outside, 0) AS outside, coalesce(limits, 0) AS limits,
    coalesce(errors, 0) AS errors, coalesce(unread, 0) AS unread, coalesce(earlier, 0) AS earlier, coalesce(cut, FALSE) AS cut
  FROM n LEFT JOIN cc USING (k) LEFT JOIN dp USING (k) LEFT JOIN dr USING (k) LEFT JOIN gn USING (k) LEFT JOIN ss USING (k)),
rules AS (
  SELECT session_id, 1 AS position, 'note' AS severity, 'edges is missing' AS title,
    'It was not recorded or could not be read; what it feeds is left out.' AS detail FROM u WHERE k % 8 = 5
  UNION ALL SELECT session_id, 2, 'review', callers || ' caller(s) of a changed declaration', 'The declaration they call moved, so each call site needs another look.' FROM u WHERE callers > 0
  UNION ALL SELECT session_id, 3, 'review', refs || ' reference(s) to a removed symbol', 'They still name a symbol that is gone and cannot resolve.' FROM u WHERE refs > 0
  UNION ALL SELECT session_id, 4, 'review', dangling || ' file(s) import something this session removed', importers || ' still import ' || targets || ', which no longer exists.' FROM u WHERE dangling > 0
  UNION ALL SELECT session_id, 5, 'review', gone || ' module(s) removed', gone_names FROM u WHERE dangling = 0 AND gone > 0
  UNION ALL SELECT session_id, 6, 'review', 'The impact walk was cut short', 'It stopped at depth ' || depth || '; anything further out is not listed.' FROM u WHERE cut
  UNION ALL SELECT session_id, 7, 'note', outside || ' import(s) point outside the repository', 'What they depend on is not represented.' FROM u WHERE outside > 0
  UNION ALL SELECT session_id, 8, 'note', limits || ' limit(s) on this analysis', 'Dynamic dispatch, wildcard imports or unparsable files hide part of the answer.' FROM u WHERE limits > 0
  UNION ALL SELECT session_id, 9, 'note', errors || ' file(s) could not be parsed', 'Nothing is known about their symbols.' FROM u WHERE errors > 0
  UNION ALL SELECT session_id, 10, 'note', unread || ' file(s) were not read', 'The sensitive-path policy keeps their contents out.' FROM u WHERE unread > 0
  UNION ALL SELECT session_id, 11, 'note', earlier || ' change(s) pre-date this session', 'They were there when it began and are not its work.' FROM u WHERE earlier > 0
  UNION ALL SELECT session_id, 12, 'note', tests || ' test(s) reach this change', 'These tests exercise what changed.' FROM u WHERE tests > 0
  UNION ALL SELECT session_id, 13, 'review', 'Tests failed (' || k + 1 || ' failed)', 'The configured command exited non-zero.' FROM u WHERE NOT quiet AND k % 4 = 0
  UNION ALL SELECT session_id, 14, 'note', 'The test run was stopped', 'It exceeded its time limit.' FROM u WHERE NOT quiet AND k % 4 = 1
  UNION ALL SELECT session_id, 15, 'note', 'Tests could not be run', 'no program' FROM u WHERE NOT quiet AND k % 4 = 2
  UNION ALL SELECT session_id, 16, 'note', 'Potential scope expansion', k || ' of ' || k + 5 || ' words of the task match nothing that was touched.' FROM u WHERE NOT quiet AND k % 3 = 1)
SELECT * FROM rules
UNION ALL SELECT session_id, 17, 'note', 'Nothing flagged', 'The change is local to what changed.' FROM u WHERE session_id NOT IN (SELECT session_id FROM rules)"""


def _repo(key: str):
    return F.concat(F.lit("n"), F.col(key).cast("string")).alias("repo")


def _relations(spark, folder: str) -> dict[str, DataFrame]:
    """The artifacts of every nation's session."""
    customers = table(spark, folder, "customer").where("c_nationkey % 7 <> 6").withColumn("k", F.col("c_nationkey"))
    suppliers = table(spark, folder, "supplier").where("s_nationkey % 7 <> 6").withColumn("k", F.col("s_nationkey"))
    nations = table(spark, folder, "nation").where("n_nationkey % 7 <> 6").withColumn("k", F.col("n_nationkey"))
    balance, file = F.col("s_acctbal"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path")
    reason = (
        F.when(F.expr("k % 4 = 1 and c_acctbal < 0"), "signature_changed").when(F.expr("k % 4 = 2 and c_acctbal < 0"), "symbol_removed")
        .when(F.expr("k % 5 = 3 and c_acctbal between 0 and 1000"), "dangling_import").otherwise("indirect_dependency"))
    path = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    root = F.concat(F.lit("core"), (F.col("c_custkey") % 3).cast("string"))
    nodes = customers.select(
        _repo("k"), path.alias("path"), F.lit(None).cast("string").alias("symbol"),
        F.when(F.expr("c_acctbal > 9000 and k % 3 = 0"), "test").otherwise("potential").alias("category"), F.lit("confirmed").alias("confidence"),
        (F.col("c_custkey") % 5 + 1).cast("int").alias("distance"), reason.alias("reason"), F.array(root, path).alias("chain"))
    changes = suppliers.select(
        _repo("k"), file, F.when(balance < 0, "deleted").otherwise("modified").alias("status"), F.lit(None).cast("string").alias("original_path"),
        F.lit(1).alias("insertions"), F.lit(0).alias("deletions"), F.lit(False).alias("binary"), F.lit(True).alias("tracked"),
        balance.between(5000, 6000).alias("contents_withheld"), F.lit(None).cast("string").alias("note"), balance.alias("balance"))
    status = F.expr("case k % 4 when 0 then 'failed' when 1 then 'timed_out' when 2 then 'error' else 'passed' end")
    made = {
        "changes": changes, "pre_existing": changes.where("balance < -500"), "nodes": nodes,
        "modules": changes.select("repo", "path", "status", "original_path", F.when(F.col("balance") > 9000, "no source").alias("parse_error")),
        "captured": suppliers.where(balance.between(4000, 6000)).select(
            _repo("k"), file, F.lit(1).cast("bigint").alias("size"), F.lit(True).alias("tracked"), F.lit("sensitive path").alias("withheld_reason"), F.lit(False).alias("absent")),
        "external": suppliers.where("s_suppkey % 4 = 0").select(_repo("k"), file.alias("module"), (F.col("s_suppkey") % 3 + 1).cast("bigint").alias("imports")),
        "limitations": suppliers.where("s_suppkey % 10 = 0").select(_repo("k"), F.lit(1).alias("rank"), file.alias("text")),
        "truncated": suppliers.where("k % 6 = 2").select(_repo("k")).distinct(),
        "tests": nations.select(_repo("k"), status.alias("status"), (F.col("k") + 1).cast("int").alias("failed"), F.when(status == "error", "no program").alias("note")),
        "intent": nations.select(
            _repo("k"), F.when(F.col("k") % 3 == 1, "scope_expansion").otherwise("related").alias("relatedness"),
            (F.col("k") + 5).cast("bigint").alias("tokens"), F.col("k").cast("bigint").alias("unmatched_tokens"))}
    return {name: made.get(name, spark.createDataFrame([], schema)) for name, schema in ARTIFACTS.items() if name in made or name not in OPTIONAL}


@query("stored_concerns", STORED_SQL)
def stored_concerns(spark, folder):
    """Concerns over stored sessions: all seventeen rules, from artifacts written to a store and read back."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    key = F.col("n_nationkey")
    settled = cut_lineage(table(spark, folder, "nation").select(
        _repo("n_nationkey"), F.concat(F.lit("s"), key.cast("string")).alias("session_id"), key.cast("double").alias("started_at"),
        (key + 1).cast("double").alias("settled_at"), (key % 8 == 5).alias("partly")))
    relations = _relations(spark, folder)
    store.write_relations(settled.where("not partly"), relations)
    store.write_relations(settled.where("partly"), {name: rows for name, rows in relations.items() if name != "edges"})
    return load_delivery(store).concerns.select("session_id", "position", "severity", "title", "detail")
