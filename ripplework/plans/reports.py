"""Queries over findings, concerns, intent, maps, layouts, exports and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.functions import text as X
from ripplework.functions.wording import file_detail as detail_words
from ripplework.functions.wording import reason_label, test_run_summary
from ripplework.operators import findings as D
from ripplework.operators import intent as N
from ripplework.operators import maps as M
from ripplework.plans.linkage import WALK_SQL, trade_walk
from ripplework.plans.registry import query, table
from ripplework.sinks import export as E
from ripplework.sources import artifacts as A

STOP_SQL = "[" + ", ".join(f"'{word}'" for word in X.STOPWORDS) + "]"

# ------------------------------------------------------------------------------- findings


@query("findings", WALK_SQL + """
SELECT path, symbol, category, reason, distance, TRUE AS own FROM node
UNION ALL SELECT path, symbol, category, reason, distance, FALSE FROM reach""")
def findings(spark, folder):
    found = trade_walk(spark, folder)
    return D.findings(found.nodes, found.reaches).select("path", "symbol", "category", "reason", "distance", "own")


@query("impact_roots", WALK_SQL + """
, r1 AS (SELECT path, symbol, reason, split_part(first(chain ORDER BY o1, o2, o3, o4, o5), '>', 1) AS root FROM (
    SELECT *, row_number() OVER (PARTITION BY path, symbol ORDER BY o1, o2, o3, o4, o5) AS r FROM a1) WHERE r > 1 GROUP BY path, symbol, reason),
r2 AS (SELECT path, symbol, split_part(first(chain ORDER BY o1, o3), '>', 1) AS root FROM (
    SELECT *, row_number() OVER (PARTITION BY path, symbol ORDER BY o1, o3) AS r FROM a2) WHERE r > 1 GROUP BY path, symbol),
r3 AS (SELECT path, symbol, split_part(first(chain ORDER BY o1, o3), '>', 1) AS root FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY o1, o3) AS r FROM a3) WHERE r > 1 GROUP BY path, symbol),
r4 AS (SELECT path, symbol, split_part(first(chain ORDER BY o1, o3), '>', 1) AS root FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY o1, o3) AS r FROM a4) WHERE r > 1 GROUP BY path, symbol)
SELECT root, count(*) AS findings FROM (
  SELECT split_part(chain, '>', 1) AS root FROM node WHERE category <> 'direct' UNION ALL SELECT root FROM r1
  UNION ALL SELECT root FROM r2 UNION ALL SELECT root FROM r3 UNION ALL SELECT root FROM r4) GROUP BY root""")
def impact_roots(spark, folder):
    found = trade_walk(spark, folder)
    return D.impact_roots(D.findings(found.nodes, found.reaches)).drop("repo")


@query("reason_words", WALK_SQL + """
SELECT DISTINCT reason, distance, CASE WHEN reason = 'symbol_removed' THEN 'symbol removed'
  WHEN reason = 'symbol_signature_changed' THEN 'declaration changed' WHEN reason = 'symbol_body_changed' THEN 'body changed'
  WHEN reason = 'symbol_added' THEN 'symbol added' WHEN reason = 'file_deleted' THEN 'file deleted'
  WHEN reason = 'signature_changed' THEN 'calls a changed declaration' WHEN reason = 'body_changed' THEN 'calls a changed body'
  WHEN reason = 'indirect_dependency' THEN 'reached through another change' END AS words FROM node""")
def reason_words(spark, folder):
    nodes = trade_walk(spark, folder).nodes.select("reason", "distance").distinct()
    return nodes.withColumn("words", reason_label(F.col("reason"), F.col("distance")))


SEGMENTS_SQL = """
WITH f AS (SELECT c_mktsegment AS repo, 'crm/c' || c_custkey AS path, c_acctbal, c_nationkey FROM customer),
k AS (SELECT repo, count(*) FILTER (c_acctbal < 0) AS callers, count(*) FILTER (c_nationkey = 7) AS dangling,
        count(*) FILTER (c_acctbal > 9900) AS tests, count(*) FILTER (c_nationkey = 8) AS unresolved,
        bool_or(c_acctbal < -990) AS truncated FROM f GROUP BY repo)
"""


def _segments(spark: SparkSession, folder: str) -> D.Record:
    """Market segments as deliveries: overdrawn customers call a changed declaration, and so on."""
    customers = table(spark, folder, "customer")
    base = customers.select(
        F.col("c_mktsegment").alias("repo"), F.concat(F.lit("crm/c"), F.col("c_custkey").cast("string")).alias("path"),
        F.lit(None).cast("string").alias("symbol"), "c_acctbal", "c_nationkey")
    reason = F.when(F.col("c_acctbal") < 0, "signature_changed").otherwise("indirect_dependency")
    found = base.select(
        "repo", "path", "symbol", F.when(F.col("c_acctbal") > 9900, "test").otherwise("potential").alias("category"), reason.alias("reason"),
        F.lit(1).alias("distance"), F.array(F.lit("core"), "path").alias("chain"), F.lit("confirmed").alias("confidence"),
        F.lit(True).alias("own"), F.lit("core").alias("root"))
    broken = base.where("c_nationkey = 7").select(
        "repo", "path", "symbol", F.lit("indirect").alias("category"), F.lit("dangling_import").alias("reason"), F.lit(1).alias("distance"),
        F.array(F.lit("gone"), "path").alias("chain"), F.lit("confirmed").alias("confidence"), F.lit(False).alias("own"), F.lit("gone").alias("root"))
    units = base.groupBy("repo").agg(
        F.count_if(F.col("c_nationkey") == 8).alias("unresolved_imports"), F.bool_or(F.col("c_acctbal") < -990).alias("truncated"),
        F.lit(5).alias("max_depth"))
    return D.Record(units=units, findings=found.unionByName(broken))


@query("concerns", SEGMENTS_SQL + """
SELECT repo, 2 AS position, 'review' AS severity, callers || ' caller(s) of a changed declaration' AS title FROM k WHERE callers > 0
UNION ALL SELECT repo, 4, 'review', dangling || ' file(s) import something this session removed' FROM k WHERE dangling > 0
UNION ALL SELECT repo, 6, 'review', 'The impact walk was cut short' FROM k WHERE truncated
UNION ALL SELECT repo, 7, 'note', unresolved || ' import(s) point outside the repository' FROM k WHERE unresolved > 0
UNION ALL SELECT repo, 12, 'note', tests || ' test(s) reach this change' FROM k WHERE tests > 0
UNION ALL SELECT repo, 17, 'note', 'Nothing flagged' FROM k WHERE callers = 0 AND dangling = 0 AND NOT truncated AND unresolved = 0 AND tests = 0""")
def concerns(spark, folder):
    return D.concerns(_segments(spark, folder)).select("repo", "position", "severity", "title")


@query("test_selection", """
WITH c AS (SELECT 'tests/' || p_type || '/p' || p_partkey || '.py' AS path, p_size FROM part)
SELECT path, CASE WHEN p_size <= 10 THEN 0 ELSE 1 END AS priority FROM c""")
def test_selection(spark, folder):
    files = table(spark, folder, "part").select(
        F.lit("trade").alias("repo"), F.concat(F.lit("tests/"), "p_type", F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"),
        "p_size")
    return D.select_tests(files, files.where("p_size <= 10")).drop("repo")


# --------------------------------------------------------------------------------- intent

TOKENS_SQL = f"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token,
             generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9_]+'), 1) AS i FROM benchmark),
t AS (SELECT item_id, token, min(i) AS i FROM w WHERE NOT list_contains({STOP_SQL}, token) GROUP BY item_id, token),
s AS (SELECT t.item_id, t.token, x.p, x.form FROM t, LATERAL (SELECT 0 AS p, token AS form
  UNION ALL SELECT 1, token[:-4] WHERE ends_with(token, 'ing') AND length(token) >= 7
  UNION ALL SELECT 2, token[:-3] WHERE ends_with(token, 'ed') AND length(token) >= 6
  UNION ALL SELECT 3, token[:-3] WHERE ends_with(token, 'es') AND length(token) >= 6
  UNION ALL SELECT 4, token[:-2] WHERE ends_with(token, 's') AND length(token) >= 5) x)
"""


@query("task_tokens", TOKENS_SQL + """
SELECT t.item_id, CAST(row_number() OVER (PARTITION BY t.item_id ORDER BY t.i) - 1 AS INTEGER) AS position, t.token,
  (SELECT string_agg(form, ',' ORDER BY p) FROM s WHERE s.item_id = t.item_id AND s.token = t.token) AS forms FROM t""")
def task_tokens(spark, folder):
    words = table(spark, folder, "benchmark").select("item_id", F.posexplode(X.task_tokens("text")).alias("position", "token"))
    return words.withColumn("forms", F.array_join(X.token_forms(F.col("token")), ","))


def _tasks_and_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A conversation as a session: its first turn is the task, later turns are changed files.

    A file is named after the first word of its turn, its symbols are the second to fourth
    words joined by underscores, its import the last word.
    """
    turns = table(spark, folder, "conversations")
    repo = F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("repo")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    tasks = turns.where("turn = 0").select(repo, F.col("text").alias("task"))
    facts = turns.where("turn > 0").select(repo, "turn", words.alias("w")).select(
        "repo", F.concat(F.lit("src/"), F.coalesce(F.get("w", F.lit(0)), F.lit("")), F.lit("_t"), F.col("turn").cast("string"), F.lit(".py")).alias("path"),
        F.array(F.array_join(F.slice("w", 2, 3), "_")).alias("symbols"), F.array_compact(F.array(F.get("w", F.size("w") - 1))).alias("imports"))
    return tasks, facts


INTENT_SQL = f"""
WITH task AS (SELECT 's' || conv_id AS repo, text AS task FROM conversations WHERE turn = 0),
words AS (SELECT 's' || conv_id AS repo, turn, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM conversations WHERE turn > 0),
fact AS (SELECT repo, 'src/' || coalesce(w[1], '') || '_t' || turn || '.py' AS path, array_to_string(w[2:4], '_') AS symbol, w[-1] AS import
         FROM words),
tok AS (SELECT DISTINCT repo, token FROM (SELECT repo, unnest(regexp_extract_all(lower(task), '[a-z0-9_]+')) AS token FROM task)
        WHERE NOT list_contains({STOP_SQL}, token)),
form AS (SELECT t.repo, t.token, x.p, x.form FROM tok t, LATERAL (SELECT 0 AS p, token AS form
  UNION ALL SELECT 1, token[:-4] WHERE ends_with(token, 'ing') AND length(token) >= 7
  UNION ALL SELECT 2, token[:-3] WHERE ends_with(token, 'ed') AND length(token) >= 6
  UNION ALL SELECT 3, token[:-3] WHERE ends_with(token, 'es') AND length(token) >= 6
  UNION ALL SELECT 4, token[:-2] WHERE ends_with(token, 's') AND length(token) >= 5) x),
hit AS (
  SELECT f.repo, f.path, m.token, 0 AS kind, m.p, CASE WHEN m.form IN ('src', split_part(f.path, '/', 2)) THEN 0 ELSE 1 END AS how
  FROM fact f JOIN form m USING (repo)
  WHERE m.form IN ('src', split_part(f.path, '/', 2))
     OR (length(m.form) >= 4 AND contains(replace(regexp_replace(split_part(f.path, '/', 2), '\\.py$', ''), '_', ''), m.form))
  UNION ALL SELECT f.repo, f.path, m.token, 1, 0, 0 FROM fact f JOIN form m USING (repo) WHERE list_contains(string_split(f.symbol, '_'), m.form)
  UNION ALL SELECT f.repo, f.path, m.token, 2, 0, 0 FROM fact f JOIN form m USING (repo) WHERE list_contains(string_split(f.import, '_'), m.form)),
best AS (SELECT repo, path, token, min(kind * 100 + p * 10 + how) AS r FROM hit GROUP BY ALL)
"""


@query("intent_matches", INTENT_SQL + """
SELECT repo, path, token, CASE r // 100 WHEN 0 THEN 'path' WHEN 1 THEN 'symbol' ELSE 'import' END AS kind,
  path || CASE WHEN r < 100 AND r % 10 = 1 THEN ' (in the file name)' ELSE '' END AS detail FROM best""")
def intent_matches(spark, folder):
    return N.intent_matches(*_tasks_and_facts(spark, folder))


@query("intent_verdict", INTENT_SQL + """
, k AS (SELECT t.repo, (SELECT count(*) FROM tok WHERE tok.repo = t.repo) AS tokens,
          (SELECT count(*) FROM fact WHERE fact.repo = t.repo) AS changed_files,
          (SELECT count(DISTINCT path) FROM best WHERE best.repo = t.repo) AS related_files,
          (SELECT count(DISTINCT token) FROM best WHERE best.repo = t.repo) AS matched FROM task t)
SELECT repo, CASE WHEN changed_files = 0 OR tokens = 0 THEN 'not_compared' WHEN related_files = 0 THEN 'no_relationship'
  WHEN related_files < changed_files THEN 'scope_expansion' ELSE 'related' END AS relatedness,
  tokens, changed_files, related_files, tokens - matched AS unmatched_tokens FROM k""")
def intent_verdict(spark, folder):
    return N.verdicts(*_tasks_and_facts(spark, folder)).drop("task", "note")


@query("intent_coverage", INTENT_SQL + """
SELECT f.repo, f.path, count(b.token) > 0 AS related, count(b.token) AS words FROM fact f
LEFT JOIN best b ON b.repo = f.repo AND b.path = f.path GROUP BY f.repo, f.path""")
def intent_coverage(spark, folder):
    tasks, facts = _tasks_and_facts(spark, folder)
    return N.file_coverage(facts, N.intent_matches(tasks, facts))


@query("intent_unmatched", INTENT_SQL + """
SELECT repo, token FROM tok WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.repo = tok.repo AND b.token = tok.token)""")
def intent_unmatched(spark, folder):
    tasks, facts = _tasks_and_facts(spark, folder)
    return N.unmatched_tokens(tasks, N.intent_matches(tasks, facts)).select("repo", "token")


# ----------------------------------------------------------------------------------- maps


@query("chain_edges", WALK_SQL + """
, c AS (SELECT string_split(chain, '>') AS parts FROM node)
SELECT source, target, count(*) AS evidence FROM (
  SELECT unnest(parts[:-2]) AS source, unnest(parts[2:]) AS target FROM c WHERE len(parts) > 1) GROUP BY ALL""")
def chain_edges(spark, folder):
    nodes = trade_walk(spark, folder).nodes
    return nodes.select(F.explode(M.chain_edges(F.col("chain"))).alias("e")).groupBy("e.source", "e.target").agg(
        F.count("*").alias("evidence"))


def _maps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The evidence graph of the trade walk; the changed parts are its files."""
    found = trade_walk(spark, folder)
    files = found.nodes.where("distance = 0").select(
        "repo", "path", F.when(F.col("reason") == "file_deleted", "deleted").otherwise("modified").alias("status"),
        F.concat(F.lit("part of size "), F.col("symbol")).alias("detail"))
    no_modules = spark.createDataFrame([], "repo string, path string, change string")
    no_edges = spark.createDataFrame([], "repo string, source_path string, target_path string, module string, line int, change string")
    return M.evidence_graph(files, no_modules, no_edges, found.nodes, found.reaches)


STATE_SQL = WALK_SQL + """
, st AS (SELECT path, min(CASE WHEN reason = 'file_deleted' THEN 1 WHEN distance = 0 THEN 2 ELSE 3 END) AS r, min(distance) AS distance FROM node GROUP BY path)
"""


@query("map_node_state", STATE_SQL + """
SELECT path, CASE r WHEN 1 THEN 'removed' WHEN 2 THEN 'modified' ELSE 'affected' END AS state, distance FROM st""")
def map_node_state(spark, folder):
    nodes, _ = _maps(spark, folder)
    return nodes.select("path", "state", "distance")


@query("map_cap", STATE_SQL + """
, o AS (SELECT path, row_number() OVER (ORDER BY r, distance, path) AS place, count(*) OVER () AS k FROM st)
SELECT path, CAST(place AS INTEGER) AS place, k - 40 AS omitted FROM o WHERE place <= 40""")
def map_cap(spark, folder):
    kept, _, omitted = M.change_map(*_maps(spark, folder))
    return kept.join(omitted, "repo").select("path", "place", "omitted")


# An order as a small map: its parts are boxes, consecutive parts are arrows.
ORDER_SQL = """
WITH RECURSIVE line AS (SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS n, l_suppkey AS s FROM lineitem),
hop AS (SELECT o, p AS a, lead(p) OVER (PARTITION BY o ORDER BY n, p, s) AS b FROM line),
edge AS (SELECT DISTINCT o, a, b FROM hop WHERE b > a),
node AS (SELECT DISTINCT o, p FROM line),
walk(o, p, d) AS (
  SELECT o, p, 0 FROM node
  UNION SELECT e.o, e.b, w.d + 1 FROM walk w JOIN edge e ON e.o = w.o AND e.a = w.p),
lay AS (SELECT o, p, max(d) AS layer FROM walk GROUP BY o, p),
pos AS (SELECT *, row_number() OVER (PARTITION BY o, layer ORDER BY 'p' || p) - 1 AS row,
          count(*) OVER (PARTITION BY o, layer) * 80.0 - 16.0 AS stack FROM lay),
box AS (SELECT o, p, layer, layer * 308.0 AS x, (max(stack) OVER (PARTITION BY o) - stack) / 2 + row * 80.0 AS y FROM pos)
"""


def _order_maps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window
    repo = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("repo")
    lines = table(spark, folder, "lineitem").select(repo, "l_partkey", "l_linenumber", "l_suppkey")
    following = F.lead("l_partkey").over(Window.partitionBy("repo").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    edges = lines.select("repo", "l_partkey", following.alias("b")).where("b > l_partkey").select(
        "repo", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("b").cast("string")).alias("target"),
        F.lit("affects").alias("kind")).groupBy("repo", "source", "target", "kind").agg(F.count("*").alias("evidence"))
    nodes = lines.select("repo", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path")).repartition("repo").distinct().select(
        "repo", "path", F.lit("modified").alias("state"), F.lit(2).alias("state_rank"), F.lit(0).alias("distance"), F.lit("").alias("detail"),
        F.lit("").alias("link"))
    kept, drawn, _ = M.capped(nodes, edges)
    return M.layers(kept, drawn), drawn


@query("layer_rank", ORDER_SQL + "SELECT 'o' || o AS repo, 'p' || p AS path, layer FROM lay")
def layer_rank(spark, folder):
    layered, _ = _order_maps(spark, folder)
    return layered.select("repo", "path", "layer")


@query("layout_coords", ORDER_SQL + "SELECT 'o' || o AS repo, 'p' || p AS path, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM box")
def layout_coords(spark, folder):
    layered, _ = _order_maps(spark, folder)
    return M.placed(layered).select("repo", "path", "x", "y")


@query("edge_routes", ORDER_SQL + """
SELECT 'o' || e.o AS repo, 'p' || e.a AS source, 'p' || e.b AS target,
  CAST((s.x + 236 + t.x) / 2 AS DOUBLE) AS label_x, CAST((s.y + 32 + t.y + 32) / 2 AS DOUBLE) AS label_y
FROM edge e JOIN box s ON s.o = e.o AND s.p = e.a JOIN box t ON t.o = e.o AND t.p = e.b""")
def edge_routes(spark, folder):
    layered, edges = _order_maps(spark, folder)
    return M.routed(M.placed(layered), edges).select(
        "repo", "source", "target", F.col("label_at.x").alias("label_x"), F.col("label_at.y").alias("label_y"))


@query("export_json", ORDER_SQL + """
SELECT 'o' || o AS repo, count(*) AS nodes, (SELECT count(*) FROM edge e WHERE e.o = n.o) AS edges FROM node n GROUP BY o""")
def export_json(spark, folder):
    """Every order's map as a JSON document, read back and counted."""
    layered, edges = _order_maps(spark, folder)
    none = layered.groupBy("repo").agg(F.lit(0).alias("omitted"))
    documents = E.to_json("change", layered, edges, none)
    parsed = F.try_parse_json("document")
    return documents.select(
        "repo", F.size(F.variant_get(parsed, "$.nodes", "array<variant>")).cast("bigint").alias("nodes"),
        F.size(F.variant_get(parsed, "$.edges", "array<variant>")).cast("bigint").alias("edges"))


@query("export_svg", ORDER_SQL + """
SELECT 'o' || o AS repo, count(*) AS boxes, (SELECT count(*) FROM edge e WHERE e.o = n.o) AS arrows FROM node n GROUP BY o""")
def export_svg(spark, folder):
    layered, edges = _order_maps(spark, folder)
    boxes = M.placed(layered)
    none = layered.groupBy("repo").agg(F.lit(0).alias("omitted"))
    return E.to_svg("change", boxes, M.routed(boxes, edges), none).select(
        "repo", F.regexp_count("document", F.lit("<rect ")).cast("bigint").alias("boxes"),
        F.regexp_count("document", F.lit("<path ")).cast("bigint").alias("arrows"))


@query("export_excalidraw", ORDER_SQL + """
SELECT 'o' || o AS repo, 1 + 2 * count(*) + (SELECT count(*) FROM edge e WHERE e.o = n.o) AS elements FROM node n GROUP BY o""")
def export_excalidraw(spark, folder):
    layered, edges = _order_maps(spark, folder)
    boxes = M.placed(layered)
    none = layered.groupBy("repo").agg(F.lit(0).alias("omitted"))
    documents = E.to_excalidraw("change", boxes, M.routed(boxes, edges), none)
    return documents.select("repo", F.size(F.variant_get(
        F.try_parse_json("document"), "$.elements", "array<variant>")).cast("bigint").alias("elements"))


# ------------------------------------------------------------------------- words and JSON


@query("file_detail", """
WITH k AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n,
             count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(p) > 2 THEN p[1] || ' · ' || p[2] || ' · +' || (len(p) - 2) || ' more' ELSE array_to_string(p, ' · ') END AS detail
FROM (SELECT l_orderkey, list_filter([CASE WHEN a > 0 THEN a || ' declaration change(s)' END, CASE WHEN n > 0 THEN n || ' body change(s)' END,
  CASE WHEN r > 0 THEN r || ' symbol(s) added' END], lambda x: x IS NOT NULL) AS p FROM k)""")
def file_detail(spark, folder):
    """The lines of an order as symbol changes, in one line of words."""
    flag = F.col("l_returnflag")
    counted = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(flag == "A").alias("signature_changed"), F.count_if(flag == "N").alias("body_changed"), F.count_if(flag == "R").alias("added"))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    counts = {name: F.col(name) for name in ("signature_changed", "body_changed", "added")} | {"removed": zero}
    return counted.select("l_orderkey", detail_words(none, F.lit(False), counts, zero, zero, none, F.lit("modified")).alias("detail"))


PYTEST_SQL = """
WITH k AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS p, count(*) FILTER (event_type = 'error') AS f,
             count(*) FILTER (event_type = 'click') AS s, count(*) FILTER (event_type = 'signup') AS e FROM events GROUP BY user_id)
"""


def _test_output(spark: SparkSession, folder: str) -> DataFrame:
    """A test run per user: views passed, errors failed, clicks were skipped, sign-ups broke."""
    kind = F.col("event_type")
    counts = table(spark, folder, "events").groupBy("user_id").agg(
        F.count_if(kind == "view").alias("p"), F.count_if(kind == "error").alias("f"), F.count_if(kind == "click").alias("s"),
        F.count_if(kind == "signup").alias("e"))
    return counts.withColumn("output", F.concat(
        F.lit("==== 99 passed in 1s ====\nE   assert 3 failed\n==== "), F.col("f").cast("string"), F.lit(" failed, "), F.col("p").cast("string"),
        F.lit(" passed, "), F.col("s").cast("string"), F.lit(" skipped, "), F.col("e").cast("string"), F.lit(" errors in 2.5s ====\n")))


@query("pytest_summary", PYTEST_SQL + """
SELECT user_id, CAST(p AS INTEGER) AS passed, CAST(f + e AS INTEGER) AS failed, CAST(s AS INTEGER) AS skipped FROM k""")
def pytest_summary(spark, folder):
    return _test_output(spark, folder).withColumn("c", X.pytest_counts("output")).select("user_id", "c.*")


@query("test_run_words", PYTEST_SQL + """
SELECT user_id, 'failed: ' || p || ' passed, ' || (f + e) || ' failed, ' || s || ' skipped in 2.5s' AS words FROM k""")
def test_run_words(spark, folder):
    parsed = _test_output(spark, folder).withColumn("c", X.pytest_counts("output"))
    return parsed.select("user_id", test_run_summary(
        F.lit("failed"), F.col("c.passed"), F.col("c.failed"), F.col("c.skipped"), F.lit(2.5), F.lit(None).cast("string")).alias("words"))


@query("event_log_props", """
SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(-1 AS BIGINT) AS absent, 'none' AS not_text FROM events""")
def event_log_props(spark, folder):
    """Fields of the event log read defensively: a missing or wrongly typed one is its default."""
    document = F.try_parse_json("props")
    return table(spark, folder, "events").select(
        "event_id", X.json_value(document, "$.k", "bigint").alias("k"), X.json_value(document, "$.missing", "bigint", -1).cast("bigint").alias("absent"),
        X.json_value(document, "$.k", "string", "none").alias("not_text"))


@query("session_latest", """
SELECT role, max(conv_id) AS latest, count(*) AS turns FROM conversations GROUP BY role""")
def session_latest(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.groupBy("role").agg(F.max_by("conv_id", F.struct("conv_id", "turn")).alias("latest"), F.count("*").alias("turns"))


@query("session_urls", """
SELECT page_id, '/session/' || url_encode(url) || '/impact' AS link FROM pages""")
def session_urls(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.session_url("url", "/impact").alias("link"))


@query("clipped_text", """
SELECT doc_id, replace(replace(replace(replace(replace(CASE WHEN length(text) > 30 THEN text[:29] || '…' ELSE text END,
  '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS label FROM documents""")
def clipped_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.html_escape(X.clip("text", 30)).alias("label"))


@query("event_stamps", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS at, strftime(ts, '%Y%m%d-%H%M%S') || '-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 6) AS stamp
FROM events""")
def event_stamps(spark, folder):
    moment = F.col("ts").cast("timestamp")
    return table(spark, folder, "events").select(
        "event_id", X.iso_timestamp(moment).alias("at"), X.stamp_id(moment, F.col("event_id")).alias("stamp"))


@query("element_ids", """
SELECT p_partkey, substr(sha1('rectangle:' || p_name || p_partkey), 1, 16) AS id, CAST('0x' || substr(sha1(p_name || p_partkey), 1, 8) AS BIGINT) AS seed FROM part""")
def element_ids(spark, folder):
    key = F.concat("p_name", F.col("p_partkey").cast("string"))
    return table(spark, folder, "part").select(
        "p_partkey", X.element_id("rectangle", key).alias("id"), X.element_seed(key).alias("seed"))


# ----------------------------------------------------------------------------- artifacts


@query("baseline_restore", """
SELECT l_orderkey, CASE WHEN first_flag = 'R' THEN NULL ELSE 'b' || l_orderkey END AS baseline_id,
  CASE WHEN first_flag = 'R' THEN NULL WHEN first_flag = 'N' THEN FALSE ELSE TRUE END AS dirty,
  CASE WHEN first_flag = 'R' THEN NULL WHEN first_flag = 'N' THEN 0 ELSE n END AS tracked_changes FROM (
  SELECT l_orderkey, min(l_returnflag) AS first_flag, count(*) AS n FROM lineitem GROUP BY 1)""")
def baseline_restore(spark, folder):
    """Stored baselines: sound, with wrongly typed fields, and without their identity."""
    flag = F.col("flag")
    orders = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"), F.count("*").alias("n"))
    key = F.col("l_orderkey").cast("string")
    sound = F.to_json(F.struct(F.concat(F.lit("b"), key).alias("baseline_id"), F.lit("HEAD").alias("base_revision"),
                               F.lit(True).alias("dirty"), F.col("n").alias("tracked_changes")))
    typed = F.to_json(F.struct(F.concat(F.lit("b"), key).alias("baseline_id"), F.lit("HEAD").alias("base_revision"),
                               F.lit("yes").alias("dirty"), F.lit(True).alias("tracked_changes")))
    payload = F.when(flag == "A", sound).when(flag == "N", typed).otherwise(F.lit('{"baseline_id": 7'))
    return A.baselines(orders.withColumn("payload", payload)).select(
        "l_orderkey", "baseline.baseline_id", "baseline.dirty", "baseline.tracked_changes")


@query("intent_restore", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'related' END AS relatedness,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_name END AS tokens FROM customer""")
def intent_restore(spark, folder):
    """A stored comparison counts when its verdict is a known one; other list members are dropped."""
    customers = table(spark, folder, "customer").select("c_custkey", F.concat(
        F.lit('{"relatedness": "'), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "related").otherwise("maybe"),
        F.lit('", "tokens": ["'), "c_name", F.lit('", 7, null]}')).alias("payload"))
    return A.intents(customers).select("c_custkey", "intent.relatedness", F.array_join("intent.tokens", ",").alias("tokens"))


@query("test_run_restore", PYTEST_SQL + """
SELECT user_id, CASE WHEN f > 0 THEN 'failed' END AS status, CASE WHEN f > 0 THEN p END AS passed, CASE WHEN f > 0 THEN 0 END AS skipped FROM k""")
def test_run_restore(spark, folder):
    """A run that was not made and gives no reason is no record; a counter of the wrong type is 0."""
    counts = _test_output(spark, folder)
    payload = F.when(F.col("f") > 0, F.to_json(F.struct(F.lit("failed").alias("status"), F.col("p").alias("passed"), F.lit("3").alias("skipped")))).otherwise(
        '{"status": "not_run"}')
    return A.test_runs(counts.withColumn("payload", payload)).select("user_id", "run.status", "run.passed", "run.skipped")
