"""Queries over content: digests, blobs, fingerprints, symbol and change-set differences.

Two versions of the corpus feed most of them. A document's label decides its fate between the
versions, so every row takes part: toxic ones are removed, poor ones move (their declaration
changes), good English ones are edited, other good ones are only re-spaced, unlabelled
foreign ones are new, the rest stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.functions import paths as P
from ripplework.functions import text as X
from ripplework.functions.wording import changes_summary
from ripplework.operators import graph as G
from ripplework.operators import lines as L
from ripplework.operators import snapshot as S
from ripplework.operators import symbols as Y
from ripplework.plans.registry import query, table
from ripplework.sinks import blobs as B

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LINES = "CASE WHEN {0} = '' THEN 0 ELSE len(regexp_extract_all({0}, '\\n')) + CASE WHEN ends_with({0}, chr(10)) THEN 0 ELSE 1 END END"
NORMAL = f"trim(regexp_replace(text, '{SPACE}', ' ', 'g'))"

FATES_SQL = f"""
doc AS (
  SELECT d.doc_id, d.text, d.lang, d.source,
    CASE WHEN l.toxic = 1 THEN 'removed' WHEN l.quality = 0 THEN 'signature'
         WHEN l.quality = 1 AND d.lang = 'en' THEN 'body' WHEN l.quality = 1 THEN 'spacing'
         WHEN d.lang <> 'en' THEN 'added' ELSE 'kept' END AS fate
  FROM documents d LEFT JOIN labels l USING (doc_id)),
old AS (
  SELECT 'corpus/' || source || '.txt' AS path, 'd' || doc_id AS qualified_name, text, lang,
         source AS home FROM doc WHERE fate <> 'added'),
new AS (
  SELECT 'corpus/' || source || '.txt' AS path, 'd' || doc_id AS qualified_name,
         CASE fate WHEN 'body' THEN text || ' edited' WHEN 'spacing' THEN replace(text, ' ', '  ')
              ELSE text END AS text,
         lang, CASE fate WHEN 'signature' THEN source || '_v2' ELSE source END AS home
  FROM doc WHERE fate <> 'removed'),
old_s AS (
  SELECT path, qualified_name, sha256(concat_ws(chr(31), lang, home)) AS sig,
         sha256({NORMAL}) AS body FROM old),
new_s AS (
  SELECT path, qualified_name, sha256(concat_ws(chr(31), lang, home)) AS sig,
         sha256({NORMAL}) AS body FROM new),
moved AS (
  SELECT coalesce(n.path, o.path) AS path, coalesce(n.qualified_name, o.qualified_name) AS qualified_name,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
         WHEN o.sig <> n.sig THEN 'signature_changed' WHEN o.body <> n.body THEN 'body_changed' END AS change
  FROM old_s o FULL JOIN new_s n ON o.path = n.path AND o.qualified_name = n.qualified_name)
"""


def fate(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    quality, toxic, lang = F.col("quality"), F.col("toxic"), F.col("lang")
    return table(spark, folder, "documents").join(labels, "doc_id", "left").select(
        "doc_id", "text", "lang", "source",
        F.when(toxic == 1, "removed").when(quality == 0, "signature")
        .when((quality == 1) & (lang == "en"), "body").when(quality == 1, "spacing")
        .when(lang != "en", "added").otherwise("kept").alias("fate"))


def _as_symbols(documents: DataFrame, text: Column, home: Column) -> DataFrame:
    return documents.select(
        F.lit("corpus").alias("repo"), F.concat(F.lit("corpus/"), "source", F.lit(".txt")).alias("path"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("qualified_name"),
        F.lit("function").alias("kind"), F.lit(None).cast("int").alias("line_start"),
        F.lit(None).cast("int").alias("line_end"), F.lit("").alias("signature"),
        X.fingerprint(F.col("lang"), home).alias("signature_fingerprint"),
        X.fingerprint(X.normalise_whitespace(text)).alias("body_fingerprint"),
        F.lit(1).alias("occurrences"))


def versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The corpus as symbols, before and after."""
    documents = fate(spark, folder)
    kept = F.col("text")
    edited = F.when(F.col("fate") == "body", F.concat(kept, F.lit(" edited"))).when(
        F.col("fate") == "spacing", F.replace(kept, F.lit(" "), F.lit("  "))).otherwise(kept)
    home = F.when(F.col("fate") == "signature", F.concat("source", F.lit("_v2"))).otherwise(F.col("source"))
    return (_as_symbols(documents.where("fate <> 'added'"), kept, F.col("source")),
            _as_symbols(documents.where("fate <> 'removed'"), edited, home))


def corpus_changes(spark: SparkSession, folder: str) -> DataFrame:
    before, after = versions(spark, folder)
    return Y.diff_symbols(before, after)


# ----------------------------------------------------------------------- digests and blobs


@query("content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.digest("text").alias("digest"))


@query("blob_store_dedupe", """
SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1""")
def blob_store_dedupe(spark, folder):
    documents = table(spark, folder, "documents").select(
        "doc_id", X.digest("text").alias("digest"))
    return documents.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("blob_shards", """
SELECT substr(sha256(text), 1, 2) AS shard, count(DISTINCT sha256(text)) AS blobs FROM documents GROUP BY 1""")
def blob_shards(spark, folder):
    contents = table(spark, folder, "documents").select(F.col("text").alias("content"))
    return B.as_blobs(contents).groupBy("shard").agg(F.count("*").alias("blobs"))


@query("binary_sniff", """
SELECT page_id, regexp_matches(substr(hex(encode(html)), 1, 16000), '^(?:..)*?00') AS is_binary FROM pages""")
def binary_sniff(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.looks_binary("html").alias("is_binary"))


@query("normalised_fingerprint", f"""
SELECT doc_id, substr(sha256({NORMAL}), 1, 16) AS fingerprint FROM documents""")
def normalised_fingerprint(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.fingerprint(X.normalise_whitespace("text")).alias("fingerprint"))


# ------------------------------------------------------------------------- symbol diffs


@query("symbol_diff", f"WITH {FATES_SQL} SELECT path, qualified_name, change FROM moved WHERE change IS NOT NULL")
def symbol_diff(spark, folder):
    return corpus_changes(spark, folder).select("path", "qualified_name", "change")


@query("symbol_totals", f"""
WITH {FATES_SQL} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
  count(*) FILTER (change = 'signature_changed') AS signature_changed,
  count(*) FILTER (change = 'body_changed') AS body_changed FROM moved""")
def symbol_totals(spark, folder):
    return Y.symbol_totals(corpus_changes(spark, folder)).drop("repo")


@query("symbol_report", f"""
WITH {FATES_SQL} SELECT path, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
  count(*) FILTER (change = 'signature_changed') AS signature_changed,
  count(*) FILTER (change = 'body_changed') AS body_changed
FROM moved WHERE change IS NOT NULL GROUP BY path""")
def symbol_report(spark, folder):
    before, after = versions(spark, folder)
    files = before.select("repo", "path").union(after.select("repo", "path")).distinct().withColumn(
        "parse_error", F.lit(None).cast("string"))
    no_imports = spark.createDataFrame([], "repo string, path string, added bigint, removed bigint")
    return Y.symbol_report(files, Y.diff_symbols(before, after), no_imports).select(
        "path", "added", "removed", "signature_changed", "body_changed")


@query("import_diff", """
WITH link AS (
  SELECT 'p' || l_partkey AS path, 'supplier.s' || l_suppkey AS rendered, l_linestatus FROM lineitem),
b AS (SELECT DISTINCT path, rendered FROM link WHERE l_linestatus = 'F'),
a AS (SELECT DISTINCT path, rendered FROM link WHERE l_linestatus = 'O')
SELECT path, rendered, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT path, rendered, 'removed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def import_diff(spark, folder):
    """Suppliers a part began or stopped using: shipped lines are before, open lines after."""
    imports = table(spark, folder, "lineitem").select(
        F.lit("trade").alias("repo"), F.concat(F.lit("p"), "l_partkey").alias("path"),
        F.lit("supplier").alias("module"), F.concat(F.lit("s"), "l_suppkey").alias("name"),
        F.lit(0).alias("level"), "l_linestatus")
    return Y.diff_imports(imports.where("l_linestatus = 'F'"), imports.where("l_linestatus = 'O'")).drop("repo")


# ---------------------------------------------------------------------------- change sets

def _file_frames(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The corpus as a working tree: labelled documents were dirty, unlabelled ones are not tracked."""
    labels = table(spark, folder, "labels")
    secret = F.when(F.col("lang") == "de", ".pem").otherwise(".md")
    documents = table(spark, folder, "documents").join(labels, "doc_id", "left").select(
        F.lit("corpus").alias("repo"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), secret).alias("path"), "text", "lang",
        "quality", "toxic")
    labelled = documents.where("quality is not null")
    absent = F.col("toxic") == 1
    hidden = P.is_secret("path")
    stored = ~absent & ~hidden
    captured = labelled.select(
        "repo", "path", F.length("text").cast("bigint").alias("size"), F.lit(True).alias("tracked"),
        F.when(stored, X.digest("text")).alias("digest"),
        F.when(~absent & hidden, "sensitive path").alias("withheld_reason"), absent.alias("absent"))
    blobs = labelled.where(stored).groupBy(X.digest("text").alias("digest")).agg(F.first("text").alias("content"))
    # Now: poor documents are gone, English ones end in one more line, the rest are as they were.
    current = documents.where("quality is null or quality <> 0").select(
        "repo", "path",
        F.when(F.col("quality").isNotNull() & (F.col("lang") == "en"), F.concat("text", F.lit("\nedited")))
        .otherwise(F.col("text")).alias("content"),
        F.length("text").cast("bigint").alias("size"))
    committed = labelled.select(
        "repo", "path", F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("text")).alias("content"))
    untracked = documents.where("quality is null").select("repo", "path")
    return {"captured": captured, "blobs": blobs, "current": current, "committed": committed, "untracked": untracked}


SESSION_SQL = f"""
WITH doc AS (
  SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic, d.lang = 'de' AS secret,
         'docs/' || d.doc_id || CASE WHEN d.lang = 'de' THEN '.pem' ELSE '.md' END AS path,
         {LINES.format('d.text')} AS n
  FROM documents d LEFT JOIN labels l USING (doc_id)),
files AS (
  SELECT path,
    CASE WHEN quality IS NULL THEN 'added'
         WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'added' END
         WHEN secret THEN NULL
         WHEN quality = 0 THEN 'deleted'
         WHEN lang = 'en' THEN 'modified' END AS status,
    CASE WHEN secret THEN NULL WHEN quality IS NULL THEN n
         WHEN toxic = 1 AND quality = 1 THEN n + CASE WHEN lang = 'en' THEN CASE WHEN ends_with(text, chr(10)) THEN 2 ELSE 1 END ELSE 0 END
         WHEN quality = 0 THEN NULL
         WHEN lang = 'en' THEN CASE WHEN ends_with(text, chr(10)) THEN 2 ELSE 1 END END AS insertions,
    CASE WHEN secret OR quality = 0 THEN NULL ELSE 0 END AS deletions,
    quality IS NOT NULL AS tracked, secret AS contents_withheld,
    CASE WHEN secret THEN 'sensitive path' END AS note
  FROM doc),
session AS (SELECT * FROM files WHERE status IS NOT NULL)
"""


def _session(spark: SparkSession, folder: str) -> DataFrame:
    frames = _file_frames(spark, folder)
    none = spark.createDataFrame([], "repo string, path string, status string, original_path string, insertions int, "
                                     "deletions int, binary boolean, tracked boolean, contents_withheld boolean, note string")
    return S.collect_changes(none, frames["captured"], frames["blobs"], frames["current"], frames["untracked"])


@query("change_status", SESSION_SQL + """
SELECT path, status, CAST(insertions AS BIGINT) AS insertions, CAST(deletions AS BIGINT) AS deletions, tracked,
       contents_withheld, note FROM session""")
def change_status(spark, folder):
    return _session(spark, folder).select(
        "path", "status", F.col("insertions").cast("bigint").alias("insertions"),
        F.col("deletions").cast("bigint").alias("deletions"), "tracked", "contents_withheld", "note")


@query("changeset_totals", SESSION_SQL + """
SELECT count(*) AS files, CAST(sum(coalesce(insertions, 0)) AS BIGINT) AS insertions,
  CAST(sum(coalesce(deletions, 0)) AS BIGINT) AS deletions,
  CAST(sum(coalesce(insertions + deletions, 0)) AS BIGINT) AS changed_lines,
  count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified,
  count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (contents_withheld) AS withheld FROM session""")
def changeset_totals(spark, folder):
    return S.totals(_session(spark, folder)).select(
        "files", "insertions", "deletions", "changed_lines", "added", "modified", "deleted", "withheld")


@query("change_summary", SESSION_SQL + """
SELECT count(*) || ' file(s), +' || sum(coalesce(insertions, 0)) || '/-' || sum(coalesce(deletions, 0))
  || ' line(s), 0 pre-existing' AS summary FROM session""")
def change_summary(spark, folder):
    totals = S.totals(_session(spark, folder))
    return totals.select(changes_summary(
        F.col("files"), F.col("insertions"), F.col("deletions"), F.lit(0)).alias("summary"))


@query("pre_existing_split", f"""
WITH doc AS (
  SELECT d.text, d.lang, l.toxic, d.lang = 'de' AS secret,
         'docs/' || d.doc_id || CASE WHEN d.lang = 'de' THEN '.pem' ELSE '.md' END AS path,
         {LINES.format('d.text')} AS n
  FROM documents d JOIN labels l USING (doc_id))
SELECT path, CASE WHEN toxic = 1 THEN 'deleted' ELSE 'modified' END AS status,
  CASE WHEN toxic = 1 OR secret THEN NULL ELSE n END AS insertions,
  CASE WHEN toxic = 1 OR secret THEN NULL ELSE 0 END AS deletions,
  CASE WHEN toxic = 1 THEN 'deleted before this session began' WHEN secret THEN 'sensitive path' END AS note
FROM doc WHERE toxic = 1 OR secret OR (lang = 'fr' AND n > 0)""")
def pre_existing_split(spark, folder):
    """What was already different when the session began: French documents are empty at the commit."""
    frames = _file_frames(spark, folder)
    return S.pre_existing_changes(frames["captured"], frames["blobs"], frames["committed"]).select(
        "path", "status", F.col("insertions").cast("bigint").alias("insertions"),
        F.col("deletions").cast("bigint").alias("deletions"), "note")


@query("baseline_source", """
SELECT 'docs/' || doc_id || CASE WHEN lang = 'de' THEN '.pem' ELSE '.md' END AS path,
  CASE WHEN toxic = 1 OR lang = 'de' THEN NULL ELSE sha256(text) END AS digest
FROM documents JOIN labels USING (doc_id)""")
def baseline_source(spark, folder):
    frames = _file_frames(spark, folder)
    paths = frames["captured"].select("repo", "path")
    return S.baseline_source(paths, frames["captured"], frames["blobs"], frames["committed"]).select(
        "path", X.digest("content").alias("digest"))


@query("withheld_files", """
SELECT 'docs/' || doc_id || '.pem' AS path, 'sensitive path' AS reason
FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'de' AND NOT (coalesce(toxic, 0) = 1 AND quality = 0)""")
def withheld_files(spark, folder):
    frames = _file_frames(spark, folder)
    return S.withheld_files(frames["captured"], _session(spark, folder)).select("path", "reason")


@query("baseline_capture", """
SELECT 'docs/' || doc_id || CASE WHEN lang = 'de' THEN '.pem' ELSE '.md' END AS path, length(text) AS size,
  CASE WHEN lang = 'de' OR length(text) > 5000 THEN NULL ELSE sha256(text) END AS digest,
  CASE WHEN lang = 'de' THEN 'sensitive path' WHEN length(text) > 5000 THEN 'exceeds analysis.max_file_size_mb' END AS withheld_reason,
  FALSE AS absent FROM documents""")
def baseline_capture(spark, folder):
    """Capture the whole corpus as a dirty tree with a 5 000 character size policy."""
    documents = table(spark, folder, "documents").select(
        F.lit("corpus").alias("repo"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"),
                 F.when(F.col("lang") == "de", ".pem").otherwise(".md")).alias("path"),
        F.col("text").alias("content"), F.length("text").alias("size"))
    entries = documents.select("repo", "path", F.lit("changed").alias("kind"))
    captured, _ = S.capture(entries, documents, limit=5000)
    return captured.select("path", "size", "digest", "withheld_reason", "absent")


@query("departed_paths", """
WITH o AS (SELECT o_orderkey, o_orderstatus FROM orders)
SELECT 'orders/o' || o_orderkey || '.py' AS path FROM o WHERE o_orderstatus = 'F'
UNION SELECT 'drafts/o' || o_orderkey || '.py' FROM o WHERE o_orderstatus = 'P'""")
def departed_paths(spark, folder):
    """Finished orders are deleted, pending ones are renamed out of the drafts folder."""
    key = F.col("o_orderkey").cast("string")
    changed = table(spark, folder, "orders").select(
        F.lit("trade").alias("repo"), F.concat(F.lit("orders/o"), key, F.lit(".py")).alias("path"),
        F.when(F.col("o_orderstatus") == "F", "deleted").when(F.col("o_orderstatus") == "P", "renamed")
        .otherwise("modified").alias("status"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("drafts/o"), key, F.lit(".py"))).alias("original_path"))
    return G.departed_paths(changed).select("path")


@query("line_delta_append", f"""
SELECT doc_id, {LINES.format("text || chr(10) || lang || chr(10) || source")} - CASE WHEN ends_with(text, chr(10))
  THEN {LINES.format('text')} ELSE {LINES.format('text')} END AS insertions, 0 AS deletions FROM documents""")
def line_delta_append(spark, folder):
    """Two lines appended to every document that ends a line first."""
    documents = table(spark, folder, "documents").select(
        "doc_id", F.concat("text", F.lit("\n")).alias("then"),
        F.concat("text", F.lit("\n"), "lang", F.lit("\n"), "source").alias("now"))
    return L.with_line_counts(documents, "then", "now").select(
        "doc_id", F.col("insertions").cast("bigint").alias("insertions"), F.col("deletions").cast("int").alias("deletions"))


@query("line_delta_difflib")
def line_delta_difflib(spark, folder):
    """Line deltas between consecutive turns of a conversation; difflib has no SQL form."""
    turns = table(spark, folder, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("now"))
    pairs = turns.select("conv_id", "turn", F.col("text").alias("then")).join(following, ["conv_id", "turn"])
    return L.with_line_counts(pairs, "then", "now").select("conv_id", "turn", "insertions", "deletions", "binary")


@query("file_diff")
def file_diff(spark, folder):
    """Unified diffs between consecutive turns, with their status and drift flag."""
    turns = table(spark, folder, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    pairs = turns.select("conv_id", "turn", "role", F.col("text").alias("before")).join(following, ["conv_id", "turn"])
    frame = pairs.select(
        F.col("conv_id").cast("string").alias("repo"), F.concat("role", F.lit("/"), F.col("turn").cast("string")).alias("path"),
        "before", "after", (F.col("role") == "system").alias("withheld"), F.lit(False).alias("too_large"),
        X.digest("before").alias("recorded_digest"))
    return L.file_diff(frame).select(
        "repo", "path", "status", "drifted", F.size("lines").alias("lines"), "truncated")
