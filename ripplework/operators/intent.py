"""A recorded task against what a session touched.

Words meet files by equality on a key: path parts, stems, words of symbol and import names,
and four-letter grams for "inside the file name". Nothing pairs every word with every file.

Relations
    tasks   repo, task
    facts   repo, path, symbols array<string>, imports array<string>
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.functions import paths as P
from ripplework.functions.text import MIN_STEM, task_tokens, token_forms, word_parts

GRAM = MIN_STEM


def tokens(tasks: DataFrame) -> DataFrame:
    """(repo, position, token): the informative words of each task."""
    return tasks.select("repo", F.posexplode(task_tokens("task")).alias("position", "token"))


def forms(words: DataFrame) -> DataFrame:
    """(repo, token, form_position, form): the spellings each word can match under."""
    return words.select("repo", "token", F.posexplode(token_forms(F.col("token"))).alias("form_position", "form"))


def file_keys(facts: DataFrame) -> DataFrame:
    """(repo, path, form, kind_rank): every word a file answers to by equality."""
    lowered = F.lower("path")
    segments = F.array_distinct(F.split(lowered, "/"))
    path = facts.select("repo", "path", F.explode(segments).alias("form"), F.lit(0).alias("kind_rank"))
    symbols = facts.select("repo", "path", F.explode(word_parts(F.col("symbols"))).alias("form"), F.lit(1).alias("kind_rank"))
    imports = facts.select("repo", "path", F.explode(word_parts(F.col("imports"))).alias("form"), F.lit(2).alias("kind_rank"))
    return path.unionByName(symbols).unionByName(imports)


def _bare_stem():
    return F.replace(F.regexp_replace(P.leaf(F.lower("path")), "\\.[^.]*$", ""), F.lit("_"), F.lit(""))


def intent_matches(tasks: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo, path, token, kind, detail): the first way each word matches each file."""
    spelled = forms(tokens(tasks))
    equal = spelled.join(file_keys(facts), ["repo", "form"]).select(
        "repo", "path", "token",
        F.when(F.col("kind_rank") == 0, F.struct(F.col("kind_rank").alias("kind"), F.col("form_position").alias("form"), F.lit(0).alias("how")))
        .otherwise(F.struct(F.col("kind_rank").alias("kind"), F.lit(0).alias("form"), F.lit(0).alias("how"))).alias("rank"))
    grams = facts.select("repo", "path", _bare_stem().alias("stem")).where(F.length("stem") >= GRAM).select(
        "repo", "path", "stem",
        F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("stem") - GRAM + 1), lambda n: F.substring(F.col("stem"), n, F.lit(GRAM))
        ))).alias("gram"))
    inside = (
        spelled.where(F.length("form") >= GRAM).withColumn("gram", F.substring("form", 1, GRAM))
        .join(grams, ["repo", "gram"]).where(F.contains("stem", "form"))
        .select("repo", "path", "token",
                F.struct(F.lit(0).alias("kind"), F.col("form_position").alias("form"), F.lit(1).alias("how")).alias("rank")))
    best = equal.unionByName(inside).groupBy("repo", "path", "token").agg(F.min("rank").alias("rank"))
    kind = F.get(F.array(F.lit("path"), F.lit("symbol"), F.lit("import")), F.col("rank.kind"))
    detail = F.when(F.col("rank.how") == 1, F.concat("path", F.lit(" (in the file name)"))).otherwise(F.col("path"))
    return best.select("repo", "path", "token", kind.alias("kind"), detail.alias("detail"))


def file_coverage(facts: DataFrame, matches: DataFrame) -> DataFrame:
    """(repo, path, related, words): whether the task reaches each changed file."""
    per_file = matches.groupBy("repo", "path").agg(F.count("*").alias("words"))
    return facts.select("repo", "path").join(per_file, ["repo", "path"], "left").select(
        "repo", "path", F.col("words").isNotNull().alias("related"), F.coalesce("words", F.lit(0)).alias("words"))


def unmatched_tokens(tasks: DataFrame, matches: DataFrame) -> DataFrame:
    return tokens(tasks).join(matches.select("repo", "token").distinct(), ["repo", "token"], "left_anti")


def verdicts(tasks: DataFrame, facts: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Per task: relatedness, counts, and the note when nothing could be compared."""
    matches = intent_matches(tasks, facts) if matches is None else matches
    total = facts.groupBy("repo").agg(F.count("*").alias("changed_files"))
    related = matches.select("repo", "path").distinct().groupBy("repo").agg(F.count("*").alias("related_files"))
    matched = matches.select("repo", "token").distinct().groupBy("repo").agg(F.count("*").alias("matched_tokens"))
    joined = tasks.withColumn("tokens", F.size(task_tokens("task")).cast("bigint"))
    for counts in (total, related, matched):
        joined = joined.join(counts, "repo", "left")
    for name in ("changed_files", "related_files", "matched_tokens"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    relatedness = (
        F.when((F.col("changed_files") == 0) | (F.col("tokens") == 0), "not_compared")
        .when(F.col("related_files") == 0, "no_relationship")
        .when(F.col("related_files") < F.col("changed_files"), "scope_expansion")
        .otherwise("related"))
    note = F.when(F.col("changed_files") == 0,
                  "No file changed, so the task has nothing to be held against.").when(
        F.col("tokens") == 0,
        "Only filler words were found in the task. It is kept as it was written, without a verdict.")
    return joined.select(
        "repo", "task", relatedness.alias("relatedness"), "tokens", "changed_files", "related_files",
        (F.col("tokens") - F.col("matched_tokens")).alias("unmatched_tokens"), note.alias("note"))
