"""JSON artifacts read back: a wrong type is a default, a broken document is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework import model
from ripplework.functions.text import json_strings, json_value

ANALYSIS = "digest string, parse_error string, " + ", ".join(
    f"{name} array<{schema.simpleString()}>" for name, schema in (("symbols", model.SYMBOL), ("imports", model.IMPORT), ("calls", model.CALL)))


def _objects(document: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(document, path, "array<variant>"), F.array().cast("array<variant>"))


def is_object(document: Column) -> Column:
    return F.schema_of_variant(document).startswith("OBJECT")


def read_json(payload: Column | str) -> Column:
    """A document as VARIANT; absent, unreadable or not an object is NULL."""
    parsed = F.try_parse_json(payload)
    return F.when(is_object(parsed), parsed)


def baselines(artifacts: DataFrame) -> DataFrame:
    """(key..., baseline) off ``payload``; NULL unless the identifying fields are there."""
    d = read_json("payload")
    captured = F.transform(_objects(d, "$.captured"), lambda c: F.struct(
        json_value(c, "$.path", "string").alias("path"), json_value(c, "$.size", "bigint", 0).alias("size"),
        json_value(c, "$.tracked", "boolean", True).alias("tracked"), json_value(c, "$.digest", "string").alias("digest"),
        json_value(c, "$.withheld_reason", "string").alias("withheld_reason"), json_value(c, "$.absent", "boolean", False).alias("absent")))
    baseline = F.struct(
        json_value(d, "$.baseline_id", "string").alias("baseline_id"), json_value(d, "$.captured_at", "string").alias("captured_at"),
        json_value(d, "$.commit", "string").alias("commit"), json_value(d, "$.base_revision", "string").alias("base_revision"),
        json_value(d, "$.dirty", "boolean", False).alias("dirty"), json_value(d, "$.tracked_changes", "bigint", 0).alias("tracked_changes"),
        json_value(d, "$.untracked_files", "bigint", 0).alias("untracked_files"),
        F.filter(captured, lambda c: c["path"].isNotNull()).alias("captured"))
    whole = json_value(d, "$.baseline_id", "string").isNotNull() & json_value(d, "$.base_revision", "string").isNotNull()
    return artifacts.withColumn("baseline", F.when(whole, baseline))


def intents(artifacts: DataFrame) -> DataFrame:
    """(key..., intent) off ``payload``; NULL unless the verdict is a known one."""
    d = read_json("payload")
    verdict = json_value(d, "$.relatedness", "string")
    intent = F.struct(
        json_value(d, "$.task", "string", "").alias("task"), verdict.alias("relatedness"), json_strings(d, "$.tokens").alias("tokens"),
        json_strings(d, "$.unmatched").alias("unmatched"), json_value(d, "$.changed_files", "bigint", 0).alias("changed_files"),
        json_strings(d, "$.notes").alias("notes"))
    return artifacts.withColumn("intent", F.when(verdict.isin(*model.RELATEDNESS), intent))


def test_runs(artifacts: DataFrame) -> DataFrame:
    """(key..., run) off ``payload``; NULL for an unknown status or a run not made without a reason."""
    d = read_json("payload")
    status, note = json_value(d, "$.status", "string"), json_value(d, "$.note", "string")
    run = F.struct(
        status.alias("status"), json_strings(d, "$.command").alias("command"), json_value(d, "$.exit_code", "bigint").alias("exit_code"),
        json_value(d, "$.passed", "bigint", 0).alias("passed"), json_value(d, "$.failed", "bigint", 0).alias("failed"),
        json_value(d, "$.skipped", "bigint", 0).alias("skipped"), json_value(d, "$.output_tail", "string").alias("output_tail"), note.alias("note"))
    known = status.isin(*model.TEST_RUN_STATUSES) & ~((status == "not_run") & note.isNull())
    return artifacts.withColumn("run", F.when(known, run))
