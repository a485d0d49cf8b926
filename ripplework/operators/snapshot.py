"""Baselines and change sets: what changed during a session, and what already had.

Relations
    captured     repo, path, size, tracked, digest, withheld_reason, absent
    blobs        digest, content
    committed    repo, path, content                 content at the base commit
    current      repo, path, content, size           content now; NULL where it was not read
    git_changes  repo, path, status, original_path, insertions, deletions, counted
    untracked    repo, path                          untracked paths of the final state
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework import model
from ripplework.functions import paths as P
from ripplework.functions.text import digest
from ripplework.operators.lines import with_line_counts

CHANGE = ["repo", "path", "status", "original_path", "insertions", "deletions", "binary", "tracked",
          "contents_withheld", "note"]


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def withheld_reason(path: Column, size: Column, content: Column, globs: Sequence[str], limit: int) -> Column:
    """Why content is not read: sensitive, too large, unreadable; NULL when it is."""
    return (
        F.when(P.is_secret(path, globs), model.NOTE_SENSITIVE)
        .when(size > limit, model.NOTE_TOO_LARGE)
        .when(content.isNull(), model.NOTE_UNREADABLE))


def capture(entries: DataFrame, current: DataFrame, globs: Sequence[str] = P.SECRET_GLOBS,
            limit: int = model.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The baseline of a dirty tree: captured rows, and the blobs they refer to.

    *entries* is (repo, path, kind) off the status scan; only dirty or untracked paths are
    captured, everything else is the commit itself.
    """
    tracked = F.col("kind") != "untracked"
    seen = current.withColumn("there", F.lit(True))
    joined = entries.join(seen, ["repo", "path"], "left")
    absent = F.col("there").isNull()
    reason = F.when(~absent, withheld_reason(F.col("path"), F.col("size"), F.col("content"), globs, limit))
    captured = joined.select(
        "repo", "path", F.when(~absent, F.col("size")).cast("bigint").alias("size"), tracked.alias("tracked"),
        F.when(~absent & reason.isNull(), digest("content")).alias("digest"),
        reason.alias("withheld_reason"), absent.alias("absent"), "content")
    blobs = captured.where("digest is not null").groupBy("digest").agg(F.first("content").alias("content"))
    return captured.drop("content"), blobs


def git_changes(name_status: DataFrame, numstat: DataFrame, globs: Sequence[str] = P.SECRET_GLOBS) -> DataFrame:
    """Changes git reports, with its line counts where it gave any."""
    counts = numstat.select("repo", "path", "insertions", "deletions", F.lit(True).alias("counted"))
    joined = name_status.join(counts, ["repo", "path"], "left")
    counted = F.coalesce("counted", F.lit(False))
    return joined.select(
        "repo", "path", "status", "original_path", "insertions", "deletions",
        (counted & F.col("insertions").isNull()).alias("binary"), F.lit(True).alias("tracked"),
        P.is_secret("path", globs).alias("contents_withheld"),
        F.when(~counted, model.NOTE_NO_COUNTS).alias("note"))


def snapshot_changes(captured: DataFrame, blobs: DataFrame, current: DataFrame,
                     globs: Sequence[str] = P.SECRET_GLOBS, limit: int = model.MAX_FILE_BYTES) -> DataFrame:
    """What the session did to files that were already dirty when it began."""
    seen = current.select("repo", "path", F.col("content").alias("now"), F.col("size").alias("size_now"),
                          F.lit(True).alias("there"))
    stored = blobs.select("digest", F.col("content").alias("then"))
    joined = captured.join(seen, ["repo", "path"], "left").join(stored, "digest", "left")
    sensitive = P.is_secret("path", globs)
    there = F.coalesce("there", F.lit(False))
    withheld = F.when(there & (F.col("size_now") > limit), model.NOTE_TOO_LARGE).when(
        there & F.col("now").isNull(), model.NOTE_UNREADABLE)
    readable = there & withheld.isNull()
    verdict = (
        F.when(F.col("absent") & ~readable, "drop")
        .when(F.col("absent") & sensitive, "sensitive_added")
        .when(F.col("absent"), "added")
        .when(sensitive, "drop")
        .when(withheld.isNotNull(), "withheld")
        .when(~there, "deleted")
        .when(F.col("then").isNull(), "unknown_before")
        .otherwise("compare"))
    ruled = joined.withColumn("withheld", withheld).withColumn("verdict", verdict).where("verdict <> 'drop'")
    plain = ruled.where("verdict not in ('added', 'compare')").select(
        "repo", "path",
        F.when(F.col("verdict") == "sensitive_added", "added").when(F.col("verdict") == "deleted", "deleted")
        .otherwise("modified").alias("status"),
        _null("string").alias("original_path"), _null("int").alias("insertions"), _null("int").alias("deletions"),
        F.lit(False).alias("binary"), "tracked", (F.col("verdict") == "sensitive_added").alias("contents_withheld"),
        F.when(F.col("verdict") == "sensitive_added", model.NOTE_SENSITIVE)
        .when(F.col("verdict") == "withheld", F.col("withheld"))
        .when(F.col("verdict") == "unknown_before", model.NOTE_NO_BASELINE).alias("note"))
    # A file that was absent has no stored content, so both cases compare what is there.
    compared = with_line_counts(
        ruled.where("verdict in ('added', 'compare')").select("repo", "path", "tracked", "absent", "then", "now"), "then", "now")
    moved = compared.where("absent or binary or insertions + deletions > 0")
    return plain.unionByName(moved.select(
        "repo", "path", F.when(F.col("absent"), "added").otherwise("modified").alias("status"),
        _null("string").alias("original_path"), "insertions", "deletions", "binary", "tracked",
        F.lit(False).alias("contents_withheld"), _null("string").alias("note")))


def untracked_changes(untracked: DataFrame, captured: DataFrame, current: DataFrame,
                      globs: Sequence[str] = P.SECRET_GLOBS, limit: int = model.MAX_FILE_BYTES) -> DataFrame:
    """Files that appeared during the session and that git does not track."""
    fresh = untracked.join(captured.select("repo", "path"), ["repo", "path"], "left_anti").join(
        current.select("repo", "path", F.col("content").alias("now"), "size", F.lit(True).alias("there")),
        ["repo", "path"], "left")
    sensitive = P.is_secret("path", globs)
    withheld = F.when(F.col("there") & (F.col("size") > limit), model.NOTE_TOO_LARGE).when(
        F.col("there") & F.col("now").isNull(), model.NOTE_UNREADABLE)
    ruled = fresh.withColumn("note", F.when(sensitive, model.NOTE_SENSITIVE).otherwise(withheld)).where(
        F.col("note").isNotNull() | F.col("there"))
    plain = ruled.where("note is not null").select(
        "repo", "path", _null("int").alias("insertions"), _null("int").alias("deletions"),
        F.lit(False).alias("binary"), "note")
    counted = with_line_counts(
        ruled.where("note is null").select("repo", "path", "now", F.lit("").alias("then"), "note"), "then", "now")
    return plain.unionByName(counted.select(plain.columns)).select(
        "repo", "path", F.lit("added").alias("status"), _null("string").alias("original_path"), "insertions",
        "deletions", "binary", F.lit(False).alias("tracked"),
        (F.coalesce("note", F.lit("")) == model.NOTE_SENSITIVE).alias("contents_withheld"), "note")


def by_provenance(*sources: DataFrame) -> DataFrame:
    """One change per path: a later source overrides an earlier one."""
    ranked = None
    for priority, source in enumerate(sources):
        tagged = source.withColumn("priority", F.lit(priority))
        ranked = tagged if ranked is None else ranked.unionByName(tagged)
    rest = [name for name in ranked.columns if name not in ("repo", "path", "priority")]
    return ranked.groupBy("repo", "path").agg(F.max_by(F.struct(*rest), "priority").alias("c")).select(
        "repo", "path", "c.*")


def collect_changes(changes: DataFrame, captured: DataFrame, blobs: DataFrame, current: DataFrame,
                    untracked: DataFrame, globs: Sequence[str] = P.SECRET_GLOBS,
                    limit: int = model.MAX_FILE_BYTES) -> DataFrame:
    """The session's change set: git's view, then the snapshots', then new untracked files."""
    from_git = changes.join(captured.select("repo", "path"), ["repo", "path"], "left_anti")
    return by_provenance(
        from_git.select(CHANGE),
        snapshot_changes(captured, blobs, current, globs, limit).select(CHANGE),
        untracked_changes(untracked, captured, current, globs, limit).select(CHANGE))


def pre_existing_changes(captured: DataFrame, blobs: DataFrame, committed: DataFrame) -> DataFrame:
    """Modifications present when the session began: commit to snapshot, never to the tree."""
    joined = captured.where("tracked").join(
        blobs.select("digest", F.col("content").alias("then")), "digest", "left").join(
        committed.select("repo", "path", F.col("content").alias("base")), ["repo", "path"], "left")
    verdict = (
        F.when(F.col("absent"), "absent").when(F.col("digest").isNull(), "withheld")
        .when(F.col("base").isNull() | F.col("then").isNull(), "unknown").otherwise("compare"))
    ruled = joined.withColumn("verdict", verdict)
    plain = ruled.where("verdict <> 'compare'").select(
        "repo", "path", F.when(F.col("verdict") == "absent", "deleted").otherwise("modified").alias("status"),
        _null("string").alias("original_path"), _null("int").alias("insertions"), _null("int").alias("deletions"),
        F.lit(False).alias("binary"), F.lit(True).alias("tracked"),
        ((F.col("verdict") == "withheld") & (F.coalesce("withheld_reason", F.lit("")) == model.NOTE_SENSITIVE))
        .alias("contents_withheld"),
        F.when(F.col("verdict") == "absent", model.NOTE_ABSENT_AT_BASELINE)
        .when(F.col("verdict") == "withheld", F.coalesce("withheld_reason", F.lit(model.NOTE_NO_BASELINE)))
        .otherwise(model.NOTE_PRE_EXISTING_NO_COUNTS).alias("note"))
    compared = with_line_counts(ruled.where("verdict = 'compare'").select("repo", "path", "base", "then"), "base", "then")
    moved = compared.where("binary or insertions + deletions > 0").select(
        "repo", "path", F.lit("modified").alias("status"), _null("string").alias("original_path"), "insertions",
        "deletions", "binary", F.lit(True).alias("tracked"), F.lit(False).alias("contents_withheld"),
        _null("string").alias("note"))
    return plain.unionByName(moved)


def baseline_source(paths: DataFrame, captured: DataFrame, blobs: DataFrame, committed: DataFrame) -> DataFrame:
    """Content before the session: the snapshot, nothing when it was withheld, else the commit."""
    taken = captured.join(blobs.select("digest", F.col("content").alias("then")), "digest", "left").select(
        "repo", "path", "then", F.lit(True).alias("was_captured"))
    return paths.join(taken, ["repo", "path"], "left").join(
        committed.select("repo", "path", F.col("content").alias("base")), ["repo", "path"], "left").select(
        *paths.columns, F.when(F.col("was_captured"), F.col("then")).otherwise(F.col("base")).alias("content"))


def totals(files: DataFrame) -> DataFrame:
    """Change-set totals; an unknown count adds nothing to a sum."""
    return files.groupBy("repo").agg(
        F.count("*").alias("files"),
        F.sum(F.coalesce("insertions", F.lit(0))).cast("bigint").alias("insertions"),
        F.sum(F.coalesce("deletions", F.lit(0))).cast("bigint").alias("deletions"),
        F.sum(F.coalesce(F.col("insertions") + F.col("deletions"), F.lit(0))).cast("bigint").alias("changed_lines"),
        *[F.count_if(F.col("status") == name).alias(name) for name in model.CHANGE_STATUSES],
        F.count_if("contents_withheld").alias("withheld"))


def withheld_files(captured: DataFrame, files: DataFrame) -> DataFrame:
    """Files that were not read, off the baseline and the change set; the baseline's word wins."""
    return by_provenance(
        files.where("contents_withheld").select("repo", "path", F.coalesce("note", F.lit(model.NOTE_SENSITIVE)).alias("reason")),
        captured.where("withheld_reason is not null").select("repo", "path", F.col("withheld_reason").alias("reason")))


def entry_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("repo").agg(
        F.count_if(F.col("kind") != "untracked").alias("tracked_changes"),
        F.count_if(F.col("kind") == "untracked").alias("untracked_files"))
