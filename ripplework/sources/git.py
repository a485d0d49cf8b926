"""Git output as relations. Git itself runs where the repository is; parsing is Spark's.

Each ``-z`` format is a sequence of NUL-ended fields in which a rename takes one field more.
One expression per format consumes a whole record at a time, so a path that looks like a
status letter can never be mistaken for one.
"""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework import model

TIMEOUT = 30
FIELD = "[^\\x00]*\\x00"


class GitError(RuntimeError):
    """Git is missing, took too long or said no."""


def run_git(root: str | Path, *arguments: str, check: bool = True) -> str:
    try:
        done = subprocess.run(["git", *arguments], cwd=root, capture_output=True, timeout=TIMEOUT, check=False)
    except (OSError, subprocess.TimeoutExpired) as problem:
        raise GitError(str(problem)) from problem
    if check and done.returncode:
        raise GitError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout.decode("utf-8", "surrogateescape") if done.returncode == 0 else ""


def discover(path: str | Path) -> Path | None:
    """The top of the repository around *path*; None outside of one."""
    try:
        top = run_git(path, "rev-parse", "--show-toplevel").strip()
    except GitError:
        return None
    return Path(top) if top else None


def head_commit(root: str | Path) -> str | None:
    return run_git(root, "rev-parse", "--verify", "HEAD", check=False).strip() or None


def is_busy(root: str | Path) -> bool:
    git_dir = run_git(root, "rev-parse", "--git-dir", check=False).strip() or ".git"
    return (Path(root) / git_dir / "index.lock").exists()


def status_text(root: str | Path) -> str:
    return run_git(root, "status", "--porcelain=v2", "-z", "--untracked-files=all", "--branch")


def listed_paths(root: str | Path) -> list[str]:
    """Tracked and untracked files that are still there."""
    found = {p.replace("\\", "/").strip("/") for p in run_git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z").split("\0") if p}
    return sorted(p for p in found if (Path(root) / p).is_file())


def committed_content(root: str | Path, revision: str, path: str) -> bytes | None:
    try:
        done = subprocess.run(["git", "show", f"{revision}:{path}"], cwd=root, capture_output=True, timeout=TIMEOUT, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


# -------------------------------------------------------------------------------- parsing


def _records(raw: Column, pattern: str) -> Column:
    """Whole records of *raw*; an output that lost its last NUL is still read."""
    ended = F.when(raw.endswith("\x00") | (raw == ""), raw).otherwise(F.concat(raw, F.lit("\x00")))
    return F.regexp_extract_all(ended, F.lit(pattern), F.lit(0))


def _path(value: Column) -> Column:
    return F.replace(value, F.lit("\\"), F.lit("/"))


def parse_status(raw: DataFrame) -> DataFrame:
    """(repo, pos, kind, path, original_path) off ``status --porcelain=v2 -z`` text in ``output``."""
    records = _records(F.col("output"), f"2 {FIELD}{FIELD}|[^\\x00]+\\x00")
    parts = F.split("record", "\\x00")
    head = F.get(parts, F.lit(0))

    def after(spaces: int) -> Column:
        return F.regexp_extract(head, f"(?s)^(?:\\S+ ){{{spaces}}}(.*)$", 1)

    kind = (
        F.when(head.startswith("1 "), "changed").when(head.startswith("2 "), "renamed").when(head.startswith("u "), "unmerged")
        .when(head.startswith("? "), "untracked"))
    path = F.when(kind == "changed", after(8)).when(kind == "renamed", after(9)).when(kind == "unmerged", after(10)).otherwise(after(1))
    return raw.select("repo", F.posexplode(records).alias("pos", "record")).select(
        "repo", "pos", kind.alias("kind"), _path(path).alias("path"),
        F.when(kind == "renamed", _path(F.get(parts, F.lit(1)))).alias("original_path")).where("kind is not null and path <> ''")


def branch_oid(raw: DataFrame) -> DataFrame:
    """(repo, head_oid): NULL before the first commit."""
    oid = F.regexp_extract("output", "(?:^|\\x00)# branch\\.oid ([^\\x00]*)", 1)
    return raw.select("repo", F.when(~oid.isin("", "(initial)"), oid).alias("head_oid"))


def parse_name_status(raw: DataFrame) -> DataFrame:
    """(repo, pos, path, status, original_path) off ``diff --name-status -z`` text."""
    records = _records(F.col("output"), f"[RC][^\\x00]*\\x00{FIELD}{FIELD}|[^\\x00]+\\x00{FIELD}")
    parts = F.split("record", "\\x00")
    code = F.substring(F.get(parts, F.lit(0)), 1, 1)
    names = F.create_map(*[F.lit(x) for pair in model.STATUS_BY_CODE.items() for x in pair])
    moved = code.isin("R", "C")
    return raw.select("repo", F.posexplode(records).alias("pos", "record")).select(
        "repo", "pos", F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"),
        F.coalesce(F.try_element_at(names, code), F.lit("unknown")).alias("status"),
        F.when(moved, F.get(parts, F.lit(1))).alias("original_path"))


def parse_numstat(raw: DataFrame) -> DataFrame:
    """(repo, path, insertions, deletions) off ``diff --numstat -z`` text; ``-`` is NULL."""
    records = _records(F.col("output"), f"[^\\x00\\t]*\\t[^\\x00\\t]*\\t\\x00{FIELD}{FIELD}|[^\\x00]+\\x00")
    parts = F.split("record", "\\x00")
    cells = F.split(F.get(parts, F.lit(0)), "\\t", 3)
    path = F.when(F.get(cells, F.lit(2)) == "", F.get(parts, F.lit(2))).otherwise(F.get(cells, F.lit(2)))
    listed = raw.select("repo", F.posexplode(records).alias("pos", "record")).where(F.size(cells) == 3).select(
        "repo", "pos", path.alias("path"),
        F.get(cells, F.lit(0)).try_cast("int").alias("insertions"), F.get(cells, F.lit(1)).try_cast("int").alias("deletions"))
    return listed.where("path <> ''").groupBy("repo", "path").agg(F.max_by(F.struct("insertions", "deletions"), "pos").alias("c")).select(
        "repo", "path", "c.*")


def state_token(head_oid: Column, entries: Column, stat_signature: Column) -> Column:
    """A fingerprint of a working tree: commit, entries in order, sizes and times."""
    shown = F.transform(entries, lambda e: F.concat_ws("\x00", e["kind"], e["path"], F.coalesce(e["original_path"], F.lit(""))))
    return F.sha2(F.concat_ws("\x00", F.coalesce(head_oid, F.lit("")), F.array_join(shown, "\x00"), F.coalesce(stat_signature, F.lit(""))), 256)


def stat_signature(stats: Column) -> Column:
    """One line per entry: size and nanoseconds, or that the file is missing."""
    return F.array_join(F.transform(stats, lambda s: F.concat_ws(
        ":", s["path"], F.coalesce(F.concat(s["size"].cast("string"), F.lit(":"), s["mtime_ns"].cast("string")), F.lit("missing")))), "\n")
