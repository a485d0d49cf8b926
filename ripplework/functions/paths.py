"""Path predicates, classification and path arithmetic as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplework import model
from ripplework.functions.text import col

# Names that decide what a file is.
TEST_DIRECTORIES = ("test", "tests", "__tests__")
SCRIPT_SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
DEPENDENCY_MANIFESTS = (
    "cargo.toml", "gemfile", "go.mod", "package-lock.json", "package.json", "pipfile",
    "pipfile.lock", "poetry.lock", "pyproject.toml", "requirements.txt", "setup.cfg", "setup.py",
)
CONFIGURATION_FILES = (
    ".editorconfig", ".gitignore", ".ripplework.toml", "dockerfile", "mypy.ini", "pytest.ini",
    "ruff.toml", "tox.ini",
)
CONFIGURATION_SUFFIXES = (".cfg", ".ini", ".toml", ".yaml", ".yml")
PACKAGE_MARKERS = ("__init__.py", "__init__.pyi")
TYPESCRIPT_INPUTS = (*SCRIPT_SUFFIXES, ".json")
# The documented part of the sensitive-path list; the rest is configuration.
SECRET_GLOBS = (".env", ".env.*", "*.pem", "id_rsa", ".ssh", ".aws")
DEFAULT_IGNORE = (".git", ".ripplework", "__pycache__", "*.pyc")


def _suffix_pattern(suffixes: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(suffix) for suffix in suffixes) + ")$"


def normalise(path: Column | str) -> Column:
    return F.btrim(F.replace(col(path), F.lit("\\"), F.lit("/")), F.lit("/"))


def leaf(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def directory(path: Column | str) -> Column:
    """Everything before the last slash; empty at the root."""
    value = col(path)
    return F.regexp_replace(value, "/?[^/]*$", "")


def directory_chain(path: Column | str) -> Column:
    """Every directory above *path*, outermost first."""
    parts = F.split(directory(path), "/")
    return F.when(directory(path) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    )


def fold_dots(path: Column | str) -> Column:
    """``a/./b`` and ``a/c/../b`` both become ``a/b``; leading ``..`` stay."""
    parts = F.filter(
        F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".")
    )
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, part: F.when(
            (part == "..") & (F.size(kept) > 0) & (F.get(kept, F.size(kept) - 1) != ".."),
            F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))),
        ).otherwise(F.array_append(kept, part)),
    )
    return F.array_join(folded, "/")


def is_test_path(path: Column | str) -> Column:
    normal = normalise(path)
    name = leaf(normal)
    lowered = F.lower(name)
    folders = F.split(directory(normal), "/")
    return (
        (name == "conftest.py")
        | name.startswith("test_")
        | name.endswith("_test.py")
        | name.endswith("_test.go")
        | lowered.contains(".test.")
        | lowered.contains(".spec.")
        | (lowered.startswith("test.") & lowered.rlike(_suffix_pattern(SCRIPT_SUFFIXES)))
        | F.arrays_overlap(folders, F.array(*[F.lit(name) for name in TEST_DIRECTORIES]))
    )


def is_dependency_manifest(path: Column | str) -> Column:
    return F.lower(leaf(normalise(path))).isin(*DEPENDENCY_MANIFESTS)


def is_configuration_file(path: Column | str) -> Column:
    name = F.lower(leaf(normalise(path)))
    return name.isin(*CONFIGURATION_FILES) | name.rlike(_suffix_pattern(CONFIGURATION_SUFFIXES))


def classify_file(path: Column | str) -> Column:
    """test, dependency or configuration; NULL for source."""
    return (
        F.when(is_test_path(path), "test")
        .when(is_dependency_manifest(path), "dependency")
        .when(is_configuration_file(path), "configuration")
    )


def is_package_init(path: Column | str) -> Column:
    return leaf(normalise(path)).isin(*PACKAGE_MARKERS)


def language_of(path: Column | str) -> Column:
    """The analyzer that claims *path*: first matching suffix in dispatch order."""
    value = col(path)
    chosen = F.lit(None).cast("string")
    for language, suffixes in reversed(model.LANGUAGE_SUFFIXES):
        chosen = F.when(value.rlike(_suffix_pattern(suffixes)), language).otherwise(chosen)
    return chosen


def c_family_of(path: Column | str) -> Column:
    """The C-family language of *path*, whatever the case of its suffix."""
    lowered = F.lower(F.replace(col(path), F.lit("\\"), F.lit("/")))
    chosen = F.lit(None).cast("string")
    for language, suffixes in reversed(model.LANGUAGE_SUFFIXES):
        if language in model.C_FAMILY:
            chosen = F.when(lowered.endswith(suffixes[0]), language).otherwise(chosen)
    return chosen


def script_module_id(path: Column | str) -> Column:
    value = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(value, _suffix_pattern(TYPESCRIPT_INPUTS), "")


def c_family_module_id(path: Column | str) -> Column:
    value = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(value, "(?i)\\.(?:go|java|rs|cs)$", "")


def is_ignored(path: Column | str, patterns: Sequence[str]) -> Column:
    """An exact path, anything below it, or a ``*suffix`` in either case."""
    rules = [pattern.replace("\\", "/").strip("/") for pattern in patterns]
    below = "|".join(re.escape(rule) for rule in rules if not rule.startswith("*"))
    ends = "|".join(re.escape(rule[1:]) for rule in rules if rule.startswith("*"))
    # One expression, so a long list costs one match per path.
    parts = ([f"^(?:{below})(?:/|$)"] if below else []) + ([f"(?i:(?:{ends})$)"] if ends else [])
    return F.replace(col(path), F.lit("\\"), F.lit("/")).rlike("|".join(parts)) if parts else F.lit(False)


def is_secret(path: Column | str, globs: Sequence[str] = SECRET_GLOBS) -> Column:
    """Any component of *path* matches a sensitive-path glob, in either case."""
    alternatives = [re.escape(glob.lower()).replace(r"\*", "[^/]*") for glob in globs]
    if not alternatives:
        return F.lit(False)
    return F.lower(normalise(path)).rlike("(?:^|/)(?:" + "|".join(alternatives) + ")(?:/|$)")
