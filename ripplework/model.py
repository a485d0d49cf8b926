"""Closed vocabularies, rank maps, limits and schemas shared by every operator.

Every relation carries ``repo``, so one job serves one repository or thousands.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies that artifacts and reports must agree on.
SYMBOL_KINDS = ("class", "function", "method")
SYMBOL_CHANGES = ("added", "removed", "signature_changed", "body_changed")
CHANGE_STATUSES = (
    "added", "modified", "deleted", "renamed", "copied", "type_changed", "unknown",
)
STATUS_BY_CODE = {
    "A": "added", "M": "modified", "D": "deleted",
    "R": "renamed", "C": "copied", "T": "type_changed",
}
CATEGORY_RANK = {
    "direct": 0, "indirect": 1, "test": 2, "configuration": 3, "dependency": 4, "potential": 5,
}
CONFIDENCE_RANK = {
    "confirmed": 0, "high_confidence": 1, "inferred": 2, "possible": 3, "unknown": 4,
}
STATE_RANK = {"added": 0, "removed": 1, "modified": 2, "affected": 3, "context": 4}
REVIEW_REASONS = (
    "dangling_import", "file_deleted", "signature_changed", "symbol_removed",
    "symbol_signature_changed",
)
# What a symbol's own change passes on; an added symbol passes on nothing.
SEED_PROPAGATION = {
    "signature_changed": "signature", "removed": "removed", "body_changed": "body",
}
# Propagation -> (category, reason) of whatever it reaches.
REACHED_AS = {
    "signature": ("indirect", "signature_changed"),
    "removed": ("indirect", "symbol_removed"),
    "body": ("potential", "body_changed"),
    "indirect": ("potential", "indirect_dependency"),
}
RELATEDNESS = ("not_compared", "related", "scope_expansion", "no_relationship")
RELATEDNESS_LABELS = {
    "not_compared": "not compared",
    "related": "potentially related",
    "scope_expansion": "potential scope expansion",
    "no_relationship": "no detected relationship",
}
WATCH_STATES = ("idle", "active", "quieting", "stable")
TEST_RUN_STATUSES = ("passed", "failed", "timed_out", "error", "not_run")
DYNAMIC_DISPATCH = (
    "__import__", "delattr", "eval", "exec", "getattr", "globals", "locals", "setattr", "vars",
)

# Limits and defaults.
MAX_DEPTH = 5
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_MAP_NODES = 40
MAX_LIMITATIONS = 20
MAX_DIFF_LINES = 400
MAX_OUTPUT_CHARS = 20_000
PREVIEW_ROWS = 15
RANKED_FILES = 10
QUIET_SECONDS = 8.0
MINIMUM_SESSION_SECONDS = 2.0

# Notes that explain a missing count.
NOTE_SENSITIVE = "sensitive path"
NOTE_TOO_LARGE = "exceeds analysis.max_file_size_mb"
NOTE_UNREADABLE = "unreadable"
NOTE_NO_BASELINE = "baseline contents unavailable"
NOTE_NO_COUNTS = "line statistics unavailable"
NOTE_PRE_EXISTING_NO_COUNTS = "pre-existing line counts unavailable"
NOTE_ABSENT_AT_BASELINE = "deleted before this session began"

# Analyzers in dispatch order, first matching suffix wins.
LANGUAGE_SUFFIXES = (
    ("python", (".py", ".pyi")),
    ("typescript", (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")),
    ("go", (".go",)),
    ("java", (".java",)),
    ("rust", (".rs",)),
    ("csharp", (".cs",)),
)
C_FAMILY = ("go", "java", "rust", "csharp")
ANALYZER_VERSION = "2"

EVIDENCE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("detail", T.StringType()),
])
IMPORT = T.StructType([
    T.StructField("module", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("alias", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("line", T.IntegerType()),
])
CALL = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("line", T.IntegerType()),
])
SYMBOL = T.StructType([
    T.StructField("qualified_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("signature", T.StringType()),
    T.StructField("signature_fingerprint", T.StringType()),
    T.StructField("body_fingerprint", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("decorators", T.ArrayType(T.StringType())),
    T.StructField("bases", T.ArrayType(T.StringType())),
    T.StructField("occurrences", T.IntegerType()),
])
CAPTURED = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("tracked", T.BooleanType()),
    T.StructField("digest", T.StringType()),
    T.StructField("withheld_reason", T.StringType()),
    T.StructField("absent", T.BooleanType()),
])
