"""Hashes, words, JSON accessors and small text forms as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a task that cannot point at anything by themselves.
STOPWORDS = (
    "a", "add", "added", "adding", "all", "an", "and", "are", "as", "at", "be", "but", "by", "can", "code", "fix", "fixed", "for", "from",
    "in", "into", "is", "it", "its", "make", "me", "my", "new", "not", "of", "on", "or", "please", "refactor", "refactoring", "should",
    "so", "some", "that", "the", "their", "them", "then", "there", "this", "to", "update", "updated", "updating", "use", "using", "we",
    "with", "would", "you", "your", "i", "thank", "thanks",
)

# Inflections a word may lose, and the shortest stem worth keeping.
INFLECTIONS = ("ing", "ed", "es", "s")
MIN_STEM = 4

#: Everything Python's ``str.split()`` treats as white space.
WHITESPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
#: Everything Python's ``str.splitlines()`` ends a line on.
LINE_BREAK = "\\r\\n|[\\n-\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
SNIFF_BYTES = 8000


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def digest(content: Column | str) -> Column:
    """Content digest: lower-case sha256 hex."""
    return F.sha2(col(content), 256)


def joined_hash(separator: str, *parts: Column) -> Column:
    """sha256 over *parts* joined by *separator*; a NULL part counts as empty."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(part, F.lit("")) for part in parts]), 256)


def fingerprint(*parts: Column) -> Column:
    """Sixteen hex characters that stand for *parts*."""
    return F.substring(joined_hash("\x1f", *parts), 1, 16)


def normalise_whitespace(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), WHITESPACE, " "))


def looks_binary(content: Column | str) -> Column:
    """A NUL among the first 8000 bytes."""
    head = F.substring(col(content).cast("binary"), 1, SNIFF_BYTES).cast("string")
    return F.instr(head, "\x00") > 0


def line_count(text: Column | str) -> Column:
    """How many lines ``splitlines`` would give."""
    value = col(text)
    last_is_break = F.right(value, F.lit(1)).rlike(LINE_BREAK)
    return (
        F.when(F.length(value) == 0, F.lit(0))
        .otherwise(F.regexp_count(value, F.lit(LINE_BREAK)) + F.when(last_is_break, 0).otherwise(1))
        .cast("int")
    )


def short_symbol(qualified_name: Column | str) -> Column:
    return F.substring_index(col(qualified_name), ".", -1)


def task_tokens(task: Column | str) -> Column:
    """The informative words of a task, in order, each once."""
    words = F.regexp_extract_all(F.lower(col(task)), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(word) for word in STOPWORDS]))


def token_forms(token: Column) -> Column:
    """The word itself, then the stems left when an inflection is removed."""
    stems = [
        F.when(
            token.endswith(suffix) & (F.length(token) - len(suffix) >= MIN_STEM),
            F.substring(token, F.lit(1), F.length(token) - len(suffix)),
        )
        for suffix in INFLECTIONS
    ]
    return F.array_distinct(F.array_compact(F.array(token, *stems)))


def word_parts(names: Column) -> Column:
    """Every word inside dotted or underscored names, lower-cased."""
    split = F.flatten(
        F.transform(names, lambda name: F.split(F.lower(F.replace(name, F.lit("."), F.lit("_"))), "_"))
    )
    return F.array_distinct(F.filter(split, lambda part: part != ""))


def clip(text: Column | str, limit: int) -> Column:
    value = col(text)
    return F.when(
        F.length(value) > limit, F.concat(F.substring(value, 1, limit - 1), F.lit("…"))
    ).otherwise(value)


def html_escape(text: Column | str) -> Column:
    # The ampersand has to go first.
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), pairs, col(text))


def join_limited(parts: Column, limit: int = 2) -> Column:
    """The first *limit* clauses, then how many were left out."""
    shown = F.array_join(F.slice(parts, 1, limit), " · ")
    more = F.concat(F.lit(" · +"), (F.size(parts) - limit).cast("string"), F.lit(" more"))
    return F.when(F.size(parts) > limit, F.concat(shown, more)).otherwise(shown)


def wrap(text: Column | str, width: int = 92) -> Column:
    """Lines of at most *width* characters, broken between words."""
    squeezed = normalise_whitespace(text)
    pattern = f"(.{{1,{width}}})(?: |$)|(\\S{{{width},}})(?: |$)"
    return F.transform(
        F.regexp_extract_all(squeezed, F.lit(pattern), F.lit(0)), lambda line: F.trim(line)
    )


def iso_timestamp(moment: Column | str) -> Column:
    return F.date_format(col(moment), "yyyy-MM-dd'T'HH:mm:ssXXX")


def stamp_id(moment: Column | str, entropy: Column) -> Column:
    """A sortable identifier: the second, then six hex characters of *entropy*."""
    return F.concat(
        F.date_format(col(moment), "yyyyMMdd-HHmmss"), F.lit("-"),
        F.substring(F.sha2(entropy.cast("string"), 256), 1, 6),
    )


def url_quote(text: Column | str) -> Column:
    """Percent-encoding that leaves only unreserved characters."""
    encoded = F.url_encode(col(text))
    for written, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(written), F.lit(wanted))
    return encoded


def session_url(session_id: Column | str, suffix: Column | str = "") -> Column:
    tail = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.lit("/session/"), url_quote(session_id), tail)


def element_id(kind: str, key: Column) -> Column:
    """A drawing element's identifier, the same on every export."""
    return F.substring(F.sha1(F.concat_ws(":", F.lit(kind), key).cast("binary")), 1, 16)


def element_seed(key: Column) -> Column:
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def pytest_counts(output: Column | str) -> Column:
    """(passed, failed, skipped) off the last ``=`` line with counts; an error is a failure."""
    counted = "\\d+ (?:passed|failed|errors?|skipped)"
    lines = F.filter(
        F.split(col(output), LINE_BREAK), lambda line: line.contains("=") & line.rlike(counted)
    )
    summary = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))

    def count(words: str) -> Column:
        found = F.regexp_extract_all(summary, F.lit(f"(\\d+) (?:{words})"), F.lit(1))
        return F.aggregate(found, F.lit(0), lambda total, item: total + item.cast("int"))

    return F.struct(
        count("passed").alias("passed"),
        count("failed|errors?").alias("failed"),
        count("skipped").alias("skipped"),
    )


# ------------------------------------------------------------- defensive JSON accessors


def json_value(document: Column, path: str, kind: str, default: object = None) -> Column:
    """A field of a VARIANT, or *default* when it is absent or of another type.

    The stored type is checked rather than cast, so ``true`` is never read as 1.
    """
    wanted = {"bigint": "BIGINT", "string": "STRING", "boolean": "BOOLEAN"}[kind]
    stored = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    value = F.when(stored == wanted, F.try_variant_get(document, path, kind))
    return value if default is None else F.coalesce(value, F.lit(default))


def json_strings(document: Column, path: str) -> Column:
    """The string members of a JSON list; anything else is dropped."""
    items = F.try_variant_get(document, path, "array<variant>")
    strings = F.transform(
        items,
        lambda item: F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string")),
    )
    return F.coalesce(F.array_compact(strings), F.array().cast("array<string>"))
