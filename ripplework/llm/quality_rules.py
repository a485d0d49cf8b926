"""Quality rules on documents and on the hosts they come from.

Each document is measured over its whole text and held against a few rules. Failures are aggregated by host (the
``source`` column, or any column named), rates are shrunk with a beta prior whose parameters are fitted to the hosts'
own rates by moments, and a host is rejected where a shrunk rate reaches ``HOST_LIMIT``. Verdicts are joined back: a
document is kept if it passes the base rules and its host stands.

A host with a third of all rows is pre-aggregated before the shuffle, and the join back is a skew-splittable equi-join
of narrow rows; texts are read once and never shuffled.

Edge cases: a null text has no words and fails; a null host is never rejected; repeated rows count as rows; other
columns are ignored; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is rejected where the shrunk rate of one rule's failures reaches this.
HOST_LIMIT = 0.9
#: Pseudo-counts of the prior: at least and at most.
PRIOR_LEAST, PRIOR_MOST = 2.0, 10_000.0


def measure(data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()
    count = len(words)
    seen: set[bytes] = set()
    repeated = 0
    for line in data.split(b"\n"):
        if line in seen:
            repeated += bool(line.split())
        else:
            seen.add(line)
    covered = 0
    if count >= 4:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(word, len(number)) for word in words], np.int64)
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) > 2_000_000:  # keeps the next product below 2 ** 63
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, where, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again = times[where] > 1
        flags = np.zeros(count, bool)
        for shift in range(3):
            flags[shift:shift + count - 2] |= again
        covered = int(flags.sum())
    return count, len(b"".join(words).decode("utf-8", "replace")), len(data) - len(data.translate(None, SYMBOLS)), repeated, covered


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # One text at a time as an object of Python: a batch may hold ten thousand whole texts.
        found = [measure(data.as_py() or b"") for data in batch.column("data")]
        columns = zip(*found, strict=True) if found else [[] for _ in MEASURES]
        yield pa.record_batch([batch.column("doc_id"), batch.column("host"), *(pa.array(x, pa.int64()) for x in columns)],
                              names=["doc_id", "host", *MEASURES])


def base_rules() -> dict[str, Column]:
    """The rules that decide on a document by themselves."""
    return {"short": F.col("n_words") < MIN_WORDS,
            "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")}


def host_rules() -> dict[str, Column]:
    """The rules whose rates judge a host: the base rules, symbols, word length, repeated lines."""
    return base_rules() | {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "lines": 20 * F.col("n_dup_lines") > F.col("n_words")}


def rejected_hosts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host) whose shrunk failure rate reaches the limit for some rule."""
    rules = host_rules()
    hosts = cut_lineage(measured.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), *(F.count(F.when(rule, 1)).alias(name) for name, rule in rules.items())))
    rate = {name: F.col(name) / F.col("n") for name in rules}
    moments = hosts.agg(*(F.avg(x).alias(f"{name}_mean") for name, x in rate.items()),
                        *(F.var_samp(x).alias(f"{name}_var") for name, x in rate.items())).first()
    rejected = F.lit(False)
    for name in rules:
        mean, variance = moments[f"{name}_mean"] or 0.0, moments[f"{name}_var"] or 0.0
        strength = min(max(mean * (1 - mean) / variance - 1, PRIOR_LEAST), PRIOR_MOST) if variance > 0 else PRIOR_LEAST
        rejected = rejected | ((F.col(name) + mean * strength) / (F.col("n") + strength) >= limit)
    return hosts.where(rejected).select("host")


def _measures(docs: DataFrame, host: str) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                        F.col("text").cast("binary").alias("data"))
    return cut_lineage(texts.mapInArrow(_measured, "doc_id long, host string, " + ", ".join(f"{x} long" for x in MEASURES)))


def _base_failed() -> Column:
    failed = F.lit(False)
    for rule in base_rules().values():
        failed = failed | rule
    return failed


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, the five measures (long), base_failed, host_rejected and kept, for each row of *docs*."""
    measured = _measures(docs, host)
    verdicts = rejected_hosts(measured, limit).withColumn("host_rejected", F.lit(True))
    return (measured.join(verdicts, "host", "left")
            .withColumn("base_failed", _base_failed()).withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
            .select("doc_id", *MEASURES, "base_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept")))


def _passes(data: pa.Array) -> pa.Array:
    return pa.array([(m := measure(x.as_py() or b""))[0] >= MIN_WORDS and 100 * m[4] <= MAX_REPEAT_PERCENT * m[0] for x in data], pa.bool_())


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of *docs* that ``judge`` keeps. Texts are measured again rather than shuffled to their verdicts."""
    rejected = cut_lineage(rejected_hosts(_measures(docs, host), limit))
    good = docs.where(F.arrow_udf(_passes, "boolean")(F.col("text").cast("binary")))
    return good.join(rejected, good[host].cast("string") == rejected["host"], "left_anti")
