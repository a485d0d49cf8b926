"""Sessions through the watch loop: contents that change between them, several repositories, replays."""

import pytest
from pyspark.sql import functions as F

from ripplework.operators.analyze import analyze_files
from ripplework.operators.impact import walk
from ripplework.sinks.store import Store
from ripplework.sources.config import ConfigError, parse_config
from ripplework.streaming.watch import Watcher, session_id

CALLER = "from lib import f\n\ndef use():\n    return f(1)\n"
VERSIONS = ["def f(x):\n    return x\n", "def f(x):\n    return x + 1\n", "def f(x, y):\n    return x + y\n"]
STATES = "repo string, seq long, at double, token string, state string, started_at double, settled_at double"


@pytest.fixture()
def watcher(spark, tmp_path):
    """A watcher over repositories whose library has version n at the end of session n."""

    def collect(settled):
        asked = settled.collect()
        files, old, changes = [], [], []
        for row in asked:
            now = int(row["settled_at"]) // 100
            files += [(row["repo"], "lib.py", VERSIONS[now]), (row["repo"], "use.py", CALLER)]
            old.append((row["repo"], "lib.py", VERSIONS[now - 1]))
            changes.append((row["repo"], "lib.py", "modified", None))
        frame = lambda rows: spark.createDataFrame(rows, "repo string, path string, content string")
        return frame(old), frame(files), spark.createDataFrame(changes, "repo string, path string, status string, original_path string")

    return Watcher(spark, Store(spark, str(tmp_path / "store")), collect)


def _settled(spark, *sessions):
    return spark.createDataFrame([(repo, n, float(end), "t", "stable", float(start), float(end)) for n, (repo, start, end) in enumerate(sessions)], STATES)


def _reasons(store, repo, end):
    sessions = store.sessions().where(F.col("repo") == repo).select("session_id", "stabilised_at").collect()
    wanted = next(r["session_id"] for r in sessions if r["stabilised_at"].startswith("1970-01-01T00:0" + ("1:40" if end == 100 else "3:20")))
    return {(r["path"], r["reason"]) for r in store.artifact("nodes", wanted).collect()}, store.artifact("nodes", wanted).count()


def test_a_second_session_sees_its_own_contents(spark, watcher):
    watcher.close(_settled(spark, ("a", 0, 100)), 0)
    watcher.close(_settled(spark, ("b", 0, 100)), 1)
    watcher.close(_settled(spark, ("a", 150, 200)), 2)
    first, _ = _reasons(watcher.store, "a", 100)
    second, _ = _reasons(watcher.store, "a", 200)
    other, _ = _reasons(watcher.store, "b", 100)
    assert ("lib.py", "symbol_body_changed") in first and ("use.py", "body_changed") in first
    assert ("lib.py", "symbol_signature_changed") in second and ("use.py", "signature_changed") in second
    assert other == first


def test_two_settlements_in_one_batch_and_a_replay(spark, watcher):
    states = _settled(spark, ("a", 0, 100), ("a", 150, 200), ("b", 0, 100))
    watcher.close(states, 0)
    once = {(r["session_id"], r["repo"]): r["changed_files"] for r in watcher.store.sessions().collect()}
    assert len(once) == 3 and set(once.values()) == {1}
    assert all(len(key) == 64 for key, _ in once)
    counts = [_reasons(watcher.store, "a", 100), _reasons(watcher.store, "a", 200)]
    watcher.close(states, 0)
    assert {(r["session_id"], r["repo"]): r["changed_files"] for r in watcher.store.sessions().collect()} == once
    assert [_reasons(watcher.store, "a", 100), _reasons(watcher.store, "a", 200)] == counts
    assert watcher.store.events().count() == 3
    assert ("lib.py", "symbol_signature_changed") in counts[1][0] and ("lib.py", "symbol_body_changed") in counts[0][0]


def test_identifiers_depend_on_the_whole_session(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 2.0), ("a", 1.0, 2.0), ("b", 0.0, 1.0)], "repo string, started_at double, settled_at double")
    assert rows.select(session_id().alias("i")).distinct().count() == 4


def test_large_and_unread_files_say_why(spark):
    files = spark.createDataFrame([("r", "big.py", b"x = 1\n" * 50), ("r", "lost.go", None), ("r", "ok.py", b"def f():\n    pass\n")],
                                  "repo string, path string, content binary")
    found = analyze_files(files, max_bytes=100)
    errors = {r["path"]: r["parse_error"] for r in found.modules.collect()}
    assert errors["ok.py"] is None and "300 bytes" in errors["big.py"] and errors["lost.go"] == "not read"
    assert [r["path"] for r in found.symbols.collect()] == ["ok.py"]


def test_limits_that_cannot_be(spark):
    for section in ({"analysis": {"impact_max_depth": 0}}, {"tests": {"timeout_seconds": 0}}, {"tests": {"command": "  "}}):
        with pytest.raises(ConfigError):
            parse_config(section)
    empty = spark.createDataFrame([], "repo string")
    with pytest.raises(ValueError):
        walk(empty, empty, empty, 0)
