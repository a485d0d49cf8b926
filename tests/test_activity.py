"""Quiescence in batch and stream against one sequential simulation; git output; stores."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ripplework.sinks import blobs as B
from ripplework.sources import config as C
from ripplework.sources import git as S
from ripplework.sources.runner import run_tests
from ripplework.sources.scaffold import initialise
from ripplework.sources.tree import read_tree
from ripplework.streaming import quiescence as Q

OBS = "repo string, seq long, at double, token string"


def simulate(trace, quiet, minimum):
    token = active = started = None
    states = []
    for at, seen in trace:
        if token is None:
            state = "idle"
        elif seen != token:
            state, active, started = "active", at, at if started is None else started
        elif started is None:
            state = "idle"
        elif at - active >= quiet and at - started >= minimum:
            state, active, started = "stable", None, None
        else:
            state = "quieting"
        token = seen
        states.append(state)
    return states


def traces(seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for repo in "abcd":
        at, trace = 0.0, []
        for _ in range(60):
            at += rng.choice([1, 2, 5, 9])
            trace.append((at, rng.choice("xxy")))
        rows += [(repo, i, t, tok) for i, (t, tok) in enumerate(trace)]
        want[repo] = trace
    return rows, want


@pytest.mark.parametrize("bucket", [7.0, 40.0, 1e6])
def test_closed_form_whatever_the_buckets(spark, bucket):
    rows, want = traces(1)
    got = Q.quiescence_states(spark.createDataFrame(rows, OBS), 8, 2, bucket).orderBy("repo", "seq").collect()
    for repo, trace in want.items():
        assert [r["state"] for r in got if r["repo"] == repo] == simulate(trace, 8, 2)
    with pytest.raises(ValueError):
        Q.quiescence_states(spark.createDataFrame(rows, OBS), 2, 8)


@pytest.mark.parametrize("bucket", [10.0, 100.0])
def test_gap_sessions_whatever_the_buckets(spark, bucket):
    rows, want = traces(2)
    got = {(r["repo"], r["started"], r["ended"], r["observations"]) for r in Q.gap_sessions(spark.createDataFrame(rows, OBS), 5, bucket).collect()}
    expected = set()
    for repo, trace in want.items():
        session = [trace[0][0]]
        for at, _ in trace[1:]:
            if at - session[-1] > 5:
                expected.add((repo, session[0], session[-1], len(session)))
                session = []
            session.append(at)
        expected.add((repo, session[0], session[-1], len(session)))
    assert got == expected


def test_the_stream_remembers_between_batches(spark):
    """Quiet below the minimum age: only the stateful form is exact, and it spans micro-batches."""
    rows, want = traces(3)
    folder = tempfile.mkdtemp(prefix="samples-")
    for part in range(3):
        with open(f"{folder}/{part}.json", "w", encoding="utf-8") as handle:
            for repo, seq, at, token in rows:
                if seq // 20 == part:
                    handle.write(json.dumps({"repo": repo, "seq": seq, "at": at, "token": token}) + "\n")
        os.utime(f"{folder}/{part}.json", (1_000_000 + part, 1_000_000 + part))
    Q.with_state_store(spark)
    source = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).json(folder)
    out = tempfile.mkdtemp(prefix="states-")
    Q.observe_stream(source, 3, 20).writeStream.format("parquet").option("path", f"{out}/s").option(
        "checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(Q.OBSERVED).parquet(f"{out}/s")
    ordered = got.orderBy("repo", "seq").collect()
    for repo, trace in want.items():
        assert [r["state"] for r in ordered if r["repo"] == repo] == simulate(trace, 3, 20)
    assert Q.settled_sessions(got).count() == got.where("state = 'stable'").count()


def test_git_output(spark):
    zeros = "N... 100644 100644 100644 0 0"
    text = f"# branch.oid (initial)\0001 .M {zeros} a b.py\0002 R. {zeros} R100 new.py\0002 old\000u UU {zeros[:-2]} 100644 0 0 0 c.py\000? d.py\000z skip\000"
    raw = spark.createDataFrame([("r", text)], "repo string, output string")
    got = [(r["kind"], r["path"], r["original_path"]) for r in S.parse_status(raw).orderBy("pos").collect()]
    assert got[0] == ("changed", "a b.py", None) and got[1] == ("renamed", "new.py", "2 old") and got[-1] == ("untracked", "d.py", None)
    assert S.branch_oid(raw).first()["head_oid"] is None
    names = spark.createDataFrame([("r", "M\0A\0R100\0old\0new\0Q\0x\0D\0gone")], "repo string, output string")
    assert [(r["status"], r["path"], r["original_path"]) for r in S.parse_name_status(names).orderBy("pos").collect()] == [
        ("modified", "A", None), ("renamed", "new", "old"), ("unknown", "x", None), ("deleted", "gone", None)]
    numbers = spark.createDataFrame([("r", "1\t2\ta\0-\t-\tb\0003\t4\t\0old\0new\0bad\0")], "repo string, output string")
    assert {r["path"]: (r["insertions"], r["deletions"]) for r in S.parse_numstat(numbers).collect()} == {"a": (1, 2), "b": (None, None), "new": (3, 4)}


def test_blobs_are_put_once(spark):
    store = tempfile.mkdtemp(prefix="blobs-") + "/b"
    contents = spark.createDataFrame([("x",), ("y",), ("x",)], "content string")
    digests = B.put_blobs(contents, store)
    B.put_blobs(contents, store)
    assert spark.read.parquet(store).count() == 2
    assert {r["content"] for r in B.get_blobs(digests, store).collect()} == {"x", "y"}
    wanted = spark.createDataFrame([("none",)], "digest string")
    assert B.has_blobs(wanted, store).first()["held"] is False


def test_a_damaged_cache_entry_is_a_miss(spark):
    store = tempfile.mkdtemp(prefix="cache-") + "/c"
    good = '{"symbols": [], "imports": [], "calls": []}'
    B.cache_put(spark.createDataFrame([("d1", good, "python-1"), ("d2", "{broken", "python-1")], "digest string, payload string, kind string"), store)
    wanted = spark.createDataFrame([("python-1", d) for d in ("d1", "d2", "d3")] + [("python-2", "d1")], "kind string, digest string")
    shape = "symbols array<string>, imports array<string>, calls array<string>"
    assert {(r["kind"], r["digest"]): r["hit"] for r in B.cache_get(wanted, store, shape).collect()} == {
        ("python-1", "d1"): True, ("python-1", "d2"): False, ("python-1", "d3"): False, ("python-2", "d1"): False}


def test_config_is_strict_and_round_trips():
    import tomllib
    assert C.parse_config(tomllib.loads(C.render_default_config())) == C.Config()
    for bad in ({"nope": 1}, {"analysis": {"impact_max_depth": True}}, {"activity": {"quiet_period_seconds": -1}}, {"tests": {"enabled": 1}}, {"secrets": {"x": []}}):
        with pytest.raises(C.ConfigError):
            C.parse_config(bad)
    assert C.STATE_DIRECTORY in C.parse_config({"ignore": []}).ignore


def test_scaffold_and_runner(tmp_path):
    assert initialise(tmp_path) == {"config": True, "state": True, "ignore": True}
    assert initialise(tmp_path) == {"config": False, "state": False, "ignore": False}
    assert run_tests(str(tmp_path), C.TestsSection(), ["a"]) is None
    assert run_tests(str(tmp_path), C.TestsSection(enabled=True), []).status == "not_run"
    assert run_tests(str(tmp_path), C.TestsSection(enabled=True, command="false"), ["a"]).status == "failed"
    assert run_tests(str(tmp_path), C.TestsSection(enabled=True, command="no-such-program"), ["a"]).status == "error"


def test_reading_a_tree_keeps_large_files_without_content(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b.py").write_bytes(b"x = 1\n")
    (tmp_path / "big.py").write_bytes(b"#" * 100)
    (tmp_path / "x.pyc").write_bytes(b"x")
    got = {r["path"]: (r["size"], r["content"]) for r in read_tree(spark, str(tmp_path), "r", limit=50).collect()}
    assert got["d/a b.py"][0] == 6 if "d/a b.py" in got else "d/a%20b.py" in got
    assert got["big.py"] == (100, None) and "x.pyc" not in got
