"""Sessions stored and read back: everything a session found, and what of it can no longer be read."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from ripplework.cli import Workspace, main
from ripplework.plans.delivery import load_delivery
from ripplework.sinks.store import ARTIFACTS, OPTIONAL, Store


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    git = lambda *words: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *words], check=True, capture_output=True)
    git("init", "-q")
    (root / "price.py").write_text("def total(x):\n    return x\n")
    (root / "shop.py").write_text("from price import total\n\ndef sell():\n    return total(1)\n")
    (root / "note.py").write_text("A = 1\n")
    git("add", ".")
    git("commit", "-q", "-m", "first")
    (root / "note.py").write_text("A = 2\n")
    return root


def _titles(delivery):
    return {row["title"] for row in delivery.concerns.collect()}


def test_an_analysis_is_stored_whole(spark, tree, capsys):
    assert main(["--path", str(tree), "analyze"]) == 0
    (tree / "price.py").write_text("import elsewhere\n\ndef total(x, tax):\n    return x + tax\n")
    assert main(["--path", str(tree), "analyze", "--intent", "change the total price, and the shipping"]) == 0
    store = Workspace(tree, spark).store
    session = store.latest()
    assert store.missing(session) == []
    assert [row["path"] for row in store.artifact("pre_existing", session).collect()] == ["note.py"]
    assert store.artifact("baseline", session).first()["tracked_changes"] == 1
    assert [row["path"] for row in store.artifact("captured", session).collect()] == ["note.py"]
    verdict = store.artifact("intent", session).first()
    assert verdict["relatedness"] == "related" and verdict["unmatched_tokens"] > 0
    assert store.artifact("tests", session) is None

    delivery = load_delivery(store, session)
    files = {row["path"]: row.asDict() for row in delivery.files.collect()}
    assert set(files) == {"price.py"} and files["price.py"]["signature_changed"] == 1 and files["price.py"]["imports_added"] == 1
    assert [(row["root"], row["findings"]) for row in delivery.roots.collect()] == [("price.py", 1)]
    titles = _titles(delivery)
    assert {"1 caller(s) of a changed declaration", "1 change(s) pre-date this session", "1 import(s) point outside the repository"} <= titles
    event = json.loads(store.events().where("kind = 'session_stabilised'").first()["detail"])
    assert event["trigger"] == "analyze" and event["signature_changes"] == 1 and event["pre_existing_files"] == 1
    assert event["changed_files"] == 1 and event["intent"].startswith("change the total") and "tests" not in event

    # A later task replaces the verdict of the session and is told by an event of its own.
    assert main(["--path", str(tree), "intent", "--task", "weather forecasts"]) == 0
    assert store.artifact("intent", session).first()["relatedness"] == "no_relationship"
    assert store.artifact("intent", session).count() == 1 and store.missing(session) == []
    assert store.events().where("kind = 'intent_compared'").count() == 1
    capsys.readouterr()
    for command in (["status"], ["sessions"], ["show", "--file", "price.py"]):
        assert main(["--path", str(tree), *command]) == 0
    said = capsys.readouterr().out
    assert "1 file(s), +" in said and "1 declaration(s)" in said and "1 to review" in said.replace("2 to review", "1 to review")
    assert "shop.py#sell" in said and "price.py led to 1 finding(s)" in said


@pytest.fixture()
def stored(spark, tmp_path):
    """Two sessions with a change each, every artifact written, all others empty."""
    store = Store(spark, str(tmp_path / "store"))
    settled = spark.createDataFrame([("a", "s1", 0.0, 1.0), ("b", "s2", 0.0, 2.0)], "repo string, session_id string, started_at double, settled_at double")
    empty = {name: spark.createDataFrame([], schema) for name, schema in ARTIFACTS.items() if name not in OPTIONAL}
    changes = spark.createDataFrame([(repo, "x.py", "modified", None, 1, 0, False, True, False, None) for repo in "ab"], ARTIFACTS["changes"])
    store.write_relations(settled, {**empty, "changes": changes})
    return store


def test_empty_artifacts_are_no_gaps(stored):
    assert stored.gaps().count() == 0 and stored.damaged().count() == 0
    delivery = load_delivery(stored)
    assert {(row["session_id"], row["title"]) for row in delivery.concerns.collect()} == {("s1", "Nothing flagged"), ("s2", "Nothing flagged")}
    assert {row["changes"] for row in delivery.summaries.collect()} == {"1 file(s), +1/-0 line(s), 0 pre-existing"}


def test_damaged_records_and_files_are_kept_apart(stored, tmp_path):
    root = tmp_path / "store"
    (root / "sessions" / "part-extra.json").write_text('{"session_id": "s3", "repo": \n')
    for file in (root / "artifacts" / "changes" / "session_id=s1").glob("*.parquet"):
        file.write_bytes(b"no table")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert sorted(row["session_id"] for row in stored.sessions().collect()) == ["s1", "s2"]
    found = {(row["why"], row["session_id"] or None) for row in stored.damaged().collect()}
    assert {why for why, _ in found} == {"not a record", "cannot be opened"} and ("cannot be opened", "s1") in found
    assert [tuple(row) for row in stored.gaps().collect()] == [("s1", "a", "changes", "0 of 1 row(s) can be read")]
    delivery = load_delivery(stored)
    assert [row["session_id"] for row in delivery.files.collect()] == ["s2"]
    assert {(row["session_id"], row["title"]) for row in delivery.concerns.collect()} == {("s1", "changes is missing"), ("s2", "Nothing flagged")}


def test_a_session_without_some_artifact_says_so(spark, stored):
    settled = spark.createDataFrame([("c", "s4", 0.0, 3.0)], "repo string, session_id string, started_at double, settled_at double")
    stored.write_relations(settled, {"changes": spark.createDataFrame([], ARTIFACTS["changes"])})
    assert set(stored.missing("s4")) == set(ARTIFACTS) - {"changes", *OPTIONAL}
    assert stored.missing("s1") == [] and stored.sessions().where(F.col("session_id") == "s4").first()["changed_files"] == 0


def test_no_store_yet(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    delivery = load_delivery(store)
    assert delivery.concerns.count() == 0 and delivery.files.count() == 0 and store.damaged().count() == 0 and store.latest() is None
