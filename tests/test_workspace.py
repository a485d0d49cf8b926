"""The live tree on a repository of its own: what counts as activity, and what a baseline holds."""

import subprocess

import pytest

from ripplework.cli import Workspace


@pytest.fixture()
def work(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    git = lambda *words: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *words], check=True, capture_output=True)
    git("init", "-q")
    (root / "a.py").write_text("def f(x):\n    return x\n")
    git("add", "a.py")
    git("commit", "-q", "-m", "first")
    return Workspace(root, spark)


def test_a_second_edit_of_a_dirty_file_is_activity(work):
    clean = work.token()
    (work.root / "a.py").write_text("def f(x):\n    return x + 1\n")
    dirty = work.token()
    (work.root / "a.py").write_text("def f(x):\n    return x + 100\n")
    assert len({clean, dirty, work.token()}) == 3
    assert work.token() == work.token()


def test_an_edit_after_the_snapshot_belongs_to_the_next_session(work):
    work.capture()
    (work.root / "a.py").write_text("def f(x):\n    return x + 1\n")
    taken = work.snapshot()
    (work.root / "a.py").write_text("def f(x, y):\n    return x + y\n")
    assert [row["path"] for row in work.session(taken)[2].collect()] == ["a.py"]
    work.capture(taken)
    before, after, changes, _, _ = work.session(work.snapshot())
    assert [row["path"] for row in changes.collect()] == ["a.py"]
    old = before.collect()[0]["content"]
    assert "x + 1" in (old if isinstance(old, str) else bytes(old).decode())
