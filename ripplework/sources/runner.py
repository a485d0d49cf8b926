"""Running the tests a session reaches: on the driver, off by default, never through a shell."""

from __future__ import annotations

import shlex
import subprocess
import time
from collections.abc import Sequence
from dataclasses import dataclass

from ripplework import model
from ripplework.sources.config import TestsSection


@dataclass(frozen=True)
class TestRun:
    __test__ = False
    status: str
    command: tuple[str, ...] = ()
    exit_code: int | None = None
    duration_seconds: float | None = None
    output_tail: str | None = None
    output_truncated: bool = False
    note: str | None = None


def run_tests(root: str, config: TestsSection, paths: Sequence[str]) -> TestRun | None:
    """Run *paths* with the configured command; the exit code decides. None when disabled.

    The command comes from the configuration alone and ``--`` ends its options, so a file
    name can never become one.
    """
    if not config.enabled:
        return None
    if not paths:
        return TestRun("not_run", note="No test is among the files this session changed or reached.")
    try:
        program = shlex.split(config.command)
    except ValueError as problem:
        return TestRun("error", note=f"tests.command cannot be parsed: {problem}")
    if not program:
        return TestRun("error", note="tests.command is empty.")
    command = (*program, "--", *paths)
    begun = time.monotonic()
    try:
        done = subprocess.run(command, cwd=root, capture_output=True, text=True, errors="replace",
                              timeout=config.timeout_seconds, check=False)
    except subprocess.TimeoutExpired:
        return TestRun("timed_out", command, duration_seconds=config.timeout_seconds,
                       note=f"Stopped after {config.timeout_seconds:g}s.")
    except OSError as problem:
        return TestRun("error", command, note=f"The command could not be run: {problem}")
    output = done.stdout + done.stderr
    return TestRun(
        "failed" if done.returncode else "passed", command, done.returncode, time.monotonic() - begun,
        output[-model.MAX_OUTPUT_CHARS:], len(output) > model.MAX_OUTPUT_CHARS)
