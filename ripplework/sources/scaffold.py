"""Setting a repository up: configuration, state folder and one ignore entry; safe to repeat."""

from __future__ import annotations

from pathlib import Path

from ripplework.sources.config import FILENAME, STATE_DIRECTORY, render_default_config


def ignore_has(root: Path, entry: str) -> bool:
    place = root / ".gitignore"
    if not place.is_file():
        return False
    lines = (line.strip() for line in place.read_text(encoding="utf-8").splitlines())
    return any(line.rstrip("/") == entry.rstrip("/") for line in lines if line and not line.startswith("#"))


def ensure_ignored(root: Path, entry: str) -> bool:
    """Append *entry* to ``.gitignore`` unless it is there; True when it was added."""
    if ignore_has(root, entry):
        return False
    place = root / ".gitignore"
    text = place.read_text(encoding="utf-8") if place.is_file() else ""
    gap = "" if not text or text.endswith("\n") else "\n"
    place.write_text(f"{text}{gap}{entry}\n", encoding="utf-8")
    return True


def initialise(root: Path) -> dict[str, bool]:
    """What was created: nothing that exists is touched."""
    config, state = root / FILENAME, root / STATE_DIRECTORY
    made = {"config": not config.exists(), "state": not state.exists()}
    if made["config"]:
        config.write_text(render_default_config(), encoding="utf-8")
    state.mkdir(exist_ok=True)
    made["ignore"] = ensure_ignored(root, f"{STATE_DIRECTORY}/")
    return made
