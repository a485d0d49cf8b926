"""Configuration: a TOML file, strictly read; an absent file means the defaults."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from ripplework import model
from ripplework.functions.paths import SECRET_GLOBS

FILENAME = ".ripplework.toml"
STATE_DIRECTORY = ".ripplework"
# What every tool moves and nobody edits; the state directory must come first.
DEFAULT_IGNORE = (
    STATE_DIRECTORY, "*.doc", "*.docx", "*.pdf", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg", "*.webp",
    "*.mp4", "*.mov", "*.zip", "*.gz", "*.7z", "*.exe", "*.dll", "*.so", "*.dylib", "*.class", "*.jar", "*.pyc",
    "*.pyo", "*.woff", "*.woff2", "*.ttf", "*.otf", "*.eot",
)


class ConfigError(ValueError):
    """The configuration says something it must not."""


@dataclass(frozen=True)
class RepositorySection:
    path: str = "."


@dataclass(frozen=True)
class ActivitySection:
    quiet_period_seconds: float = model.QUIET_SECONDS
    minimum_session_seconds: float = model.MINIMUM_SESSION_SECONDS
    poll_interval_seconds: float = 2.0
    idle_poll_interval_seconds: float = 5.0


@dataclass(frozen=True)
class AnalysisSection:
    max_file_size_mb: float = 5.0
    impact_max_depth: int = model.MAX_DEPTH

    @property
    def max_bytes(self) -> int:
        return int(self.max_file_size_mb * 1024 * 1024)


@dataclass(frozen=True)
class SecretsSection:
    exclude_paths: tuple[str, ...] = SECRET_GLOBS


@dataclass(frozen=True)
class TestsSection:
    __test__ = False
    enabled: bool = False
    command: str = "pytest"
    timeout_seconds: float = 300.0


@dataclass(frozen=True)
class Config:
    ignore: tuple[str, ...] = DEFAULT_IGNORE
    repository: RepositorySection = field(default_factory=RepositorySection)
    activity: ActivitySection = field(default_factory=ActivitySection)
    analysis: AnalysisSection = field(default_factory=AnalysisSection)
    secrets: SecretsSection = field(default_factory=SecretsSection)
    tests: TestsSection = field(default_factory=TestsSection)


#: Numbers that nothing works without, and strings that must say something.
POSITIVE = ("impact_max_depth", "timeout_seconds", "max_file_size_mb", "poll_interval_seconds", "idle_poll_interval_seconds")
TOLD = ("command",)


def _checked(where: str, value: Any, default: Any) -> Any:
    """*value* in the type of *default*; a boolean is never a number, a number never negative."""
    if isinstance(default, tuple):
        if not isinstance(value, list) or not all(isinstance(item, str) for item in value):
            raise ConfigError(f"{where} must be a list of strings")
        return tuple(value)
    if isinstance(default, bool) or isinstance(value, bool):
        if not (isinstance(default, bool) and isinstance(value, bool)):
            raise ConfigError(f"{where} has the wrong type")
        return value
    if isinstance(default, str):
        if not isinstance(value, str):
            raise ConfigError(f"{where} must be a string")
        return value
    if not isinstance(value, int if isinstance(default, int) else (int, float)):
        raise ConfigError(f"{where} must be a number")
    if value < 0:
        raise ConfigError(f"{where} must not be negative")
    return type(default)(value)


def _section(kind: type, where: str, data: Any) -> Any:
    if not isinstance(data, dict):
        raise ConfigError(f"{where} must be a table")
    known = {item.name for item in fields(kind)}
    if unknown := sorted(set(data) - known):
        raise ConfigError(f"unknown key {where}.{unknown[0]}")
    base = kind()
    section = {name: _checked(f"{where}.{name}", value, getattr(base, name)) for name, value in data.items()}
    for name, value in section.items():
        if name in POSITIVE and not value > 0:
            raise ConfigError(f"{where}.{name} must be above zero")
        if name in TOLD and not (value.strip() if isinstance(value, str) else all(word.strip() for word in value)):
            raise ConfigError(f"{where}.{name} must not be blank")
    return kind(**section)


def parse_config(data: dict[str, Any]) -> Config:
    sections = {item.name: type(getattr(Config(), item.name)) for item in fields(Config) if item.name != "ignore"}
    if unknown := sorted(set(data) - set(sections) - {"ignore"}):
        raise ConfigError(f"unknown key {unknown[0]}")
    parts = {name: _section(kind, name, data[name]) for name, kind in sections.items() if name in data}
    if "ignore" in data:
        listed = _checked("ignore", data["ignore"], DEFAULT_IGNORE)
        # Whatever the file says, the engine's own writes are never activity.
        parts["ignore"] = listed if STATE_DIRECTORY in listed else (STATE_DIRECTORY, *listed)
    return Config(**parts)


def load_config(root: str | Path) -> Config:
    place = Path(root) / FILENAME
    if not place.is_file():
        return Config()
    try:
        return parse_config(tomllib.loads(place.read_text(encoding="utf-8")))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as problem:
        raise ConfigError(f"{place.name}: {problem}") from problem


def render_default_config() -> str:
    """The defaults as TOML that reads back to the defaults; top-level keys come first."""
    def shown(value: Any) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, str):
            return f'"{value}"'
        if isinstance(value, (list, tuple)):
            return "[" + ", ".join(shown(item) for item in value) + "]"
        return f"{value:g}" if isinstance(value, float) else str(value)

    tables = asdict(Config())
    lines = ["# What may never start a session: exact paths, folders, or *suffixes.", f"ignore = {shown(tables.pop('ignore'))}"]
    for name, values in tables.items():
        lines += ["", f"[{name}]", *[f"{key} = {shown(value)}" for key, value in values.items()]]
    return "\n".join(lines) + "\n"
