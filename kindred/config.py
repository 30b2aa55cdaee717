"""Configuration: defaults, then Cargo.toml metadata, then dupes.toml, then command-line overrides."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

FILE_KEYS = ("min_nodes", "similarity_threshold", "exclude", "max_exact_duplicates", "max_near_duplicates", "max_exact_percent", "max_near_percent", "min_lines", "exclude_tests", "sub_function", "min_sub_nodes")


@dataclass(frozen=True)
class Config:
    min_nodes: int = 10
    similarity_threshold: float = 0.9
    exclude: tuple[str, ...] = ()
    max_exact_duplicates: int | None = None
    max_near_duplicates: int | None = None
    max_exact_percent: float | None = None
    max_near_percent: float | None = None
    min_lines: int = 0
    exclude_tests: bool = False
    sub_function: bool = False
    min_sub_nodes: int = 5
    root: Path = field(default_factory=lambda: Path("."))


def _text(path: Path) -> str:
    """A file's content; an unreadable one counts as empty."""
    try:
        return path.read_text(encoding="utf-8")
    except (OSError, ValueError):
        return ""


def _table(text: str) -> dict:
    """What a TOML text says; a malformed one counts as empty."""
    try:
        return tomllib.loads(text)
    except ValueError:
        return {}


def _well_typed(key: str, value: object) -> bool:
    if key == "exclude":
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    if key in ("exclude_tests", "sub_function"):
        return isinstance(value, bool)
    if key in ("similarity_threshold", "max_exact_percent", "max_near_percent"):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, int) and not isinstance(value, bool) and value >= 0


def _layer(config: Config, values: object) -> Config:
    """A file's settings over the config: each replaces, unknown keys are ignored, an ill-typed one voids the file."""
    if not isinstance(values, dict):
        return config
    known = {k: v for k, v in values.items() if k in FILE_KEYS}
    if not all(_well_typed(k, v) for k, v in known.items()):
        return config
    floats = ("similarity_threshold", "max_exact_percent", "max_near_percent")
    return replace(config, **{k: tuple(v) if k == "exclude" else float(v) if k in floats else v for k, v in known.items()})


def config_of(cargo: str, own: str, root: str | Path = ".") -> Config:
    """Defaults under the metadata of a Cargo.toml under a dupes.toml, given as texts."""
    meta = _table(cargo)
    for key in ("package", "metadata", "dupes"):
        meta = meta.get(key, {}) if isinstance(meta, dict) else {}
    return _layer(_layer(Config(root=Path(root)), meta), _table(own))


def load_config(root: str | Path) -> Config:
    root = Path(root)
    return config_of(_text(root / "Cargo.toml"), _text(root / "dupes.toml"), root)


def apply_overrides(config: Config, **overrides) -> Config:
    """Values that are given win; excludes are appended; flags can only be switched on."""
    given = {k: v for k, v in overrides.items() if v is not None and k in {f.name for f in fields(Config)}}
    if "exclude" in given:
        given["exclude"] = (*config.exclude, *given["exclude"])
    for flag in ("exclude_tests", "sub_function"):
        if flag in given:
            given[flag] = getattr(config, flag) or bool(given[flag])
    return replace(config, **given)
