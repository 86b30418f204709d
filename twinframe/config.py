"""Configuration in layers: defaults, two TOML files, an ignore file, environment, call. Each layer is checked before it is merged."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from .policy import Policy, overrides

FILES = ("pyproject.toml", "twinframe.toml")
IGNORE_FILE = ".twinframeignore"
ENVIRONMENT = {"TWINFRAME_ROOT": "root", "TWINFRAME_OUTPUT": "output", "TWINFRAME_CACHE": "cache", "TWINFRAME_SPLIT_TEST": "split_test"}

#: Folders that are never source.
EXCLUDED = ("**/.git/**", ".git/**", "**/.venv/**", ".venv/**", "venv/**", "**/__pycache__/**", "**/node_modules/**", "node_modules/**", "build/**", "dist/**", "coverage/**", "**/.mypy_cache/**", "**/.pytest_cache/**", "**/.ruff_cache/**", "**/*.min.js")


@dataclass(frozen=True)
class Config:
    root: str = "."
    output: str = "twinframe-report"
    cache: str = ".twinframe-cache"
    include: tuple[str, ...] = ("**",)
    exclude: tuple[str, ...] = EXCLUDED
    split_test: bool = True
    policy: Policy = field(default_factory=Policy)

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def checked(layer: Mapping, name: str) -> dict:
    """A layer's values with the right types; unknown names and wrong types raise ValueError."""
    kinds = {"root": str, "output": str, "cache": str, "include": list, "exclude": list, "split_test": bool, "policy": dict}
    out = {}
    for k, v in layer.items():
        if k not in kinds:
            raise ValueError(f"{name}: unknown setting {k}")
        if not isinstance(v, kinds[k]) or (kinds[k] is list and not all(isinstance(x, str) for x in v)):
            raise ValueError(f"{name}: {k} must be a {kinds[k].__name__}")
        out[k] = tuple(v) if isinstance(v, list) else v
    return out


def merged(config: Config, layer: dict) -> Config:
    layer = dict(layer)
    if "policy" in layer:
        layer["policy"] = overrides(config.policy, layer["policy"])
    if "exclude" in layer:
        layer["exclude"] = (*config.exclude, *(p for p in layer["exclude"] if p not in config.exclude))
    return replace(config, **layer)


def load(root: str | Path = ".", given: Mapping | None = None, environment: Mapping[str, str] | None = None) -> Config:
    root = Path(root)
    config = Config(root=str(root))
    for name in FILES:
        if (path := root / name).is_file():
            with path.open("rb") as f:
                values = tomllib.load(f)
            values = values.get("tool", {}).get("twinframe", {}) if name == "pyproject.toml" else values
            config = merged(config, checked(values, name))
    if (path := root / IGNORE_FILE).is_file():
        lines = [x.strip() for x in path.read_text().splitlines()]
        config = merged(config, {"exclude": tuple(x for x in lines if x and not x.startswith("#"))})
    env = os.environ if environment is None else environment
    values = {field_: env[k] for k, field_ in ENVIRONMENT.items() if k in env}
    if "split_test" in values:
        if values["split_test"].lower() not in ("0", "1", "true", "false"):
            raise ValueError("TWINFRAME_SPLIT_TEST must be true or false")
        values["split_test"] = values["split_test"].lower() in ("1", "true")
    config = merged(config, checked(values, "environment"))
    return merged(config, checked({k: list(v) if isinstance(v, tuple) else v for k, v in (given or {}).items() if v is not None}, "call"))


def repository_root(start: str | Path) -> Path:
    """The nearest folder upward that holds a mark of a repository; the start if none does."""
    marks = (".git", ".hg", ".svn", "pyproject.toml", "setup.py", "setup.cfg", "package.json", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "Makefile")
    start = Path(start).resolve()
    return next((p for p in (start, *start.parents) if any((p / m).exists() for m in marks)), start)
