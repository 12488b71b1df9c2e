"""Settings: YAML files, then the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

import yaml

PREFIX = "MILLRACE_"


def expand_env(value: Any) -> Any:
    """${NAME} in the strings of nested lists and dicts; unset names stay as written."""
    match value:
        case str():
            return os.path.expandvars(value)
        case dict():
            return {k: expand_env(v) for k, v in value.items()}
        case list():
            return [expand_env(v) for v in value]
    return value


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over's values; dicts on both sides are merged in turn."""
    both = {k: deep_merge(base[k], over[k]) for k in base.keys() & over.keys() if isinstance(base[k], dict) and isinstance(over[k], dict)}
    return {**base, **over, **both}


def from_env(environ: Mapping[str, str], prefix: str = PREFIX) -> dict[str, Any]:
    """PREFIX_A__B=x as {"a": {"b": x}}; values are read as YAML scalars."""
    out: dict[str, Any] = {}
    for name in sorted(n for n in environ if n.startswith(prefix)):
        value: Any = yaml.safe_load(environ[name])
        for part in reversed(name[len(prefix) :].lower().split("__")):
            value = {part: value}
        out = deep_merge(out, value)
    return out


def load(*paths: str, environ: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings of YAML files, later ones first in rank, and over them the environment; missing files are empty."""
    out: dict[str, Any] = {}
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                out = deep_merge(out, expand_env(yaml.safe_load(f) or {}))
    return deep_merge(out, from_env(os.environ if environ is None else environ))
