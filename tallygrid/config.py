"""Configuration as plain nested dictionaries: dot paths, deep merges, JSON files."""

from __future__ import annotations

import copy
import json
import os

#: Defaults; never changed in place.
DEFAULTS = {
    "evaluation": {"fuzzy_threshold": 60, "compare_threshold": 80},
    "ocr": {"min_text_chars": 50, "enabled": True, "drawings_only": False},
    "extraction": {"chunk_chars": 12_000, "mode": "default"},
}


def merged(base: dict, updates: dict) -> dict:
    """A new dictionary of ``base`` with ``updates``, dictionaries merged level by level."""
    out = copy.deepcopy(base)
    for k, v in updates.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else copy.deepcopy(v)
    return out


def get(config: dict, path: str, default=None):
    """The value at a dot path, or ``default``."""
    at = config
    for k in path.split("."):
        if not isinstance(at, dict) or k not in at:
            return default
        at = at[k]
    return at


def put(config: dict, path: str, value) -> dict:
    """A new configuration with the value at a dot path; levels that are missing are made."""
    head, _, rest = path.partition(".")
    inner = config.get(head) if isinstance(config.get(head), dict) else {}
    return merged({k: v for k, v in config.items() if k != head}, {head: put(inner, rest, value) if rest else value})


def load(path: str) -> dict:
    """The defaults with what a file holds; the defaults alone if there is none or it is damaged."""
    try:
        with open(path, encoding="utf-8") as f:
            return merged(DEFAULTS, json.load(f))
    except (OSError, ValueError):
        return merged(DEFAULTS, {})


def save(path: str, config: dict) -> None:
    """Write a configuration; a reader sees the old file or the new one."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(config, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.new", path)


def reset(path: str) -> dict:
    config = merged(DEFAULTS, {})
    save(path, config)
    return config
