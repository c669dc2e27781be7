"""Ordered rule tables from TOML and JSON files: configuration, read on the driver."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path


def toml_section(path: str | Path, *section: str) -> dict:
    """A section of a TOML file in file order; empty if the file or the section is missing or broken."""
    try:
        found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError):
        return {}
    for name in section:
        found = found.get(name, {}) if isinstance(found, dict) else {}
    return found if isinstance(found, dict) else {}


def ordered_rules(path: str | Path, *section: str) -> list[tuple[str, str]]:
    """(key, value) pairs of a section, in order."""
    return [(k, v) for k, v in toml_section(path, *section).items() if isinstance(v, str)]


def prioritised_rules(path: str | Path, rules: str = "corrections", first: str = "priority") -> list[tuple[str, str]]:
    """Rules of a JSON file: those that ``first`` lists in its order, then the rest by length of the key, longest first."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return []
    table = found.get(rules, {})
    head = [k for k in found.get(first, []) if k in table]
    return [(k, table[k]) for k in head + sorted((k for k in table if k not in set(head)), key=len, reverse=True)]
