"""Settings with defaults, per function and per alias; the more particular wins."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from rivulet.errors import FlowError


@dataclass
class Config:
    """values, with the sections functions and aliases: name to further values."""

    values: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Config:
        """A JSON file, or lines of key: value (nested by indentation) where it isn't JSON."""
        text = Path(path).read_text()
        try:
            return cls(json.loads(text))
        except ValueError:
            return cls(_lines(text))

    def of(self, alias: str | None = None, function: str | None = None) -> dict:
        out = {k: v for k, v in self.values.items() if k not in ("functions", "aliases")}
        out |= (self.values.get("functions") or {}).get(function) or {}
        return out | ((self.values.get("aliases") or {}).get(alias) or {})

    def number(self, key: str, default: float = 0, **where) -> float:
        try:
            return float(self.of(**where).get(key, default))
        except (TypeError, ValueError) as e:
            raise FlowError(f"{key} isn't a number", 1011) from e

    def flag(self, key: str, default: bool = False, **where) -> bool:
        return str(self.of(**where).get(key, default)).lower() == "true"

    def names(self, key: str, **where) -> list[str]:
        """Comma-separated names, trimmed."""
        return [x.strip() for x in str(self.of(**where).get(key, "")).split(",") if x.strip()]


def _lines(text: str) -> dict:
    out: dict = {}
    stack = [(-1, out)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip().strip("'\"")
        if value:
            stack[-1][1][key.strip().strip("'\"")] = value
        else:
            stack[-1][1][key.strip().strip("'\"")] = new = {}
            stack.append((depth, new))
    return out
