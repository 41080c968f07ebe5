"""Settings from ``sqlloom.toml``: sources, databases, semantic rules."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.semantics import Temporal
from ..text import SqlError
from .discovery import CONFIG

KEYS = {"source", "output", "migrations", "seeds", "bootstrap", "views", "value_sets", "scoped_ids", "temporal", "databases", "fixed_tables", "policy", "baseline"}


@dataclass(frozen=True)
class Config:
    root: Path
    source: Path
    output: Path
    migrations: Path | None = None
    seeds: Path | None = None
    bootstrap: Path | None = None
    value_sets: Path | None = None
    scoped_ids: Path | None = None
    policy: Path | None = None
    baseline: Path | None = None
    temporal: Temporal = Temporal()
    databases: dict[str, str] = field(default_factory=dict)
    fixed_tables: tuple[str, ...] = ()

    def database(self, flag: str | None = None, name: str | None = None) -> str:
        """A path given outright, then DATABASE_URL, then the file's target."""
        if flag:
            return flag
        if url := os.environ.get("DATABASE_URL"):
            return url
        if name:
            if name not in self.databases:
                raise SqlError(f"no database {name}; known: {', '.join(self.databases) or 'none'}")
            return self.databases[name]
        if len(self.databases) != 1:
            raise SqlError("name a database: " + (", ".join(self.databases) or "none is configured"))
        return next(iter(self.databases.values()))


def load(path: str | Path = CONFIG) -> Config:
    """A missing file gives the defaults."""
    path = Path(path)
    root = path.resolve().parent
    data = tomllib.loads(path.read_text()) if path.exists() else {}
    if unknown := set(data) - KEYS:
        raise SqlError(f"{path}: unknown keys {', '.join(sorted(unknown))}")
    place = lambda k: (root / data[k]).resolve() if k in data else None
    rules = data.get("temporal", {})
    if unknown := set(rules) - {"date", "datetime", "strict"}:
        raise SqlError(f"{path}: unknown temporal keys {', '.join(sorted(unknown))}")
    plain = Temporal()
    temporal = Temporal(tuple(rules.get("date", plain.date)), tuple(rules.get("datetime", plain.datetime)), bool(rules.get("strict", False)))
    databases = data.get("databases", {})
    if isinstance(databases, list):  # [[databases]] with name and path
        databases = {d["name"]: d["path"] for d in databases}
    source = place("source") or root
    output = place("output") or source / "generated"
    if not output.is_relative_to(source):
        raise SqlError(f"{output} isn't under {source}")
    return Config(root, source, output, *(place(k) for k in ("migrations", "seeds", "bootstrap", "value_sets", "scoped_ids", "policy", "baseline")), temporal, {k: str(v if "://" in str(v) else root / v) for k, v in databases.items()}, tuple(data.get("fixed_tables", ())))
