"""Statements that changed between two commits."""

from __future__ import annotations

from pathlib import Path

from .blocks import parse
from .lifecycle import digest
from .sources.discovery import git_files, git_renames


def statements(files: dict[str, str]) -> dict[tuple[str, str], str]:
    """{(path, name): digest}; files without blocks don't count."""
    out = {}
    for path, text in files.items():
        if "func:" in text:
            for b in parse(text, path):
                out[path, b.name] = digest(b.sql)
    return out


def changed(folder: str | Path, old: str, new: str) -> list[dict]:
    """Added, removed, changed and moved statements, in order."""
    before, after = statements(git_files(folder, old)), statements(git_files(folder, new))
    moved = git_renames(folder, old, new)
    out = []
    for (path, name), now in sorted(after.items()):
        was = before.pop((path, name), None)
        source = path
        if was is None and path in moved:
            source = moved[path]
            was = before.pop((source, name), None)
        if was is None:
            out.append({"path": path, "name": name, "change": "added"})
        elif was != now:
            out.append({"path": path, "name": name, "change": "changed"})
        elif source != path:
            out.append({"path": path, "name": name, "change": "moved", "from": source})
    out += [{"path": p, "name": n, "change": "removed"} for p, n in sorted(before)]
    return out
