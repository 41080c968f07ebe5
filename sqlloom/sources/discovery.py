"""Statement, view, migration and seed files on the driver's disk; git trees."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

from ..text import SqlError, split, tokens, unquote

NUMBERED = re.compile(r"(\d+)_[A-Za-z0-9_-]+\.sql\Z")
NAMED = re.compile(r"[A-Za-z][A-Za-z0-9_-]*\.sql\Z")
CONFIG = "sqlloom.toml"


def statement_files(root: str | Path) -> list[Path]:
    """``.sql`` files in order, without generated folders and those of nested
    projects that have a configuration of their own."""
    root = Path(root)
    out = []

    def walk(folder: Path) -> None:
        for p in sorted(folder.iterdir()):
            if p.is_dir():
                if p.name not in ("generated", "db_views", "migrations", "seeds") and not (p / CONFIG).exists() and not p.name.startswith("."):
                    walk(p)
            elif p.suffix == ".sql":
                out.append(p)

    walk(root)
    return out


def module_name(root: str | Path, path: Path) -> str:
    parts = path.relative_to(root).with_suffix("").parts
    return ".".join(re.sub(r"\W", "_", p) for p in parts)


def numbered_files(folder: str | Path) -> list[tuple[str, Path]]:
    """(version, path) in order; a number is given once."""
    out, seen = [], {}
    for p in sorted(Path(folder).glob("*.sql")):
        m = NUMBERED.match(p.name)
        if not m and not NAMED.match(p.name):
            raise SqlError(f"{p.name}: files are called 001_name.sql or name.sql")
        if m:
            number = int(m[1])
            if number in seen:
                raise SqlError(f"{p.name} and {seen[number]} share number {number}")
            seen[number] = p.name
        out.append((p.stem, p))
    return out


@dataclass(frozen=True)
class ViewFile:
    name: str
    columns: tuple[str, ...]
    select: str
    path: str = ""

    def create(self) -> str:
        return f"CREATE VIEW {self.name} ({', '.join(self.columns)}) AS {self.select}"


def parse_view(sql: str, path: str = "") -> ViewFile:
    """One CREATE VIEW with an explicit column list."""
    found = split(sql)
    if len(found) != 1:
        raise SqlError(f"{path}: a view file holds one statement")
    sql = found[0]
    seen = tokens(sql)
    if len(seen) < 4 or not seen[0].is_word("create") or not seen[1].is_word("view"):
        raise SqlError(f"{path}: CREATE VIEW name (columns) AS SELECT is needed")
    name = unquote(seen[2].text)
    if seen[3].text != "(":
        raise SqlError(f"{path}: view {name} needs a column list")
    end = next(i for i, t in enumerate(seen) if t.text == ")")
    columns = tuple(unquote(t.text) for t in seen[4:end] if t.text != ",")
    if len({c.lower() for c in columns}) < len(columns):
        raise SqlError(f"{path}: view {name} names a column twice")
    if end + 1 >= len(seen) or not seen[end + 1].is_word("as"):
        raise SqlError(f"{path}: view {name} needs AS SELECT")
    return ViewFile(name, columns, sql[seen[end + 2].start :].rstrip("; \n"), path)


def view_files(root: str | Path) -> list[ViewFile]:
    out, seen = [], {}
    for p in sorted(Path(root).rglob("db_views/*.sql")):
        v = parse_view(p.read_text(), str(p))
        if v.name.lower() in seen:
            raise SqlError(f"{p}: view {v.name} is also in {seen[v.name.lower()]}")
        if v.name.lower() != p.stem.lower():
            raise SqlError(f"{p}: the file is named after its view {v.name}")
        seen[v.name.lower()] = str(p)
        out.append(v)
    return out


def git(folder: str | Path, *args: str) -> str:
    run = subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True, check=False)
    if run.returncode:
        raise SqlError(f"git {args[0]}: {run.stderr.strip()}")
    return run.stdout


def git_files(folder: str | Path, commit: str) -> dict[str, str]:
    """{path: text} of the statement files of a commit."""
    names = git(folder, "ls-tree", "-r", "--name-only", commit).splitlines()
    return {n: git(folder, "show", f"{commit}:{n}") for n in names if n.endswith(".sql")}


def git_renames(folder: str | Path, old: str, new: str) -> dict[str, str]:
    """{new path: old path}."""
    out = {}
    for line in git(folder, "diff", "--find-renames", "--name-status", old, new).splitlines():
        parts = line.split("\t")
        if parts[0].startswith("R"):
            out[parts[2]] = parts[1]
    return out
