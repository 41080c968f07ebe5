"""Generated files: staged, swapped in whole, checked, and cached."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from pathlib import Path

from .plans.contract import Contract
from .text import SqlError

HEADER = "# Generated from SQL statements; don't edit.\n"
RECEIPT = ".sqlloom-receipt.json"
PYTHON = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool", "binary": "bytes"}


def stub(contracts: list[Contract]) -> str:
    """Typed signatures of a module's statements."""
    out = [HEADER, "from __future__ import annotations\n\nfrom pyspark.sql import DataFrame, SparkSession\n\nfrom sqlloom.operators.dml import Result\nfrom sqlloom.operators.store import Transaction\n"]
    out.append(f"__all__ = {sorted(c.name for c in contracts)!r}\n")
    for c in contracts:
        args = ", ".join(f"{p.name}: {PYTHON.get(p.type, 'object')}{' | None' if p.nullable else ''}" for p in c.parameters)
        first, kind = ("session: SparkSession", "DataFrame") if c.access == "read" else ("tx: Transaction", "Result")
        columns = ", ".join(f"{x.name} {x.type}{'' if x.nullable else ' not null'}" for x in c.columns)
        out.append(f"\ndef {c.name}({first}{', *, ' + args if args else ''}) -> {kind}:\n    \"\"\"{columns or 'rows changed'}\"\"\"\n")
    return "".join(out)


def problems(root: str | Path, wanted: dict[str, str]) -> list[str]:
    """How the files under ``root`` differ from those wanted."""
    root = Path(root)
    held = {str(p.relative_to(root)) for p in root.rglob("*.pyi")} if root.exists() else set()
    out = [f"{n} is missing" for n in sorted(set(wanted) - held)]
    out += [f"{n} is no longer generated" for n in sorted(held - set(wanted)) if (root / n).read_text().startswith(HEADER)]
    return out + [f"{n} is stale" for n in sorted(held & set(wanted)) if (root / n).read_text() != wanted[n]]


def journal(root: Path) -> Path:
    return root.with_name(f".{root.name}-journal")


def recover(root: str | Path) -> bool:
    """Ends what a publication that died left: its old folder comes back where
    the new one isn't in place yet.  True if there was something to do."""
    root = Path(root)
    note = journal(root)
    if not note.exists():
        return False
    names = json.loads(note.read_text() or "{}")
    old, stage = (root.with_name(names.get(k) or f".{root.name}-{k}") for k in ("old", "stage"))
    if old.exists() and not root.exists():
        os.replace(old, root)
    for left in (old, stage):
        shutil.rmtree(left, ignore_errors=True)
    note.unlink()
    return True


def publish(root: str | Path, wanted: dict[str, str]) -> list[str]:
    """Puts all files in place, or none: the old folder comes back on failure,
    or with the next publication if this one dies between its two renames."""
    root = Path(root)
    recover(root)
    if len({n.lower() for n in wanted}) < len(wanted):
        raise SqlError("two outputs share a name")
    for name in wanted:
        if (root / name).exists() and not (root / name).read_text().startswith(HEADER):
            raise SqlError(f"{name} isn't a generated file")
    todo = problems(root, wanted)
    if not todo:
        return []
    root.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=f".{root.name}-", dir=root.parent))
    old = root.with_name(f".{root.name}-old")
    journal(root).write_text(json.dumps({"stage": stage.name, "old": old.name}))
    try:
        if root.exists():
            shutil.copytree(root, stage, dirs_exist_ok=True)
            for p in stage.rglob("*.pyi"):
                if p.read_text().startswith(HEADER):
                    p.unlink()
        for name, text in wanted.items():
            (stage / name).parent.mkdir(parents=True, exist_ok=True)
            (stage / name).write_text(text)
        if root.exists():
            os.replace(root, old)
        try:
            os.replace(stage, root)
        except OSError:
            if old.exists():
                os.replace(old, root)
            raise
    finally:
        recover(root)
    return todo


def receipt(inputs: dict[str, str], schema: str, wanted: dict[str, str]) -> str:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return json.dumps({"inputs": {k: sha(v) for k, v in sorted(inputs.items())}, "schema": schema, "outputs": {k: sha(v) for k, v in sorted(wanted.items())}}, indent=1)


def current(root: str | Path, inputs: dict[str, str], schema: str) -> bool:
    """Whether the last receipt has these inputs and its outputs still stand."""
    path = Path(root) / RECEIPT
    if not path.exists():
        return False
    old = json.loads(path.read_text())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if old["schema"] != schema or old["inputs"] != {k: sha(v) for k, v in inputs.items()}:
        return False
    return all((Path(root) / n).exists() and sha((Path(root) / n).read_text()) == h for n, h in old["outputs"].items())
