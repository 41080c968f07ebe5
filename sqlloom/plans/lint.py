"""Plan lint: what a statement's physical plan reads, sorts and returns.

Findings come from Spark's plan of the statement, which is made but not run.
A policy names tables of fixed size, exceptions that hold for one statement
text and plan, and a baseline of known findings that may only shrink.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from ..text import SqlError

FIXED_LEAVES = ("LocalTableScan", "OneRowRelation", "Range", "Scan OneRowRelation", "EmptyRelation")


@dataclass(frozen=True)
class Finding:
    kind: str  #: scan, sort, unresolved or output
    table: str | None
    detail: str


def nodes(plan) -> list[tuple[int, str, object]]:
    """(depth, name, node) of a physical plan, from the top."""
    out = []

    def walk(p, depth: int) -> None:
        out.append((depth, p.nodeName(), p))
        children = p.children()
        for i in range(children.size()):
            walk(children.apply(i), depth + 1)

    walk(plan, 0)
    return out


def plan_of(df: DataFrame):
    return df._jdf.queryExecution().sparkPlan()


def scanned(text: str) -> str | None:
    """The table or file that a scan reads."""
    if m := re.search(r"(?:Location: .*?|paths\))\[[^\]]*?/([\w.-]+?)(?:\.parquet)?[\],]", text):
        return m[1]
    m = re.search(r"Scan (?:\w+ )?([\w.]+)", text)
    return m[1].rpartition(".")[2] if m else None


def point_lookup(text: str, keys: dict[str, tuple[str, ...]], table: str | None) -> bool:
    """Whether equality filters cover a key of the table."""
    equal = {m.lower() for m in re.findall(r"EqualTo\((\w+),", text)}
    key = keys.get(table or "", ())
    return bool(key) and {k.lower() for k in key} <= equal


def findings(df: DataFrame, fixed: tuple[str, ...] = (), keys: dict[str, tuple[str, ...]] | None = None) -> list[Finding]:
    out: list[Finding] = []
    growing = False
    bounded = False
    seen = nodes(plan_of(df))
    for _, name, node in seen:
        children = node.children().size()
        text = node.simpleString(1000)
        if not children:
            if name in FIXED_LEAVES:
                continue
            table = scanned(text)
            if table is None and "Scan" not in name:
                out.append(Finding("unresolved", None, name))
            elif table not in fixed and not point_lookup(text, keys or {}, table):
                growing = True
                filters = re.search(r"PushedFilters: \[(.*?)\]", text)
                out.append(Finding("scan", table, f"filters: {filters[1] if filters else ''}"))
        elif re.search(r"Limit|TakeOrdered", name) or name in ("HashAggregate", "ObjectHashAggregate") and "keys=[]" in text:
            bounded = True
    if growing:
        out += [Finding("sort", None, re.sub(r"#\d+L?", "", n.simpleString(200))) for _, name, n in seen if name in ("Sort", "TakeOrderedAndProject", "Window")]
        if not bounded:
            out.append(Finding("output", None, "rows grow with the input"))
    return out


def plan_hash(df: DataFrame) -> str:
    """Of the canonical plan without places and ids."""
    text = plan_of(df).canonicalized().toString()
    text = re.sub(r"Location: [^,]*,|file:[^\s,\]]*|#\d+L?|plan_id=\d+", "", text)
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Allowed:
    statement: str
    source: str  #: digest of the text
    plan: str  #: hash of the plan
    reason: str


@dataclass
class Policy:
    fixed: tuple[str, ...] = ()
    exceptions: list[Allowed] = field(default_factory=list)
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)  #: unique columns of each table

    @classmethod
    def load(cls, path: str | Path) -> Policy:
        data = json.loads(Path(path).read_text())
        out = cls(tuple(data.get("fixed", ())), [Allowed(**x) for x in data.get("exceptions", ())], {t: tuple(k) for t, k in data.get("keys", {}).items()})
        for x in out.exceptions:
            if not x.reason.strip():
                raise SqlError(f"{x.statement}: an exception needs a reason")
        if len({x.statement for x in out.exceptions}) < len(out.exceptions):
            raise SqlError("a statement has two exceptions")
        return out

    def check(self, name: str, source: str, df: DataFrame) -> list[Finding]:
        """What remains; an exception of another text or plan is stale."""
        found = findings(df, self.fixed, self.keys)
        for x in self.exceptions:
            if x.statement == name:
                if (x.source, x.plan) != (source, plan_hash(df)):
                    raise SqlError(f"{name}: its exception is of another text or plan")
                return []
        return found


@dataclass
class Baseline:
    """Known findings by statement; a new state may only have fewer."""

    known: dict[str, list[Finding]] = field(default_factory=dict)

    def permits(self, name: str, found: list[Finding]) -> bool:
        old = self.known.get(name, [])
        if sorted(map(str, found)) == sorted(map(str, old)):
            return True
        scans = lambda fs: sorted(str(f.table) for f in fs if f.kind == "scan")
        others = lambda fs: sorted(f.kind for f in fs if f.kind != "scan")
        rest = scans(old)
        for s in scans(found):
            if s not in rest:
                return False
            rest.remove(s)
        kinds = others(old)
        for k in others(found):
            if k not in kinds:
                return False
            kinds.remove(k)
        return len(found) < len(old)

    def reduced(self, now: dict[str, list[Finding]]) -> Baseline:
        """The next baseline; growth is an error."""
        bad = [n for n, f in now.items() if f and not self.permits(n, f)]
        if bad:
            raise SqlError(f"findings grew in {', '.join(sorted(bad))}")
        return Baseline({n: f for n, f in now.items() if f})

    def to_json(self) -> str:
        return json.dumps({n: [asdict(f) for f in fs] for n, fs in sorted(self.known.items())}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Baseline:
        return cls({n: [Finding(**f) for f in fs] for n, fs in json.loads(text).items()})
