"""Declared tables: types, nullability, keys, checks, from DDL or from Spark.

Parquet enforces none of these, so they are kept beside the data.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from ..text import SqlError, Token, tokens, unquote

#: Words that end a column's declared type.
CONSTRAINT = ("constraint", "not", "null", "primary", "unique", "check", "default", "references", "collate", "generated", "as")


def declared_type(name: str) -> str:
    """Contract type of a declared SQL type; the order of tests matters."""
    base = name.split("(")[0].strip().lower()
    if base in ("boolean", "bool"):
        return "boolean"
    if base in ("date", "time", "datetime", "timestamp"):
        return "string"
    for parts, kind in ((("int",), "bigint"), (("char", "clob", "text"), "string"), (("blob",), "binary"), (("real", "floa", "doub"), "double")):
        if any(p in base for p in parts):
            return kind
    if m := re.fullmatch(r"(?:decimal|numeric)\s*\((\d+)(?:,\s*(\d+))?\)", name.strip().lower()):
        return f"decimal({m[1]},{m[2] or 0})"
    return "string"


@dataclass(frozen=True)
class Column:
    name: str
    declared: str
    type: str
    notnull: bool = False
    default: str | None = None
    check: str | None = None
    temporal: str | None = None
    value_set: str | None = None

    def field(self, nullable: bool) -> T.StructField:
        meta = {"declared": self.declared}
        meta |= {k: v for k, v in (("temporal", self.temporal), ("value_set", self.value_set)) if v}
        return T.StructField(self.name, T._parse_datatype_string(self.type), nullable, meta)


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    checks: tuple[str, ...] = ()
    strict: bool = False
    without_rowid: bool = False

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    @property
    def rowid_alias(self) -> str | None:
        """The key that numbers rows by itself."""
        if self.without_rowid or len(self.primary_key) != 1:
            return None
        found = self.column(self.primary_key[0])
        return found.name if found and found.declared.upper() == "INTEGER" else None

    def nullable(self, column: Column) -> bool:
        key = column.name.lower() in {k.lower() for k in self.primary_key}
        return not (column.notnull or column.name == self.rowid_alias or ((self.without_rowid or self.strict) and key))

    def schema(self) -> T.StructType:
        return T.StructType([c.field(self.nullable(c)) for c in self.columns])

    def storage(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type)) for c in self.columns])

    def keys(self) -> list[tuple[str, ...]]:
        return [k for k in (self.primary_key, *self.unique) if k]


@dataclass
class Registry:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        found = self.tables.get(name.lower())
        if found is None:
            raise SqlError(f"no table {name}; known: {', '.join(sorted(self.tables)) or 'none'}")
        return found

    def add(self, table: Table) -> None:
        self.tables[table.name.lower()] = table

    def to_json(self) -> str:
        return json.dumps({"tables": {k: asdict(v) for k, v in sorted(self.tables.items())}, "views": dict(sorted(self.views.items()))}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Registry:
        data = json.loads(text)
        out = cls(views=dict(data["views"]))
        for t in data["tables"].values():
            columns = tuple(Column(**c) for c in t.pop("columns"))
            lists = {k: tuple(tuple(tuple(y) if isinstance(y, list) else y for y in x) if isinstance(x, list) else x for x in t[k]) for k in ("primary_key", "unique", "foreign", "checks")}
            out.add(Table(columns=columns, **(t | lists)))
        return out

    def fingerprint(self) -> str:
        """SHA-256 over each part with its length in front."""
        digest = hashlib.sha256()
        for part in [x for k, v in sorted(self.tables.items()) for x in (k, json.dumps(asdict(v), sort_keys=True))] + [x for kv in sorted(self.views.items()) for x in kv]:
            data = part.encode()
            digest.update(len(data).to_bytes(8, "big") + data)
        return digest.hexdigest()

    @classmethod
    def of_frames(cls, frames: dict[str, T.StructType], keys: dict[str, tuple[str, ...]] | None = None) -> Registry:
        out = cls()
        for name, schema in frames.items():
            columns = tuple(Column(f.name, f.dataType.simpleString(), f.dataType.simpleString(), not f.nullable) for f in schema)
            out.add(Table(name, columns, tuple((keys or {}).get(name, ()))))
        return out


def parts(seen: list[Token]) -> list[list[Token]]:
    """Split at commas outside parentheses."""
    out, depth = [[]], 0
    for t in seen:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def closing(seen: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, len(seen)):
        depth += (seen[i].text == "(") - (seen[i].text == ")")
        if not depth:
            return i
    raise SqlError("a parenthesis isn't closed")


def names(seen: list[Token]) -> tuple[str, ...]:
    return tuple(unquote(p[0].text) for p in parts(seen))


def source(sql: str, seen: list[Token]) -> str:
    return sql[seen[0].start : seen[-1].end] if seen else ""


def parse_create(sql: str) -> Table:
    """A CREATE TABLE statement."""
    seen = tokens(sql)
    at = next(i for i, t in enumerate(seen) if t.is_word("table")) + 1
    if seen[at].is_word("if"):
        at += 3
    name = unquote(seen[at].text)
    at += 1
    while seen[at].text == ".":
        name = unquote(seen[at + 1].text)
        at += 2
    if seen[at].text != "(":
        raise SqlError(f"{name}: a column list is needed")
    end = closing(seen, at)
    tail = [t.text.lower() for t in seen[end + 1 :]]
    columns: list[Column] = []
    key: tuple[str, ...] = ()
    unique, foreign, checks = [], [], []
    for p in parts(seen[at + 1 : end]):
        first = p[0].text.lower()
        if p[0].kind == "word" and first in ("constraint", "primary", "unique", "check", "foreign"):
            if first == "constraint":
                p = p[2:]
                first = p[0].text.lower()
            open_at = next(i for i, t in enumerate(p) if t.text == "(")
            inner = p[open_at + 1 : closing(p, open_at)]
            if first == "primary":
                key = names(inner)
            elif first == "unique":
                unique.append(names(inner))
            elif first == "check":
                checks.append(source(sql, inner))
            elif first == "foreign":
                rest = p[closing(p, open_at) + 1 :]
                foreign.append((names(inner), *reference(rest[1:])))
            continue
        column, own_key, own_unique, own_foreign = parse_column(sql, p)
        columns.append(column)
        key = (column.name,) if own_key else key
        unique += [(column.name,)] if own_unique else []
        foreign += [((column.name,), *own_foreign)] if own_foreign else []
    return Table(name, tuple(columns), key, tuple(unique), tuple(foreign), tuple(checks), "strict" in tail, "rowid" in tail)


def reference(seen: list[Token]) -> tuple[str, tuple[str, ...]]:
    """What follows REFERENCES."""
    table = unquote(seen[0].text)
    if len(seen) > 1 and seen[1].text == "(":
        return table, names(seen[2 : closing(seen, 1)])
    return table, ()


def parse_column(sql: str, p: list[Token]):
    name = unquote(p[0].text)
    i = 1
    while i < len(p) and not p[i].is_word(*CONSTRAINT):
        i = closing(p, i) + 1 if p[i].text == "(" else i + 1
    declared = source(sql, p[1:i])
    notnull, key, unique, foreign, default, check, marker, label = False, False, False, None, None, None, False, None
    while i < len(p):
        t = p[i]
        if t.is_word("constraint"):
            label = unquote(p[i + 1].text).lower()
            i += 2
            continue
        if t.is_word("not"):
            notnull, i = True, i + 2
        elif t.is_word("primary"):
            key, i = True, i + 2
        elif t.is_word("unique"):
            unique, i = True, i + 1
        elif t.is_word("default"):
            end = closing(p, i + 1) if p[i + 1].text == "(" else i + 1 + (p[i + 1].text in "+-")
            default, i = source(sql, p[i + 1 : end + 1]), end + 1
        elif t.is_word("check"):
            end = closing(p, i + 1)
            check = source(sql, p[i + 2 : end])
            if label == "boolean":
                want = [name.lower(), "in", "(", "0", ",", "1", ")"]
                if declared.upper() not in ("INT", "INTEGER") or [unquote(x.text).lower() for x in p[i + 2 : end]] != want:
                    raise SqlError(f"{name}: the boolean marker is CHECK ({name} IN (0, 1)) on an INTEGER")
                marker, check = True, None
            i = end + 1
        elif t.is_word("references"):
            foreign = reference(p[i + 1 :])
            i += 2
        else:
            i += 1
        label = None
    kind = "boolean" if marker else declared_type(declared)
    return Column(name, declared, kind, notnull, default, check), key, unique, foreign


def with_column(table: Table, name: str, **changes) -> Table:
    return replace(table, columns=tuple(replace(c, **changes) if c.name.lower() == name.lower() else c for c in table.columns))
