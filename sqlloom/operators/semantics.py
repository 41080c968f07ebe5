"""Semantic layers over plain columns: value sets, checked dates, scoped ids."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.registry import Registry, with_column
from ..text import SqlError, identifier, quote

NAME = re.compile(r"[A-Z][A-Za-z0-9]*\Z")


# Value sets


@dataclass(frozen=True)
class ValueSet:
    name: str
    values: tuple[str, ...]
    columns: tuple[tuple[str, str], ...] = ()  #: table and column

    def variants(self) -> dict[str, str]:
        """{Python name: value}."""
        return {identifier(v).upper() if v else "EMPTY": v for v in self.values}


def load_value_sets(path: str | Path, seen: tuple[Path, ...] = ()) -> dict[str, ValueSet]:
    """``[sets.Name]`` tables with ``values`` and ``columns``; ``imports`` lists
    other files, one level deep."""
    path = Path(path).resolve()
    data = tomllib.loads(path.read_text())
    if unknown := set(data) - {"sets", "imports"}:
        raise SqlError(f"{path}: unknown keys {', '.join(sorted(unknown))}")
    out: dict[str, ValueSet] = {}
    if seen and data.get("imports"):
        raise SqlError(f"{path}: an imported file can't import")
    for other in data.get("imports", []):
        for name, found in load_value_sets(path.parent / other, (*seen, path)).items():
            if name in out:
                raise SqlError(f"{path}: {name} is imported twice")
            out[name] = found
    for name, body in data.get("sets", {}).items():
        if not NAME.match(name):
            raise SqlError(f"{path}: {name!r} is no set name")
        if name in out:
            raise SqlError(f"{path}: {name} is defined twice")
        values = tuple(body.get("values", ()))
        if not values or len(set(values)) < len(values) or not all(isinstance(v, str) for v in values):
            raise SqlError(f"{path}: {name} needs distinct text values")
        found = ValueSet(name, values, tuple(tuple(c.split(".", 1)) for c in body.get("columns", ())))
        if len(found.variants()) < len(values):
            raise SqlError(f"{path}: values of {name} share a variant")
        if any(len(c) != 2 for c in found.columns):
            raise SqlError(f"{path}: columns of {name} are table.column")
        out[name] = found
    return out


def bind_value_sets(registry: Registry, sets: dict[str, ValueSet]) -> None:
    """Marks the columns; each must be there, be text and have one set."""
    for s in sets.values():
        for table_name, column_name in s.columns:
            table = registry.table(table_name)
            column = table.column(column_name)
            if column is None:
                raise SqlError(f"{s.name}: {table_name} has no column {column_name}")
            if column.type != "string":
                raise SqlError(f"{s.name}: {table_name}.{column_name} is {column.type}, not text")
            if column.value_set not in (None, s.name):
                raise SqlError(f"{table_name}.{column_name} has two value sets")
            registry.add(with_column(table, column.name, value_set=s.name))
    registry.value_sets = {**getattr(registry, "value_sets", {}), **sets}


def strict_value(column: Column, found: ValueSet, label: str) -> Column:
    """The column; reading a value outside the set fails and names it."""
    bad = F.raise_error(F.concat(F.lit(f"{label}: "), column, F.lit(f" is no {found.name}")))
    return F.when(column.isNull() | column.isin(*found.values), column).otherwise(bad)


# Dates and times as text

DATE = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,9})?$"


@dataclass(frozen=True)
class Temporal:
    """Suffixes of column names that hold text dates and times."""

    date: tuple[str, ...] = ("_on", "_date")
    datetime: tuple[str, ...] = ("_at",)
    strict: bool = False

    def kind(self, name: str) -> str | None:
        low = name.lower()
        if low.endswith(self.datetime):
            return "datetime"
        return "date" if low.endswith(self.date) else None


def bind_temporal(registry: Registry, rules: Temporal) -> None:
    if not rules.strict:
        return
    registry.temporal = rules
    for table in list(registry.tables.values()):
        for column in table.columns:
            kind = rules.kind(column.name)
            if not kind:
                continue
            if column.type != "string":
                raise SqlError(f"{table.name}.{column.name} is named as a {kind} and must be text, not {column.declared}")
            registry.add(with_column(registry.table(table.name), column.name, temporal=kind))


def strict_temporal(column: Column, kind: str, label: str) -> Column:
    """The column; text that is no real date or time fails the read."""
    shape, what = (DATE, "YYYY-MM-DD") if kind == "date" else (DATETIME, "YYYY-MM-DD HH:MM:SS[.fraction]")
    # Nine digits of fraction are more than a timestamp holds; six are tested.
    real = F.try_to_timestamp(F.substring(column, 1, 26)).isNotNull() if kind == "datetime" else F.try_to_timestamp(column, F.lit("yyyy-MM-dd")).isNotNull()
    bad = F.raise_error(F.concat(F.lit(f"{label}: "), column, F.lit(f" is not {what}")))
    return F.when(column.isNull() | (column.rlike(shape) & real), column).otherwise(bad)


def strict_read(df: DataFrame, sets: dict[str, ValueSet]) -> DataFrame:
    """Checks every column whose metadata names a value set or a text date."""
    out = []
    for f in df.schema:
        column = F.col(quote(f.name))
        if name := f.metadata.get("value_set"):
            column = strict_value(column, sets[name], f.name)
        if kind := f.metadata.get("temporal"):
            column = strict_temporal(column, kind, f.name)
        out.append(column.alias(f.name, metadata=f.metadata))
    return df.select(*out)


# Scoped ids


@dataclass(frozen=True)
class ScopedType:
    name: str
    gates: tuple[str, ...]  #: statements that may produce it


class ScopedId:
    """A row id that a registered gate has shown to be reachable.

    Tokens belong to the session and snapshot that produced them; there is no
    public way to make one.
    """

    __slots__ = ("_kind", "_owner", "_value")
    _key = object()

    def __init__(self, key, kind: str, value: int, owner: object):
        if key is not ScopedId._key:
            raise TypeError("scoped ids come from gates")
        self._kind, self._value, self._owner = kind, value, owner

    def __repr__(self) -> str:
        return f"<{self._kind}>"


@dataclass
class Scopes:
    types: dict[str, ScopedType] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Scopes:
        data = tomllib.loads(Path(path).read_text())
        out = cls()
        for name, body in data.get("scoped_ids", {}).items():
            if not NAME.match(name):
                raise SqlError(f"{name!r} is no scoped id")
            gates = tuple(body.get("gates", ()))
            if not gates:
                raise SqlError(f"{name}: a scoped id needs a gate")
            out.types[name] = ScopedType(name, gates)
        return out

    def produce(self, kind: str, gate: str, value: int | None, owner: object) -> ScopedId:
        if kind not in self.types:
            raise SqlError(f"{kind} isn't declared")
        if gate not in self.types[kind].gates:
            raise SqlError(f"{gate} is no gate of {kind}")
        if value is None:
            raise SqlError(f"{kind}: a scoped id is never null")
        return ScopedId(ScopedId._key, kind, int(value), owner)

    def consume(self, token: ScopedId, kind: str, owner: object) -> int:
        if not isinstance(token, ScopedId):
            raise TypeError(f"{kind} is needed, not {type(token).__name__}")
        if token._kind != kind:
            raise TypeError(f"{kind} is needed, not {token._kind}")
        if token._owner is not owner:
            raise SqlError(f"this {kind} is of another session")
        return token._value


# Canonical rows


def sync_plan(current: DataFrame, canonical: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``current`` with the canonical rows in it, and what became of each.

    Adds ``_action``: insert, update, same or, for other rows, other.  A row is
    updated only if a column differs, nulls counted as values.
    """
    a, b = current.alias("a"), canonical.select(*map(quote, [*key, *columns])).alias("b")
    on = [F.col(f"a.{quote(k)}").eqNullSafe(F.col(f"b.{quote(k)}")) for k in key]
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{quote(c)}").eqNullSafe(F.col(f"b.{quote(c)}"))
    both = a.withColumn("_held", F.lit(True)).alias("a").join(b.withColumn("_want", F.lit(True)).alias("b"), on, "full")
    action = F.when(F.col("_want").isNull(), "other").when(F.col("_held").isNull(), "insert").when(same, "same").otherwise("update")
    out = []
    for c in current.columns:
        mine, theirs = F.col(f"a.{quote(c)}"), F.col(f"b.{quote(c)}") if c in key or c in columns else None
        out.append((mine if theirs is None else F.when(F.col("_want"), theirs).otherwise(mine)).alias(c))
    return both.select(*out, action.alias("_action"))


def sync(tx, table: str, canonical: DataFrame, key: list[str], columns: list[str]) -> dict[str, int]:
    """Writes the canonical rows that are missing or differ, in the open
    transaction, and verifies that they are there; {action: rows}."""
    declared = tx.registry.table(table)
    current = tx.read(table)
    plan = sync_plan(current, canonical, key, columns)
    counts = {r["_action"]: r["n"] for r in plan.groupBy("_action").agg(F.count("*").alias("n")).collect()}
    if counts.get("insert") or counts.get("update"):
        tx.write(table, plan.drop("_action"))
        left = sync_plan(tx.read(table), canonical, key, columns).filter(F.col("_action").isin("insert", "update")).count()
        if left:
            raise SqlError(f"{declared.name}: {left} canonical rows aren't as they should be")
    return counts
