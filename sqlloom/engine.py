"""Bindings: statement blocks as Python callables that return DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, parse
from .functions import json_tables
from .functions.dialect import rewrite
from .lower import lower
from .operators.dml import Executor, Result
from .operators.semantics import Scopes, ValueSet, strict_temporal, strict_value
from .operators.store import Snapshot, Transaction
from .plans.contract import Contract
from .text import SqlError, overrides, quote, typed


def load(path: str | Path) -> dict[str, Block]:
    path = Path(path)
    return {b.name: b for b in parse(path.read_text(), str(path))}


def run(session: SparkSession, sql: str, args: dict | None = None, types: dict[str, str] | None = None, label: str = "") -> DataFrame:
    """A read statement in the embedded dialect with named arguments."""
    sql, _ = overrides(sql)
    lowered, places = lower(sql)
    args = args or {}
    names = [p.name for p in places]
    if missing := [n for n in names if n not in args]:
        raise SqlError(f"{label or 'statement'}: no value for {', '.join(missing)}")
    if extra := set(args) - set(names):
        raise SqlError(f"{label or 'statement'}: no parameter {', '.join(sorted(extra))}")
    nulls = {n: t for n, t in (types or {}).items() if args[n] is None}
    made = typed(rewrite(lowered), nulls)
    if "json_tree_rows" in made:
        json_tables.register(session)
    return session.sql(made, args={n: args[n] for n in names} or None)


PYTHON = {"bigint": int, "int": int, "string": str, "double": (float, int), "boolean": bool, "binary": (bytes, bytearray)}


class Statement:
    """A contract as a callable with keyword arguments only."""

    def __init__(self, contract: Contract, consume: Callable | None = None, sets: dict[str, ValueSet] | None = None, scopes: Scopes | None = None):
        self.contract, self.sets, self.scopes = contract, sets or {}, scopes
        self.consume = consume or (scopes.consume if scopes else None)
        self.__name__ = contract.name
        self.__doc__ = f"{contract.access} statement of {contract.path}"

    def arguments(self, given: dict, owner: object) -> dict:
        c = self.contract
        wanted = {p.name: p for p in c.parameters}
        if extra := set(given) - set(wanted):
            raise TypeError(f"{c.name}() has no parameter {', '.join(sorted(extra))}")
        if missing := [n for n in wanted if n not in given]:
            raise TypeError(f"{c.name}() needs {', '.join(missing)}")
        scoped = {name: kind for kind, name in c.consumes}
        out = {}
        for name, p in wanted.items():
            value = given[name]
            if name in scoped:
                if self.consume is None:
                    raise SqlError(f"{c.name}() takes a {scoped[name]}; bind it with its scopes")
                value = self.consume(value, scoped[name], owner)
            if value is None and not p.nullable:
                raise TypeError(f"{c.name}(): {name} is never null")
            kind = PYTHON.get(p.type)
            if value is not None and kind and (not isinstance(value, kind) or isinstance(value, bool) and p.type != "boolean"):
                raise TypeError(f"{c.name}(): {name} is {p.type}, not {type(value).__name__}")
            out[name] = value
        return out

    def sql(self, column: str | None) -> str:
        c = self.contract
        if c.choices and column not in c.choices:
            raise TypeError(f"{c.name}() needs column= one of {', '.join(c.choices)}")
        return c.variants.get(column if c.choices else None, c.sql)

    def read(self, session: SparkSession, **given) -> DataFrame:
        """The rows of a read statement, lazily.

        Reading a value outside a column's set, or text that is no date where
        one is declared, fails and names the value.
        """
        c = self.contract
        if c.access != "read":
            raise SqlError(f"{c.name} changes rows; it needs a transaction")
        session.sparkContext.setJobDescription(f"{c.path}#{c.name}")
        args = self.arguments({k: v for k, v in given.items() if k != "column"}, session)
        nulls = {p.name: p.type for p in c.parameters if args[p.name] is None}
        made = typed(self.sql(given.get("column")), nulls)
        if "json_tree_rows" in made:
            json_tables.register(session)
        return self.strict(session.sql(made, args=args or None))

    def strict(self, df: DataFrame) -> DataFrame:
        out, checked = [], False
        for name, c in zip(df.columns, self.contract.columns, strict=True):
            column = F.col(quote(name))
            if c.value_set in self.sets:
                column, checked = strict_value(column, self.sets[c.value_set], c.name).alias(name), True
            if c.temporal:
                column, checked = strict_temporal(column, c.temporal, c.name).alias(name), True
            out.append(column)
        return df.select(*out) if checked else df

    def one(self, session: SparkSession, **given):
        """The first row; an error where there is none.

        A gate's first columns are the scoped ids that it produces, in order.
        """
        found = self.read(session, **given).limit(1).collect()
        if not found:
            raise LookupError(f"{self.contract.name} found no row")
        kinds = self.contract.produces
        if not kinds:
            return found[0]
        if self.scopes is None:
            raise SqlError(f"{self.contract.name} produces {', '.join(kinds)}; bind it with its scopes")
        tokens = [self.scopes.produce(k, self.contract.name, v, session) for k, v in zip(kinds, found[0], strict=False)]
        return Row(*found[0].__fields__)(*tokens, *found[0][len(tokens) :])

    def execute(self, tx: Transaction, **given) -> Result:
        c = self.contract
        if c.access != "mutation":
            raise SqlError(f"{c.name} changes no rows")
        if not isinstance(tx, Transaction) or not tx.open:
            raise TypeError(f"{c.name}() needs an open transaction")
        args = self.arguments({k: v for k, v in given.items() if k != "column"}, tx)
        return Executor(tx).run(self.sql(given.get("column")), args)

    def batch(self, tx: Transaction, rows: list[dict]) -> int:
        if not self.contract.batch:
            raise SqlError(f"{self.contract.name} isn't declared as a batch")
        if self.contract.choices or not isinstance(tx, Transaction) or not tx.open:
            return sum(self.execute(tx, **r).count for r in rows)
        return Executor(tx).batch(self.contract.sql, [self.arguments(r, tx) for r in rows])


def bind(contracts: list[Contract], consume: Callable | None = None, sets: dict[str, ValueSet] | None = None, scopes: Scopes | None = None) -> dict[str, Statement]:
    return {c.name: Statement(c, consume, sets, scopes) for c in contracts}


def project(row: Row, kind: type, columns: dict[str, str] | None = None, functions: dict[str, Callable] | None = None):
    """A row as a dataclass: each field from the column of its name, or of the
    name in ``columns``, through the function in ``functions``."""
    values = row.asDict()
    out = {}
    for f in fields(kind):
        name = (columns or {}).get(f.name, f.name)
        if name not in values:
            raise SqlError(f"{kind.__name__}.{f.name}: the row has no column {name}")
        out[f.name] = (functions or {}).get(f.name, lambda v: v)(values[name])
    return kind(**out)


def snapshot_session(snapshot: Snapshot) -> SparkSession:
    return snapshot.session()
