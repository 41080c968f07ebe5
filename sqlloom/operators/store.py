"""Snapshot tables: immutable Parquet files behind one pointer.

A table is a list of folders and files.  Statements add folders of new rows and
leave out files whose rows they changed; a commit then swaps the pointer file,
so that all tables of a transaction change at once.  Readers keep the pointer
that they opened.  Declared keys, NOT NULL, checks and references are verified
as DataFrame queries before the swap, on the rows that were added, and on the
children of tables that lost rows.  One writer holds the lock file; a lock that
is older than ``LOCK_SECONDS`` belongs to a writer that died.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import rewrite
from ..sources.files import Files
from ..sources.registry import Registry, Table
from ..text import SqlError, quote

POINTER, LOCK = "pointer.json", "writer.lock"
LOCK_SECONDS = 6 * 3600


class ConstraintError(SqlError):
    """Rows that break a declared constraint."""


class Snapshot:
    """One state of a database; reads never see later commits."""

    def __init__(self, store: Store, state: dict):
        self.store, self.state = store, state
        self.registry = Registry.from_json(state["registry"])

    @property
    def version(self) -> int:
        return self.state["version"]

    def read(self, name: str, paths: list[str] | None = None) -> DataFrame:
        """The rows of a table, or of some of its folders and files."""
        table = self.registry.table(name)
        paths = self.state["paths"].get(name.lower(), []) if paths is None else paths
        spark = self.store.spark
        if not paths:
            return spark.createDataFrame(spark.sparkContext.emptyRDD(), table.storage())
        return spark.read.schema(table.storage()).parquet(*(f"{self.store.root}/{p}" for p in paths))

    def located(self, name: str, paths: list[str] | None = None) -> DataFrame:
        """With each row's file and its place there, which no later scan changes."""
        df = self.read(name, paths)
        if not (self.state["paths"].get(name.lower(), []) if paths is None else paths):
            return df.withColumns({"_file": F.lit(""), "_pos": F.lit(0).cast("long")})
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))

    def parquet_files(self, name: str) -> list[str]:
        """Every file of a table."""
        out = []
        for p in self.state["paths"].get(name.lower(), []):
            out += [p] if p.endswith(".parquet") else [f"{p}/{f}" for f in self.store.files.names(p) if f.endswith(".parquet")]
        return out

    def session(self) -> SparkSession:
        """A session of its own with a view for each table and view."""
        session = self.store.spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            value = self.store.spark.conf.get(key, None)
            if value is not None:
                session.conf.set(key, value)
        for name in self.registry.tables:
            view(session, self.read(name), name)
        create_views(session, self.registry.views)
        catalog(session, self.registry)
        return session


def catalog(session: SparkSession, registry: Registry) -> None:
    """``sqlite_schema`` and ``sqlite_master``: the declared tables and views."""
    rows = [("table", t.name, t.name, None, create_text(t)) for t in registry.tables.values()]
    rows += [("view", n, n, None, f"CREATE VIEW {n} AS {sql}") for n, sql in registry.views.items()]
    frame = session.createDataFrame(rows, "type string, name string, tbl_name string, rootpage int, sql string")
    for name in ("sqlite_schema", "sqlite_master"):
        if name not in registry.tables and name not in registry.views:
            frame.createOrReplaceTempView(name)


def create_text(t: Table) -> str:
    """A table's declaration."""
    lines = []
    for c in t.columns:
        line = f"  {c.name} {c.declared}"
        line += " NOT NULL" if c.notnull else ""
        line += f" DEFAULT {c.default}" if c.default else ""
        line += f" CONSTRAINT boolean CHECK ({c.name} IN (0, 1))" if c.type == "boolean" and "int" in c.declared.lower() else ""
        line += f" CHECK ({c.check})" if c.check else ""
        lines.append(line + (" PRIMARY KEY" if t.primary_key == (c.name,) else ""))
    if len(t.primary_key) > 1:
        lines.append(f"  PRIMARY KEY ({', '.join(t.primary_key)})")
    lines += [f"  UNIQUE ({', '.join(u)})" for u in t.unique]
    lines += [f"  CHECK ({c})" for c in t.checks]
    lines += [f"  FOREIGN KEY ({', '.join(a)}) REFERENCES {p}" + (f" ({', '.join(k)})" if k else "") for a, p, k in t.foreign]
    tail = ", ".join(w for w, on in (("STRICT", t.strict), ("WITHOUT ROWID", t.without_rowid)) if on)
    return f"CREATE TABLE {t.name} (\n" + ",\n".join(lines) + f"\n){' ' + tail if tail else ''}"


def view(session: SparkSession, df: DataFrame, name: str) -> None:
    """Registers a frame of another session of the same context."""
    frame = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().logical())
    frame.createOrReplaceTempView(name)


def create_views(session: SparkSession, views: dict[str, str]) -> None:
    """Temporary views, each after those that it reads."""
    pending = dict(views)
    while pending:
        done, why = [], None
        for name, sql in pending.items():
            try:
                session.sql(f"CREATE OR REPLACE TEMPORARY VIEW {quote(name)} AS {rewrite(sql)}")
                done.append(name)
            except Exception as e:
                others = set(pending) - {name}
                why = why if why and any(f"`{o}`" in str(e) for o in others) else (name, e)
        if not done:
            raise SqlError(f"view {why[0]} can't be resolved: {str(why[1])[:300]}")
        for name in done:
            del pending[name]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)

    def snapshot(self) -> Snapshot:
        if not self.files.exists(POINTER):
            return Snapshot(self, {"version": 0, "paths": {}, "registry": Registry().to_json(), "applied": []})
        return Snapshot(self, json.loads(self.files.read(POINTER)))

    def begin(self) -> Transaction:
        return Transaction(self)

    def drop(self) -> None:
        self.files.delete("")

    def vacuum(self) -> list[str]:
        """Removes folders and files that the current pointer doesn't name."""
        named = {p for paths in self.snapshot().state["paths"].values() for p in paths}
        partly = {p.rpartition("/")[0] for p in named if p.endswith(".parquet")}
        gone = []
        for table in self.files.names("data"):
            for version in self.files.names(f"data/{table}"):
                path = f"data/{table}/{version}"
                rest = [] if path in named else [f"{path}/{f}" for f in self.files.names(path)] if path in partly else [path]
                for old in rest:
                    if old not in named:
                        self.files.delete(old)
                        gone.append(old)
        return gone


class Transaction(Snapshot):
    """Writes that become visible together; use as a context manager."""

    def __init__(self, store: Store):
        base = store.snapshot()
        super().__init__(store, json.loads(json.dumps(base.state)))
        self.base = base.version
        self.touched: set[str] = set()
        self.added: dict[str, list[str] | None] = {}  #: folders of new rows; None where all rows count as new
        self.shrunk: set[str] = set()  #: tables that lost rows
        self.written: list[str] = []
        self.open = False
        self.check_foreign = True

    def __enter__(self) -> Transaction:
        mine = json.dumps({"writer": uuid.uuid4().hex, "began": time.time()})
        if not self.store.files.create(LOCK, mine):
            try:
                began = json.loads(self.store.files.read(LOCK))["began"]
            except ValueError:  # just being written
                began = time.time()
            if time.time() - began < LOCK_SECONDS:
                raise SqlError("another writer holds the database")
            self.store.files.replace(LOCK, mine)
            if self.store.files.read(LOCK) != mine:
                raise SqlError("another writer holds the database")
        self.open = True
        return self

    def __exit__(self, kind, value, trace) -> None:
        try:
            if kind is None:
                self.commit()
            else:
                self.rollback()
        finally:
            self.store.files.delete(LOCK)
            self.open = False

    def segment(self, name: str, df: DataFrame) -> str:
        """Writes rows with the declared columns in order; the folder's path."""
        if not self.open:
            raise SqlError("writing needs an open transaction")
        table = self.registry.table(name)
        path = f"data/{name.lower()}/{uuid.uuid4().hex}"
        df.select(*(F.col(quote(c.name)).cast(c.type).alias(c.name) for c in table.columns)).write.parquet(f"{self.store.root}/{path}")
        self.written.append(path)
        return path

    def write(self, name: str, df: DataFrame) -> None:
        """All rows of a table anew."""
        self.state["paths"][name.lower()] = [self.segment(name, df)]
        self.added[name.lower()] = None
        self.touched.add(name.lower())
        self.shrunk.add(name.lower())

    def append(self, name: str, *paths: str) -> None:
        key = name.lower()
        self.state["paths"][key] = [*self.state["paths"].get(key, []), *paths]
        if self.added.setdefault(key, []) is not None:
            self.added[key] += paths
        self.touched.add(key)

    def replace_files(self, name: str, gone: list[str], kept: str, new: str | None = None) -> None:
        """Files go, the rows of theirs that stay are in ``kept``."""
        key = name.lower()
        ends = {tuple(f.rsplit("/", 2)[-2:]) for f in gone}
        rest = [f for f in self.parquet_files(name) if tuple(f.rsplit("/", 2)[-2:]) not in ends]
        if self.added.get(key):  # new rows of this transaction may have moved on into the kept ones
            self.added[key] = None
        self.state["paths"][key] = [*rest, kept]
        self.shrunk.add(key)
        self.touched.add(key)
        if new:
            self.append(name, new)

    def create(self, table: Table) -> None:
        if table.name.lower() in self.registry.tables:
            raise SqlError(f"table {table.name} exists")
        self.registry.add(table)

    def drop(self, name: str) -> None:
        self.registry.table(name)
        del self.registry.tables[name.lower()]
        self.state["paths"].pop(name.lower(), None)
        self.shrunk.add(name.lower())

    def commit(self) -> int:
        self.check()
        if self.store.snapshot().version != self.base:
            raise SqlError("the database changed since this transaction began")
        self.state |= {"version": self.base + 1, "registry": self.registry.to_json()}
        self.store.files.replace(POINTER, json.dumps(self.state))
        return self.base + 1

    def check(self) -> None:
        """Constraints of what this transaction changed."""
        for name in sorted(self.touched & set(self.registry.tables)):
            verify(self, self.registry.table(name), self.added.get(name, []))
        if self.check_foreign and (broken := foreign_violations(self, self.added, self.shrunk)):
            raise ConstraintError("; ".join(f"{t} refers to {p}: {n} rows without a parent" for t, p, n in broken))

    def rollback(self) -> None:
        for path in self.written:
            self.store.files.delete(path)


def verify(snapshot: Snapshot, table: Table, added: list[str] | None = None) -> None:
    """NOT NULL, checks and keys of a table: of all rows, or of those in the
    folders ``added`` among the others, which hold the constraints already."""
    if added is not None and not added:
        return
    df = snapshot.read(table.name, added)
    tests = {f"{table.name}.{c.name} is NOT NULL": F.col(quote(c.name)).isNull() for c in table.columns if not table.nullable(c)}
    for c in table.columns:
        if c.check:
            tests[f"{table.name}.{c.name}: CHECK ({c.check})"] = ~F.coalesce(F.expr(rewrite(c.check)), F.lit(True))
    for check in table.checks:
        tests[f"{table.name}: CHECK ({check})"] = ~F.coalesce(F.expr(rewrite(check)), F.lit(True))
    if tests:
        counts = df.agg(*(F.count_if(t).alias(str(i)) for i, t in enumerate(tests.values()))).first()
        for what, n in zip(tests, counts, strict=True):
            if n:
                raise ConstraintError(f"{what}: {n} rows break it")
    others = [p for p in snapshot.state["paths"].get(table.name.lower(), []) if p not in (added or [])] if added is not None else []
    for key in table.keys():
        columns = [F.col(quote(k)).alias(f"k{i}") for i, k in enumerate(key)]
        mine = df.select(*columns).dropna()
        twice = mine.groupBy(*mine.columns).count().filter("count > 1").limit(1).collect()
        if not twice and others:
            twice = snapshot.read(table.name, others).select(*columns).join(mine, mine.columns, "left_semi").limit(1).collect()
        if twice:
            raise ConstraintError(f"{table.name}: UNIQUE ({', '.join(key)}) has {tuple(twice[0])[: len(key)]} twice")


def foreign_violations(snapshot: Snapshot, added: dict[str, list[str] | None] | None = None, shrunk: set[str] | None = None) -> list[tuple[str, str, int]]:
    """(table, parent, rows without a parent) for each broken reference.

    With ``added`` and ``shrunk``: of new rows, and of all children of tables
    that lost rows.
    """
    out = []
    for table in snapshot.registry.tables.values():
        for columns, parent, keys in table.foreign:
            paths = None
            if added is not None and parent.lower() not in shrunk:
                paths = added.get(table.name.lower(), [])
                if paths is not None and not paths:
                    continue
            target = snapshot.registry.table(parent)
            child = snapshot.read(table.name, paths).select(*(F.col(quote(c)).alias(f"c{i}") for i, c in enumerate(columns))).dropna()
            held = snapshot.read(parent).select(*(F.col(quote(k)).alias(f"p{i}") for i, k in enumerate(keys or target.primary_key)))
            same = reduce(lambda a, b: a & b, (F.col(f"c{i}") == F.col(f"p{i}") for i in range(len(columns))))
            if n := child.join(held, same, "left_anti").count():
                out.append((table.name, parent, n))
    return out
