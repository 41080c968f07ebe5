"""INSERT, UPDATE, DELETE, upserts and RETURNING over snapshot tables.

A statement is taken apart at its clauses; expressions stay SQL and go to
Catalyst.  INSERT adds a folder of rows.  UPDATE, DELETE and upserts look for
the files that hold rows they change, and write the rows of those files anew:
what changes in one folder, what stays in another.  Where WHERE has a subquery
or FROM another table, rows are told by their file and place in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import rewrite
from ..lower import lower
from ..sources.registry import Table, closing, parts
from ..text import SqlError, Token, quote, tokens, unquote
from .store import ConstraintError, Transaction, view

BATCH = 500  #: rows of one INSERT of a batch
CLAUSES = ("where", "returning", "from", "set", "on", "values", "select", "default")


@dataclass
class Mutation:
    kind: str  #: insert, update or delete
    table: str
    alias: str
    with_: str = ""
    columns: list[str] = field(default_factory=list)
    conflict: str = ""  #: replace, ignore, fail, abort, rollback of INSERT OR
    source: str = ""  #: SELECT or VALUES text; empty for DEFAULT VALUES
    values: bool = False
    sets: list[tuple[str, str]] = field(default_factory=list)
    from_: str = ""
    where: str = ""
    upsert_key: list[str] = field(default_factory=list)
    upsert: str = ""  #: nothing or update
    upsert_sets: list[tuple[str, str]] = field(default_factory=list)
    upsert_where: str = ""
    returning: str = ""


def top(seen: list[Token], words: tuple[str, ...], at: int) -> int:
    """Where one of the words comes next outside parentheses and CASE."""
    depth = 0
    for i in range(at, len(seen)):
        t = seen[i]
        depth += (t.text == "(") - (t.text == ")") + t.is_word("case") - (t.is_word("end") and depth > 0)
        if not depth and t.is_word(*words):
            return i
    return len(seen)


def cut(sql: str, seen: list[Token], a: int, b: int) -> str:
    return sql[seen[a].start : seen[b - 1].end] if b > a else ""


def assignments(sql: str, seen: list[Token]) -> list[tuple[str, str]]:
    out = []
    for p in parts(seen):
        at = next((i for i, t in enumerate(p) if t.text == "="), None)
        if at is None:
            raise SqlError("SET needs column = expression")
        out.append((unquote(p[at - 1].text), sql[p[at + 1].start : p[-1].end]))
    return out


def parse(sql: str) -> Mutation | None:
    """The parts of a mutation; None for any other statement."""
    seen = tokens(sql)
    start = 0
    if seen[0].is_word("with"):
        start = top(seen, ("insert", "replace", "update", "delete", "select"), 1)
    verb = seen[start].text.lower() if start < len(seen) else ""
    if verb not in ("insert", "replace", "update", "delete"):
        return None
    with_ = cut(sql, seen, 0, start)
    ret = top(seen, ("returning",), start)
    returning = cut(sql, seen, ret + 1, len(seen))
    seen = seen[:ret]
    at = start + 1
    conflict = "replace" if verb == "replace" else ""
    if seen[at].is_word("or"):
        conflict, at = seen[at + 1].text.lower(), at + 2
    if seen[at].is_word("into", "from"):
        at += 1
    name = unquote(seen[at].text)
    at += 1
    while at < len(seen) and seen[at].text == ".":
        name, at = unquote(seen[at + 1].text), at + 2
    alias = name
    if at < len(seen) and seen[at].is_word("as"):
        alias, at = unquote(seen[at + 1].text), at + 2
    elif at < len(seen) and seen[at].kind in ("word", "name") and not seen[at].is_word(*CLAUSES):
        alias, at = unquote(seen[at].text), at + 1
    m = Mutation("insert" if verb == "replace" else verb, name, alias, with_, conflict=conflict, returning=returning)
    if m.kind == "delete":
        w = top(seen, ("where",), at)
        m.where = cut(sql, seen, w + 1, len(seen))
    elif m.kind == "update":
        if not seen[at].is_word("set"):
            raise SqlError("UPDATE needs SET")
        f, w = top(seen, ("from",), at), top(seen, ("where",), at)
        m.sets = assignments(sql, seen[at + 1 : min(f, w)])
        m.from_, m.where = cut(sql, seen, f + 1, w), cut(sql, seen, w + 1, len(seen))
    else:
        if seen[at].text == "(":
            end = closing(seen, at)
            m.columns = [unquote(p[0].text) for p in parts(seen[at + 1 : end])]
            at = end + 1
        on = at
        while (on := top(seen, ("on",), on)) < len(seen) and not (on + 1 < len(seen) and seen[on + 1].is_word("conflict")):
            on += 1
        if not seen[at].is_word("default"):
            m.source, m.values = cut(sql, seen, at, on), seen[at].is_word("values")
            if m.values:
                rows = [closing(seen, i) - i - 1 and len(parts(seen[i + 1 : closing(seen, i)])) for i in range(at + 1, on) if seen[i].text == "(" and not depth_of(seen, at + 1, i)]
                want = len(m.columns) or None
                for number, n in enumerate(rows, 1):
                    want = want or n
                    if n != want:
                        raise SqlError(f"row {number} of VALUES has {n} values for {want} columns")
        if on < len(seen):
            at = on + 2
            if seen[at].text == "(":
                end = closing(seen, at)
                m.upsert_key = [unquote(p[0].text) for p in parts(seen[at + 1 : end])]
                at = end + 1
            do = top(seen, ("do",), at)
            m.upsert = seen[do + 1].text.lower()
            if m.upsert == "update":
                w = top(seen, ("where",), do)
                m.upsert_sets = assignments(sql, seen[do + 3 : w])
                m.upsert_where = cut(sql, seen, w + 1, len(seen))
    return m


def depth_of(seen: list[Token], a: int, b: int) -> int:
    return sum((t.text == "(") - (t.text == ")") for t in seen[a:b])


@dataclass
class Result:
    count: int
    rows: DataFrame | None = None  #: of RETURNING


class Executor:
    """Runs mutations in a transaction."""

    def __init__(self, tx: Transaction):
        self.tx = tx

    def run(self, sql: str, args: dict | None = None) -> Result:
        lowered, _ = lower(sql)
        m = parse(lowered)
        if m is None:
            if tokens(lowered)[0].is_word("create", "drop", "alter", "pragma", "analyze"):
                from ..lifecycle import execute  # it runs mutations of files through this class

                execute(self.tx, lowered)
                return Result(0)
            raise SqlError("this statement changes no rows")
        table = self.tx.registry.table(m.table)
        return getattr(self, m.kind)(m, table, args or {})

    def sql(self, session: SparkSession, sql: str, args: dict) -> DataFrame:
        _, used = lower(sql)
        return session.sql(rewrite(sql), args={p.name: args[p.name] for p in used if p.name in args})

    def rows(self, m: Mutation, df: DataFrame, args: dict) -> DataFrame | None:
        """What RETURNING gives of the changed rows."""
        if not m.returning:
            return None
        session = self.tx.session()
        view(session, df, m.table)
        return self.sql(session, f"SELECT {m.returning} FROM {quote(m.table)} AS {quote(m.alias)}", args)

    def added(self, m: Mutation, table: Table, new: DataFrame, args: dict) -> Result:
        """Appends rows."""
        path = self.tx.segment(table.name, new)
        made = self.tx.read(table.name, [path])
        if count := made.count():
            self.tx.append(table.name, path)
        return Result(count, self.rows(m, made, args))

    def changed(self, m: Mutation, table: Table, hits: DataFrame, args: dict, new, kept=None) -> Result:
        """Writes anew the files that hold ``hits`` (_file, _pos).

        ``new``: from the session with those files as ``_touched`` to the rows
        that come instead, or None; ``kept``: to those that stay, else the rows
        that aren't hit.
        """
        counts = hits.groupBy("_file").agg(F.count("*").alias("n")).collect()  # a row for each file
        files = [r["_file"] for r in counts]
        ends = {tuple(f.rsplit("/", 2)[-2:]) for f in files}
        paths = [f for f in self.tx.parquet_files(table.name) if tuple(f.rsplit("/", 2)[-2:]) in ends]
        session = self.tx.session()
        touched = self.tx.located(table.name, paths)
        view(session, touched, "_touched")
        made = on_root(self.tx, new(session)) if new else None
        count = sum(r["n"] for r in counts)
        if made is not None:
            path = self.tx.segment(table.name, made)
            made = self.tx.read(table.name, [path])
            count = made.count()
        else:
            path, made = None, touched.join(hits, ["_file", "_pos"], "left_semi").drop("_file", "_pos")
        if files:
            stays = on_root(self.tx, kept(session)) if kept else touched.join(hits.select("_file", "_pos"), ["_file", "_pos"], "left_anti")
            self.tx.replace_files(table.name, files, self.tx.segment(table.name, stays), path)
        elif count and path:
            self.tx.append(table.name, path)
        return Result(count, self.rows(m, made, args))

    def place(self, m: Mutation, table: Table, extra: list[str], args: dict) -> DataFrame:
        """(_file, _pos, extra expressions) of the rows that WHERE and FROM choose."""
        session = self.tx.session()
        view(session, self.tx.located(table.name), m.table)
        where = f" WHERE {m.where}" if m.where else ""
        from_ = f", {m.from_}" if m.from_ else ""
        alias = quote(m.alias)
        picked = ", ".join([f"{alias}._file AS _file", f"{alias}._pos AS _pos", *extra])
        return on_root(self.tx, self.sql(session, f"{m.with_} SELECT {picked} FROM {quote(m.table)} AS {alias}{from_}{where}", args))

    def delete(self, m: Mutation, table: Table, args: dict) -> Result:
        hits = self.place(m, table, [], args)
        return self.changed(m, table, hits, args, None, self.unhit(m, args))

    def unhit(self, m: Mutation, args: dict):
        """The rows of the touched files for which a plain WHERE doesn't hold."""
        if m.from_ or any(t.is_word("select") for t in tokens(m.where)):
            return None
        return lambda session: self.sql(session, f"{m.with_} SELECT * FROM _touched AS {quote(m.alias)} WHERE NOT coalesce({m.where or 'true'}, false)", args)

    def update(self, m: Mutation, table: Table, args: dict) -> Result:
        for name, _ in m.sets:
            if table.column(name) is None:
                raise SqlError(f"{table.name} has no column {name}")
        new = {c.lower(): f"CAST({e} AS {table.column(c).type})" for c, e in m.sets}
        alias = quote(m.alias)
        if not m.from_:
            cols = ", ".join(f"{new.get(c.name.lower(), f'{alias}.{quote(c.name)}')} AS {quote(c.name)}" for c in table.columns)
            where = f" WHERE {m.where}" if m.where else ""
            made = lambda session: self.sql(session, f"{m.with_} SELECT {cols} FROM _touched AS {alias}{where}", args)
            return self.changed(m, table, self.place(m, table, [], args), args, made, self.unhit(m, args))
        # Of several rows of FROM that meet a row, the one with the smallest new values.
        each = self.place(m, table, [f"{e} AS {quote('_new_' + c)}" for c, e in new.items()], args)
        hits = each.groupBy("_file", "_pos").agg(F.min(F.struct(*(quote("_new_" + c) for c in new))).alias("_best"))

        def made(session):
            touched = on_root(self.tx, session.table("_touched")).join(hits, ["_file", "_pos"])
            return touched.select(*(F.col(f"_best.{quote('_new_' + c.name.lower())}").alias(c.name) if c.name.lower() in new else F.col(quote(c.name)) for c in table.columns))

        return self.changed(m, table, hits, args, made)

    def incoming(self, m: Mutation, table: Table, args: dict) -> DataFrame:
        """New rows with all columns: given ones, defaults, numbered keys."""
        names = m.columns or [c.name for c in table.columns]
        for n in names:
            if table.column(n) is None:
                raise SqlError(f"{table.name} has no column {n}")
        session = self.tx.session()
        if m.source:
            given = self.sql(session, f"{m.with_} SELECT * FROM ({m.source})" if m.values else f"{m.with_} {m.source}", args)
            if len(given.columns) != len(names):
                raise SqlError(f"{len(given.columns)} values for {len(names)} columns of {table.name}")
            given = given.toDF(*(f"_{i}" for i in range(len(names))))
        else:
            given, names = session.range(1).select(), []
        given = on_root(self.tx, given)
        place = {n.lower(): f"_{i}" for i, n in enumerate(names)}
        out = []
        for c in table.columns:
            if c.name.lower() in place:
                value = F.col(place[c.name.lower()])
            elif c.default is not None:
                value = F.expr(rewrite(c.default))
            else:
                value = F.lit(None)
            out.append(value.cast(c.type).alias(c.name))
        rows = given.select(*out)
        if alias := table.rowid_alias:
            known = rows.filter(F.col(quote(alias)).isNotNull())
            unknown = rows.filter(F.col(quote(alias)).isNull())
            if not unknown.isEmpty():
                last = max(r[0] or 0 for f in (self.tx.read(table.name), known) for r in f.agg(F.max(quote(alias))).collect())
                rows = known.unionByName(numbered(unknown, alias, last))
        return rows

    def insert(self, m: Mutation, table: Table, args: dict) -> Result:
        new = self.incoming(m, table, args)
        action = m.conflict or ("ignore" if m.upsert == "nothing" else "update" if m.upsert else "")
        keys = [tuple(m.upsert_key)] if m.upsert_key else table.keys()
        if action in ("", "abort", "fail", "rollback"):
            return self.added(m, table, new, args)
        if not keys:
            raise SqlError(f"{table.name} has no key for a conflict")
        if action == "replace":
            for key in keys:
                new = last_of(new, key)
            held = self.tx.located(table.name)
            hits = reduce(DataFrame.unionAll, (held.join(new.select(*map(quote, key)).dropna(), list(key), "left_semi").select("_file", "_pos") for key in keys)).distinct()
            return self.changed(m, table, hits, args, lambda session: new)
        if action == "ignore":
            current = self.tx.read(table.name)
            for key in keys:
                new = first_of(new, key).join(current.select(*map(quote, key)), list(key), "left_anti").select(new.columns)
            return self.added(m, table, new, args)
        if action == "update":
            return self.upsert(m, table, new, keys[0], args)
        raise SqlError(f"INSERT OR {action.upper()} isn't known")

    def upsert(self, m: Mutation, table: Table, new: DataFrame, key: tuple[str, ...], args: dict) -> Result:
        if not new.groupBy(*map(quote, key)).count().filter("count > 1").isEmpty():
            raise ConstraintError(f"rows of one INSERT meet in UNIQUE ({', '.join(key)})")
        alias = quote(m.alias)
        same = " AND ".join(f"{alias}.{quote(k)} = excluded.{quote(k)}" for k in key)
        where = f" WHERE {m.upsert_where}" if m.upsert_where else ""
        sets = {c.lower(): e for c, e in m.upsert_sets}
        cols = ", ".join(f"CAST({sets[c.name.lower()]} AS {c.type}) AS {quote(c.name)}" if c.name.lower() in sets else f"{alias}.{quote(c.name)}" for c in table.columns)
        session = self.tx.session()
        view(session, self.tx.located(table.name), m.table)
        view(session, new, "excluded")
        hits = on_root(self.tx, self.sql(session, f"SELECT {alias}._file AS _file, {alias}._pos AS _pos FROM {quote(m.table)} AS {alias} JOIN excluded ON {same}{where}", args))
        fresh = new.join(self.tx.read(table.name).select(*map(quote, key)), list(key), "left_anti").select(new.columns)

        def made(touched):
            view(touched, new, "excluded")
            merged = self.sql(touched, f"SELECT {cols} FROM _touched AS {alias} JOIN excluded ON {same}{where}", args)
            return on_root(self.tx, merged).unionAll(fresh)

        return self.changed(m, table, hits, args, made)

    def batch(self, sql: str, rows: list[dict]) -> int:
        """One statement for each set of arguments, in one transaction.

        INSERTs of one row of VALUES become one INSERT of many, which adds one
        folder; other statements run one after another, as each may change what
        the next one sees.
        """
        lowered, places = lower(sql)
        m = parse(lowered)
        names = [p.name for p in places]
        plain = m is not None and m.kind == "insert" and m.values and not m.returning and m.upsert != "update" and not m.with_
        values = lowered[lowered.index(m.source) :] if plain else ""
        if not plain or len(rows) < 2 or sum(t.text == "(" and not depth_of(tokens(m.source), 1, i) for i, t in enumerate(tokens(m.source)) if i) != 1:
            return sum(self.run(sql, args).count for args in rows)
        one = m.source[tokens(m.source)[1].start :]
        total = 0
        for at in range(0, len(rows), BATCH):
            part, given, args = rows[at : at + BATCH], [], {}
            for n, row in enumerate(part):
                given.append("".join(f":{t.text[1:]}_{n}" if t.kind == "param" else t.text for t in tokens(one, skip=False)))
                args |= {f"{k}_{n}": row[k] for k in names}
            made = lowered[: len(lowered) - len(values)] + "VALUES " + ", ".join(given) + values[len(m.source) :]
            total += self.run(made, args).count
        return total


def numbered(df: DataFrame, column: str, last: int) -> DataFrame:
    """``column`` counts the rows from ``last`` + 1, in their order.

    Only the partitions' sizes are gathered; rows stay where they are.
    """
    low = (1 << 33) - 1  # of the id that Spark gives a row within its partition
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    part, place = F.shiftrightunsigned("_m", 33), F.col("_m").bitwiseAND(F.lit(low))
    sizes = marked.groupBy(part.alias("_p")).agg((F.max(place) + 1).alias("_n")).orderBy("_p").collect()
    starts, at = [], last
    for r in sizes:
        starts.append((r["_p"], at))
        at += r["_n"]
    table = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    out = marked.withColumn("_p", part).join(F.broadcast(table), "_p")  # a row for each partition
    return out.withColumn(column, F.col("_start") + F.col("_m").bitwiseAND(F.lit(low)) + 1).select(df.columns)


def on_root(tx: Transaction, df: DataFrame) -> DataFrame:
    """The same plan in the store's own session."""
    spark = tx.store.spark
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed()), spark)


def first_of(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*map(quote, key)).orderBy("_at")
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_at", "_k")


def last_of(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*map(quote, key)).orderBy(F.desc("_at"))
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_at", "_k")
