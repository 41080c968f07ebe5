"""One query for each operator, with its oracle, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import engine
from ..blocks import Block
from ..operators import semantics
from ..operators.dml import Executor
from ..operators.store import Store, foreign_violations
from ..sources.files import shared_folder
from ..sources.registry import Registry, parse_create
from ..text import SqlError

HERE = Path(__file__).parent
READS = engine.load(HERE / "reads.sql")
WRITES = engine.load(HERE / "writes.sql")
ORACLES = engine.load(HERE / "oracles.sql")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Arguments of the parameterised reads; the oracles hold the same values.
ARGUMENTS: dict[str, dict] = {
    "star_expansion": {"region": 2},
    "no_from": {"value": 42},
    "filter_compare": {"least": 20000.0, "most": 90000.0},
    "filter_is": {"status": "O"},
    "optional_filter": {"status": "O", "custkey": None},
    "sentinel_filter": {"custkey": -1},
    "like_nocase": {"pattern": "%WIDGET%"},
    "in_list": {"a": 1, "b": 3},
    "between_range": {"low": 10, "high": 20},
    "join_inner": {"segment": "BUILDING"},
    "join_theta": {"step": 2},
    "agg_having": {"least": 12},
    "agg_filter": {"status": "F"},
    "order_case": {"first": "P"},
    "limit_offset": {"size": 20, "skip": 30},
    "topk": {"k": 10},
    "except_rows": {"least": 9000.0},
    "cte_single": {"least": 12},
    "cte_recursive": {"most": 150},
    "case_searched": {"high": 50000.0},
    "view_read": {"least": 13},
    "orders_by_customer": {"custkey": 7, "n": 5},
}
TYPES = {"optional_filter": {"status": "string", "custkey": "bigint"}, "like_nocase": {"pattern": "string"}}
VIEW = "SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY o_custkey"


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """A view for each table that the statement may name."""
    for name in TABLES:
        if name in sql or name == "orders":
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    if "busy_customers" in sql:
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW busy_customers AS {VIEW}")


def read(block: Block) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, block.sql)
        return engine.run(spark, block.sql, ARGUMENTS.get(block.name), TYPES.get(block.name), block.name)

    query.__name__ = block.name
    return query


# Writes, over copies in a store of their own

DDL = {
    "supplier": "CREATE TABLE supplier (s_suppkey INTEGER PRIMARY KEY, s_name TEXT NOT NULL, s_nationkey INT, s_acctbal REAL DEFAULT 0.0)",
    "nation": "CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey INT)",
}


def scratch(spark: SparkSession) -> str:
    """A new folder for a store."""
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def filled(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, scratch(spark))
    with store.begin() as tx:
        for name, ddl in DDL.items():
            tx.create(parse_create(ddl))
            tx.write(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return store


WRITE_ARGUMENTS: dict[str, list[dict]] = {
    "insert_batch": [{"key": 900_001, "name": "first"}, {"key": 900_002, "name": "second"}, {"key": 900_003, "name": "third"}],
    "update_where": [{"bonus": 10.5, "nation": 3}],
    "delete_where": [{"nation": 4}],
}


def write(block: Block) -> Callable[[SparkSession, str], DataFrame]:
    """The table after the statement, or what it returns."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = filled(spark, sf_dir)
        out = None
        with store.begin() as tx:
            if block.batch:
                Executor(tx).batch(block.sql, WRITE_ARGUMENTS[block.name])
            for args in [] if block.batch else WRITE_ARGUMENTS.get(block.name, [{}]):
                out = Executor(tx).run(block.sql, args)
        return out.rows if out is not None and out.rows is not None else store.snapshot().read("supplier")

    query.__name__ = block.name
    return query


# Semantic layers and lifecycle

STATUS = semantics.ValueSet("OrderStatus", ("F", "O", "P"), (("orders", "o_orderstatus"),))
FLAGS = semantics.ValueSet("ReturnFlag", ("A", "N", "R"), (("lineitem", "l_returnflag"),))


def value_set_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", semantics.strict_value(F.col("o_orderstatus"), STATUS, "o_orderstatus").alias("o_orderstatus"))


def value_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy(semantics.strict_value(F.col("l_returnflag"), FLAGS, "l_returnflag").alias("l_returnflag")).agg(F.count("*").alias("n"))


def temporal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    shown = events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), F.date_format("ts", "yyyy-MM-dd").alias("seen_on"))
    return shown.select("event_id", semantics.strict_temporal(F.col("seen_at"), "datetime", "seen_at").alias("seen_at"), semantics.strict_temporal(F.col("seen_on"), "date", "seen_on").alias("seen_on"))


def scoped_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order that the gate has shown to be the customer's."""
    views(spark, sf_dir, "orders lineitem")
    scopes = semantics.Scopes({"OrderId": semantics.ScopedType("OrderId", ("customers_order",))})
    gate = engine.run(spark, "select min(o_orderkey) as k from orders where o_custkey = @custkey", {"custkey": 7}).first()["k"]
    token = scopes.produce("OrderId", "customers_order", gate, spark)
    key = scopes.consume(token, "OrderId", spark)
    return engine.run(spark, "select l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey = @key", {"key": key})


REFERENCES = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id")]


def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a parent, for each reference."""
    out = None
    for child, column, parent, key in REFERENCES:
        a = spark.read.parquet(f"{sf_dir}/{child}.parquet").select(F.col(column).alias("k")).dropna()
        b = spark.read.parquet(f"{sf_dir}/{parent}.parquet").select(F.col(key).alias("k"))
        n = a.join(b, "k", "left_anti").agg(F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.count("*").alias("orphans"))
        out = n if out is None else out.unionAll(n)
    return out


def canonical_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))
    wanted = spark.createDataFrame([(0, "ATLANTIS", 0), (1, "NATION_1", 1), (99, "NEWLAND", 2)], nation.schema)
    return semantics.sync_plan(nation, wanted, ["n_nationkey"], ["n_name", "n_regionkey"])


def contract_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts of all read statements."""
    from ..plans import contract

    registry = Registry.of_frames({t: spark.read.parquet(f"{sf_dir}/{t}.parquet").schema for t in TABLES})
    registry.views["busy_customers"] = VIEW
    session = contract.shadow(spark, registry)
    return contract.report(spark, [contract.analyze(session, registry, b) for b in READS.values()])


def plan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import lint

    views(spark, sf_dir, " ".join(TABLES))
    found = []
    for name in READS:
        df = read(READS[name])(spark, sf_dir)
        found += [(name, f.kind, f.table or "", f.detail) for f in lint.findings(df, fixed=("region", "nation"))]
    return spark.createDataFrame(found, "statement string, kind string, source string, detail string")


def migration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..lifecycle import migrate, status

    store = Store(spark, scratch(spark))
    migrate(store, HERE / "migrations")
    return status(store, HERE / "migrations")


def migrated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the migrations and seeds of the catalogue leave."""
    from ..lifecycle import migrate, seed

    store = Store(spark, scratch(spark))
    migrate(store, HERE / "migrations")
    seed(store, HERE / "seeds")
    assert not foreign_violations(store.snapshot())
    return engine.run(store.snapshot().session(), "select name, kind, tags from open_notes")


def catalog_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store's own catalog says of its tables and views."""
    from ..lifecycle import migrate

    store = filled(spark, sf_dir)
    migrate(store, HERE / "migrations")
    return engine.run(store.snapshot().session(), "select type, name, tbl_name, sql like 'create ' || type || '%' as declared from sqlite_schema order by name")


def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a table before, kept and new after an INSERT, and rows changed
    by statements that are run one after another in one transaction."""
    store = filled(spark, sf_dir)
    before = set(store.snapshot().parquet_files("supplier"))
    with store.begin() as tx:
        run = Executor(tx).run
        counts = [run("insert into supplier (s_suppkey, s_name) values (900001, 'x')").count]
        counts.append(run("update supplier set s_name = 'y' where s_suppkey = 900001").count)
        counts.append(run("delete from supplier where s_suppkey = 900001").count)
        counts.append(run("delete from supplier where s_suppkey = 900001").count)
    after = set(store.snapshot().parquet_files("supplier"))
    return spark.createDataFrame([(len(before - after), *counts, store.snapshot().read("supplier").count())], "lost int, inserted int, updated int, deleted int, again int, suppliers long")


RULES = {
    "select o_orderkey from orders where o_orderstatus = 'O'": True,
    "select o_orderkey from orders where o_orderstatus = 'X'": False,
    "select o_orderkey from orders where o_orderstatus in ('F', @s)": True,
    "select upper(o_orderstatus) as u from orders": False,
    "select o_orderstatus as s from orders union select l_linestatus from lineitem": False,
    "select json_object('s', o_orderstatus) as j from orders": True,
    "select case o_orderstatus when 'Q' then 1 end as n from orders": False,
    "with t as (select o_orderstatus as s from orders) select s from t where s = 'P'": True,
    "with t as (select o_orderstatus as s from orders) select s from t where s = 'Y'": False,
}


def value_set_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements the value sets of the catalogue let pass."""
    from ..plans import contract

    registry = Registry.of_frames({t: spark.read.parquet(f"{sf_dir}/{t}.parquet").schema for t in TABLES})
    semantics.bind_value_sets(registry, {"OrderStatus": STATUS})
    session = contract.shadow(spark, registry)
    rows = []
    for sql in RULES:
        try:
            contract.analyze(session, registry, Block("q", sql, 1))
            rows.append((sql, True))
        except SqlError:
            rows.append((sql, False))
    return spark.createDataFrame(rows, "statement string, taken boolean")


def parameter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, nullability and slots of parameters, by the place where they stand."""
    from ..plans import contract

    registry = Registry.of_frames({t: spark.read.parquet(f"{sf_dir}/{t}.parquet").schema for t in TABLES})
    session = contract.shadow(spark, registry)
    rows = []
    for sql, _ in PLACES:
        c = contract.analyze(session, registry, Block("q", sql, 1))
        rows += [(sql, n, p.name, p.type, p.nullable) for n, p in enumerate(c.parameters, 1)]
    return spark.createDataFrame(rows, "statement string, slot int, name string, type string, nullable boolean")


#: Statements and what is known of their parameters.
PLACES = [
    ("select o_orderkey from orders where o_totalprice > ?", [("arg1", "double", False)]),
    ("select o_orderkey from orders where :a < o_totalprice and o_custkey = :b", [("a", "double", False), ("b", "bigint", False)]),
    ("select o_orderkey from orders where ($c is null or o_custkey = $c)", [("c", "bigint", True)]),
    ("select o_orderkey from orders where o_orderstatus in (@x, @y) limit ? offset ?", [("x", "string", False), ("y", "string", False), ("arg3", "bigint", False), ("arg4", "bigint", False)]),
    ("select p_partkey from part where p_retailprice between @low and @high", [("low", "double", False), ("high", "double", False)]),
    ("select cast(@n as integer) as n, cast(@t as text) as t", [("n", "bigint", False), ("t", "string", False)]),
    ("select case when o_custkey = 1 then @v else o_orderstatus end as s from orders", [("v", "string", False)]),
    ("select datetime(@seconds, 'unixepoch') as t", [("seconds", "bigint", False)]),
    ("select c_custkey from customer where c_acctbal > @a union all select s_suppkey from supplier where s_name = @b", [("a", "double", False), ("b", "string", False)]),
    ("insert into nation (n_nationkey, n_name) values (@key, @name)", [("key", "int", True), ("name", "string", True)]),
    ("update customer set c_name = @name where c_custkey = ?2", [("name", "string", True), ("arg2", "bigint", False)]),
]


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond parity: the stream of events in ten-minute windows."""
    from ..streaming.events import windows_once

    return windows_once(spark, sf_dir)


OTHERS = {f.__name__: f for f in (value_set_read, value_set_counts, temporal_check, scoped_children, fk_check, canonical_sync, contract_inspect, plan_findings, migration_status, migrated_rows, catalog_source, written_files, value_set_rules, parameter_rules, event_windows)}

def constant(rows: list[tuple], names: str) -> str:
    """Known rows as SQL."""
    shown = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) as t({names})"


OTHER_SQL = {
    "value_set_rules": constant(list(RULES.items()), "statement, taken"),
    "parameter_rules": constant([(sql, n, *p) for sql, known in PLACES for n, p in enumerate(known, 1)], "statement, slot, name, type, nullable"),
    "migration_status": constant([("001_notes", "applied"), ("002_open_notes", "applied")], "version, state"),
    "catalog_source": constant([("table", n, n, True) for n in ("kinds", "nation", "notes", "supplier")] + [("view", "open_notes", "open_notes", True)], "type, name, tbl_name, declared"),
    "written_files": "select 0 as lost, 1 as inserted, 1 as updated, 1 as deleted, 0 as again, count(*) as suppliers from supplier",
    "value_set_read": "select o_orderkey, o_orderstatus from orders",
    "value_set_counts": "select l_returnflag, count(*) as n from lineitem group by l_returnflag",
    "temporal_check": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as seen_at, strftime(ts, '%Y-%m-%d') as seen_on from events",
    "scoped_children": "select l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey = (select min(o_orderkey) from orders where o_custkey = 7)",
    "fk_check": " union all ".join(f"select '{c}' as child, '{p}' as parent, count(*) as orphans from {c} where {k} is not null and not exists (select 1 from {p} where {p}.{q} = {c}.{k})" for c, k, p, q in REFERENCES),
    "canonical_sync": """select coalesce(b.k, a.n_nationkey)::int as n_nationkey, coalesce(b.name, a.n_name) as n_name, coalesce(b.region, a.n_regionkey)::int as n_regionkey,
        case when b.k is null then 'other' when a.n_nationkey is null then 'insert' when a.n_name = b.name and a.n_regionkey = b.region then 'same' else 'update' end as _action
        from nation a full join (values (0, 'ATLANTIS', 0), (1, 'NATION_1', 1), (99, 'NEWLAND', 2)) as b(k, name, region) on a.n_nationkey = b.k""",
    "migrated_rows": "select * from (values ('alpha', 'plain', '[\"a\",\"b\"]'), ('gamma', 'urgent', '[]')) as t(name, kind, tags)",
    "event_windows": "select time_bucket(interval '10 minutes', ts) as start, event_type, count(*) as n from events group by 1, 2",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: read(b) for n, b in READS.items()} | {n: write(b) for n, b in WRITES.items()} | OTHERS


def oracles() -> dict[str, str]:
    """The oracle of a read without parameters is the read itself, unless the
    dialects differ."""
    out = {n: b.sql for n, b in READS.items() if n not in ARGUMENTS}
    return out | {n: b.sql for n, b in ORACLES.items()} | OTHER_SQL
