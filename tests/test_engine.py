import pytest
from pyspark.sql import functions as F

from sqlloom import engine, lifecycle, publish
from sqlloom.blocks import parse
from sqlloom.inventory import changed
from sqlloom.operators import semantics
from sqlloom.operators.dml import Executor
from sqlloom.operators.store import ConstraintError, Store, foreign_violations
from sqlloom.plans import contract, lint
from sqlloom.sources.discovery import ViewFile
from sqlloom.sources.registry import Registry, declared_type, parse_create
from sqlloom.text import SqlError

USERS = "CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, active INTEGER NOT NULL CONSTRAINT boolean CHECK (active IN (0, 1)), score REAL, nickname TEXT)"
ORDERS = "CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id INTEGER NOT NULL REFERENCES users (id), status TEXT NOT NULL, made_at TEXT, UNIQUE (user_id, made_at)) STRICT"


@pytest.fixture(scope="module")
def registry():
    r = Registry()
    r.add(parse_create(USERS))
    r.add(parse_create(ORDERS))
    return r


@pytest.fixture(scope="module")
def session(spark, registry):
    return contract.shadow(spark, registry)


def describe(session, registry, sql, name="q", head=""):
    return contract.analyze(session, registry, parse(f"-- func: {name}\n{head}{sql}")[0])


def test_declared_types():
    got = [declared_type(t) for t in ("BOOLEAN", "TIMESTAMP", "BIGINT", "POINT", "VARCHAR(3)", "BLOB", "DOUBLE PRECISION", "DECIMAL(10,2)", "POLYGON")]
    assert got == ["boolean", "string", "bigint", "bigint", "string", "binary", "double", "decimal(10,2)", "string"]


def test_create_table(registry):
    users, orders = registry.table("users"), registry.table("ORDERS")
    assert users.rowid_alias == "id" and users.column("active").type == "boolean"
    assert [users.nullable(c) for c in users.columns] == [False, False, False, True, True]
    assert orders.foreign == ((("user_id",), "users", ("id",)),) and orders.unique == (("user_id", "made_at"),)
    assert Registry.from_json(registry.to_json()).tables == registry.tables
    with pytest.raises(SqlError, match="boolean marker"):
        parse_create("CREATE TABLE t (a TEXT CONSTRAINT boolean CHECK (a IN (0, 1)))")


@pytest.mark.parametrize(
    "sql,types",
    [
        ("select id from users where name = @n", {"n": ("string", False)}),
        ("select id from users where @n < score", {"n": ("double", False)}),
        ("select id from users where (@n is null or id = @n)", {"n": ("bigint", True)}),
        ("select id from users where id in (@a, @b) and score between @c and @d", {"a": ("bigint", False), "b": ("bigint", False), "c": ("double", False), "d": ("double", False)}),
        ("select id from users order by id limit @n offset @m", {"n": ("bigint", False), "m": ("bigint", False)}),
        ("select cast(@n as integer) as x", {"n": ("bigint", False)}),
        ("select id from users where nickname like '%' || @n", {"n": ("string", False)}),
        ("select user_id from orders group by user_id having count(*) > @n", {"n": ("bigint", False)}),
        ("select id from users where active = @a union all select id from orders where status = @s", {"a": ("boolean", False), "s": ("string", False)}),
        ("with t as (select id from users where score > @x) select id from t", {"x": ("double", False)}),
        ("select @x as value", {"x": ("string", False)}),
        ("update users set score = score + @bonus where id = @id", {"bonus": ("double", False), "id": ("bigint", False)}),
        ("update users set nickname = @nick, name = @name where id = ?", {"nick": ("string", True), "name": ("string", False), "arg3": ("bigint", False)}),
        ("insert into users (id, name, active) values (@id, @name, @on)", {"id": ("bigint", True), "name": ("string", False), "on": ("boolean", False)}),
        ("delete from orders where user_id = @u and status in (@s)", {"u": ("bigint", False), "s": ("string", False)}),
    ],
)
def test_parameter_types(session, registry, sql, types):
    c = describe(session, registry, sql)
    assert {p.name: (p.type, p.nullable) for p in c.parameters} == types


def test_result_columns(session, registry):
    c = describe(session, registry, "select u.id, nickname, o.status, count(*) as n from users u left join orders o on o.user_id = u.id group by 1, 2, 3")
    assert [(x.name, x.type, x.nullable) for x in c.columns] == [("id", "bigint", False), ("nickname", "string", True), ("status", "string", True), ("n", "bigint", False)]
    c = describe(session, registry, "select nickname, nickname as forced!, id as loose? from users where nickname is not null")
    assert [(x.name, x.nullable) for x in c.columns] == [("nickname", False), ("forced", False), ("loose", True)]
    c = describe(session, registry, "select status from users left join orders on user_id = users.id where status > 'a'")
    assert not c.columns[0].nullable
    c = describe(session, registry, "insert into users (name, active) values ('x', true) returning id, upper(name) as up")
    assert c.access == "mutation" and [x.name for x in c.columns] == ["id", "up"]


@pytest.mark.parametrize("sql,why", [("select id, id from users", "two result columns"), ("select nope from users", "column isn't there"), ("select 1 from nowhere", "table isn't there"), ("insert into users (id, name) values (1)", "1 values for 2"), ("update users set nope = 1", "no column nope"), ("select id + 1, count(*) as n from users", "GROUP BY")])
def test_contract_errors(session, registry, sql, why):
    with pytest.raises(SqlError, match=why):
        describe(session, registry, sql)


def test_directives(session, registry):
    c = describe(session, registry, "update users set {{column}} = @v where id = @id", head="-- columns: name, nickname\n")
    assert {p.name: p.nullable for p in c.parameters} == {"v": False, "id": False} and set(c.variants) == {"name", "nickname"}
    with pytest.raises(SqlError, match="is string or double"):
        describe(session, registry, "update users set {{column}} = @v", head="-- columns: name, score\n")
    with pytest.raises(SqlError, match="batch is for"):
        describe(session, registry, "select 1", head="-- batch\n")
    with pytest.raises(SqlError, match="one result column"):
        describe(session, registry, "select id, name from users", head="-- cardinality: both\n")


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    with s.begin() as tx:
        tx.create(parse_create(USERS))
        tx.create(parse_create(ORDERS))
        run = Executor(tx).run
        run("insert into users (name, active, score) values ('ann', true, 1.5), ('bob', false, null)")
        run("insert into orders (user_id, status, made_at) values (1, 'new', '2024-01-01 00:00:00')")
    return s


def rows(store, sql):
    return [tuple(r) for r in engine.run(store.snapshot().session(), sql).collect()]


def test_statements(spark, store, session, registry):
    text = "-- func: find\nselect name from users where id = @id\n-- func: rename\nupdate users set name = @name where id = @id\n-- func: add\n-- batch\ninsert into users (name, active) values (@name, @active)\n"
    bound = engine.bind([contract.analyze(session, registry, b) for b in parse(text)])
    live = store.snapshot().session()
    assert bound["find"].one(live, id=1)["name"] == "ann"
    with pytest.raises(LookupError):
        bound["find"].one(live, id=99)
    for bad in ({"id": "x"}, {}, {"id": None}, {"id": 1, "more": 2}):
        with pytest.raises(TypeError):
            bound["find"].read(live, **bad)
    with store.begin() as tx:
        assert bound["rename"].execute(tx, id=1, name="eve").count == 1
        assert bound["add"].batch(tx, [{"name": "x", "active": True}, {"name": "y", "active": False}]) == 2
        with pytest.raises(SqlError, match="isn't declared as a batch"):
            bound["rename"].batch(tx, [])
    assert rows(store, "select name from users order by id") == [("eve",), ("bob",), ("x",), ("y",)]
    with pytest.raises(SqlError, match="needs a transaction"):
        bound["rename"].read(live, id=1, name="z")


def test_transactions(store):
    before = store.snapshot()
    with pytest.raises(ConstraintError, match="NOT NULL"), store.begin() as tx:
        Executor(tx).run("insert into users (name, active) values (null, true)")
    with pytest.raises(ConstraintError, match="UNIQUE"), store.begin() as tx:
        Executor(tx).run("insert into users (id, name, active) values (1, 'again', true)")
    with pytest.raises(ConstraintError, match="without a parent"), store.begin() as tx:
        Executor(tx).run("delete from users where id = 1")
    assert rows(store, "select count(*) as n from users") == [(2,)]
    with store.begin() as tx:
        with pytest.raises(SqlError, match="another writer"), store.begin():
            pass
        Executor(tx).run("update users set score = 9.0")
    assert before.read("users").filter("score = 9").count() == 0 and store.snapshot().version == before.version + 1
    assert store.vacuum()


def files_of(store, table):
    return set(store.snapshot().parquet_files(table))


def test_writes_touch_only_files_with_changed_rows(spark, store):
    """Inserts add a folder; updates and deletes leave other files as they are."""
    for n in range(3):
        with store.begin() as tx:
            Executor(tx).run("insert into users (name, active, score) values (@a, true, @n), (@b, false, @n)", {"a": f"a{n}", "b": f"b{n}", "n": float(n)})
    before = files_of(store, "users")
    with store.begin() as tx:
        assert Executor(tx).run("insert into users (name, active) values ('new', true)").count == 1
    added = files_of(store, "users") - before
    assert before < files_of(store, "users") and len(added) == 1
    spread = {f for (f,) in store.snapshot().located("users").filter("name in ('a1', 'b1')").select("_file").distinct().collect()}
    held = files_of(store, "users")
    with store.begin() as tx:
        done = Executor(tx).run("update users set score = score * 10, nickname = 'x' where name like '_1' returning id, score")
        assert done.count == 2 and sorted(r["score"] for r in done.rows.collect()) == [10.0, 10.0]
    gone = held - files_of(store, "users")
    assert len(gone) == len(spread) and all(any(f.endswith(g.rsplit("/", 1)[-1]) for f in spread) for g in gone)
    with store.begin() as tx:
        assert Executor(tx).run("delete from users where name = 'b1' and id in (select id from users where score = 10)").count == 1
        assert Executor(tx).run("delete from users where name = 'nobody'").count == 0
    assert rows(store, "select name, score, nickname from users order by id") == [("ann", 1.5, None), ("bob", None, None), ("a0", 0.0, None), ("b0", 0.0, None), ("a1", 10.0, "x"), ("a2", 2.0, None), ("b2", 2.0, None), ("new", None, None)]
    gone = store.vacuum()
    assert gone and rows(store, "select count(*) as n from users") == [(8,)]


def test_update_from_and_upsert_by_file(store):
    with store.begin() as tx:
        run = Executor(tx).run
        run("insert into orders (user_id, status, made_at) values (1, 'z', '2024-01-02 00:00:00'), (2, 'y', '2024-01-03 00:00:00')")
        # ann meets two orders: the smallest new value counts, whatever the files
        assert run("update users set nickname = o.status from orders o where o.user_id = users.id and o.status <> 'new2'").count == 2
        done = run("insert into users (id, name, active) values (1, 'up', false), (7, 'seven', true) on conflict (id) do update set name = excluded.name || users.name returning id, name, nickname")
        assert sorted(map(tuple, done.rows.collect())) == [(1, "upann", "new"), (7, "seven", None)]
        assert run("insert into users (id, name, active) values (1, 'no', false) on conflict (id) do update set name = 'n' where excluded.name = 'yes'").count == 0
        assert run("insert or replace into users (id, name, active) values (2, 'two', true), (8, 'eight', true), (8, 'again', true)").count == 2
        assert run("update users set score = (select max(id) from users) where id = 1").count == 1
    assert rows(store, "select id, name, nickname, score from users order by id") == [(1, "upann", "new", 8.0), (2, "two", None, None), (7, "seven", None, None), (8, "again", None, None)]


def test_batches_are_one_insert(store):
    args = [{"name": f"n{i}", "active": i % 2 == 0} for i in range(20)]
    before = files_of(store, "users")
    with store.begin() as tx:
        assert Executor(tx).batch("insert into users (name, active) values (@name, @active)", args) == 20
        assert len(tx.state["paths"]["users"]) == 2
        assert Executor(tx).batch("update users set nickname = @b where name = @a", [{"a": "n1", "b": "p"}, {"a": "n2", "b": "q"}]) == 2
    assert before - files_of(store, "users") == set() or before
    assert rows(store, "select id, nickname from users where nickname is not null order by id") == [(4, "p"), (5, "q")]
    with pytest.raises(ConstraintError, match="UNIQUE"), store.begin() as tx:
        Executor(tx).batch("insert into users (id, name, active) values (@i, 'x', true)", [{"i": 50}, {"i": 50}])


def test_lock_of_a_dead_writer(store):
    store.files.create("writer.lock", '{"writer": "gone", "began": 1.0}')
    with store.begin() as tx:
        Executor(tx).run("delete from orders")
    assert not store.files.exists("writer.lock") and rows(store, "select count(*) as n from orders") == [(0,)]


def test_lifecycle(spark, tmp_path):
    m, seeds = tmp_path / "m", tmp_path / "s"
    m.mkdir()
    seeds.mkdir()
    (m / "001_a.sql").write_text("CREATE TABLE a (id INTEGER PRIMARY KEY, x TEXT); INSERT INTO a VALUES (1, 'p');")
    (m / "002_b.sql").write_text("ALTER TABLE a ADD COLUMN y INT DEFAULT 7; ALTER TABLE a RENAME COLUMN x TO z; CREATE VIEW v (id, z) AS SELECT id, z FROM a;")
    (seeds / "one.sql").write_text("INSERT OR IGNORE INTO a (id, z) VALUES (1, 'no'), (2, 'q');")
    store = Store(spark, str(tmp_path / "db"))
    assert lifecycle.migrate(store, m, dry_run=True) == ["001_a", "002_b"] and store.snapshot().version == 0
    assert lifecycle.migrate(store, m) == ["001_a", "002_b"] and lifecycle.migrate(store, m) == []
    for _ in range(2):
        lifecycle.seed(store, seeds)
    assert rows(store, "select id, z, y from a order by id") == [(1, "p", 7), (2, "q", 7)]
    assert rows(store, "select z from v order by id") == [("p",), ("q",)]
    (m / "003_bad.sql").write_text("INSERT INTO a (id, z) VALUES (9, 'r'); INSERT INTO a (id, z) VALUES (1, 's');")
    with pytest.raises(SqlError, match="003_bad.sql|UNIQUE"):
        lifecycle.migrate(store, m)
    assert rows(store, "select count(*) as n from a") == [(2,)]
    assert [r["state"] for r in lifecycle.status(store, m).collect()] == ["applied", "applied", "pending"]
    (m / "003_bad.sql").write_text("BEGIN; INSERT INTO a (id) VALUES (9); COMMIT;")
    with pytest.raises(SqlError, match="control its transaction"):
        lifecycle.migrate(store, m)
    (m / "003_bad.sql").unlink()
    checks = lifecycle.validate(store, m)
    assert all(c["ok"] for c in checks) and '"version": 1' in lifecycle.validation_json(checks)
    ddl = lifecycle.dump(store.snapshot().registry)
    assert parse_create(ddl.split(";")[0]).columns == store.snapshot().registry.table("a").columns
    stats = {r["table"]: r["rows"] for r in lifecycle.optimize(store.snapshot(), "columns").collect()}
    assert stats == {"a": 2}
    assert lifecycle.check_migrations(spark, m, str(tmp_path / "replay")) == store.snapshot().registry.fingerprint()
    lifecycle.reset(store, m, seeds=seeds)
    assert rows(store, "select count(*) as n from a") == [(2,)]


def test_views(store):
    b = ViewFile("b_view", ("id",), "select id from a_view")
    a = ViewFile("a_view", ("id", "name"), "select id, name from users where active")
    assert lifecycle.reconcile(store, [b, a]) == ["a_view", "b_view"]
    assert rows(store, "select id from b_view") == [(1,)]
    with pytest.raises(Exception, match="nope"):
        lifecycle.reconcile(store, [ViewFile("a_view", ("x",), "select nope from users")])
    assert rows(store, "select id from b_view") == [(1,)]
    with pytest.raises(SqlError, match="read each other"):
        lifecycle.ordered([ViewFile("x", ("a",), "select a from y"), ViewFile("y", ("a",), "select a from x")])
    assert lifecycle.audit_views(store.snapshot(), [a]) == (["b_view"], [])
    with pytest.raises(SqlError):
        lifecycle.audit_views(store.snapshot(), [a], deny=True)
    assert lifecycle.views_script([b, a]).splitlines()[0] == "DROP VIEW IF EXISTS b_view;"


def test_value_sets(spark, registry, tmp_path):
    path = tmp_path / "sets.toml"
    path.write_text('[sets.Status]\nvalues = ["new", "sent"]\ncolumns = ["orders.status"]\n')
    sets = semantics.load_value_sets(path)
    bound = Registry.from_json(registry.to_json())
    semantics.bind_value_sets(bound, sets)
    c = describe(contract.shadow(spark, bound), bound, "select status from orders where status = @s")
    assert c.columns[0].value_set == "Status" and c.parameters[0].value_set == "Status"
    df = spark.createDataFrame([("new",), (None,)], "s string")
    assert df.select(semantics.strict_value(F.col("s"), sets["Status"], "s")).count() == 2
    with pytest.raises(Exception, match="odd is no Status"):
        spark.createDataFrame([("odd",)], "s string").select(semantics.strict_value(F.col("s"), sets["Status"], "s")).collect()
    for bad in ('[sets.s]\nvalues = ["a"]', "[sets.S]\nvalues = []", '[sets.S]\nvalues = ["a", "a"]', '[sets.S]\nvalues = ["a-b", "a b"]', "x = 1"):
        path.write_text(bad)
        with pytest.raises(SqlError):
            semantics.load_value_sets(path)
    with pytest.raises(SqlError, match="not text"):
        semantics.bind_value_sets(bound, {"S": semantics.ValueSet("S", ("a",), (("orders", "id"),))})


def test_temporal(spark, registry):
    bound = Registry.from_json(registry.to_json())
    semantics.bind_temporal(bound, semantics.Temporal(strict=True))
    assert bound.table("orders").column("made_at").temporal == "datetime"
    ok = spark.createDataFrame([("2024-02-29", "2024-02-29 23:59:59.123456789"), (None, None)], "d string, t string")
    assert ok.select(semantics.strict_temporal(F.col("d"), "date", "d"), semantics.strict_temporal(F.col("t"), "datetime", "t")).count() == 2
    for kind, text in (("date", "2023-02-30"), ("date", "2023-1-1"), ("datetime", "2024-01-01T00:00:00"), ("datetime", "2024-01-01 25:00:00")):
        with pytest.raises(Exception, match="is not YYYY"):
            spark.createDataFrame([(text,)], "x string").select(semantics.strict_temporal(F.col("x"), kind, "x")).collect()


def test_scopes():
    scopes = semantics.Scopes({"OrderId": semantics.ScopedType("OrderId", ("gate",))})
    a, b = object(), object()
    token = scopes.produce("OrderId", "gate", 5, a)
    assert scopes.consume(token, "OrderId", a) == 5
    for call in (lambda: scopes.consume(token, "OrderId", b), lambda: scopes.produce("OrderId", "other", 5, a), lambda: scopes.produce("OrderId", "gate", None, a)):
        with pytest.raises(SqlError):
            call()
    for call in (lambda: scopes.consume(5, "OrderId", a), lambda: semantics.ScopedId(None, "OrderId", 5, a)):
        with pytest.raises(TypeError):
            call()


def test_lint(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kinds = lambda df, **k: sorted(f.kind for f in lint.findings(df, **k))
    assert kinds(orders) == ["output", "scan"]
    assert kinds(orders.orderBy("o_orderkey").limit(3)) == ["scan", "sort"]
    assert kinds(orders, fixed=("orders",)) == []
    assert kinds(orders.filter("o_orderkey = 5"), keys={"orders": ("o_orderkey",)}) == []
    assert lint.plan_hash(orders.limit(3)) == lint.plan_hash(spark.read.parquet(f"{sf_dir}/orders.parquet").limit(3))
    old = lint.Baseline({"q": lint.findings(orders)})
    assert old.permits("q", old.known["q"]) and old.permits("q", []) and not lint.Baseline().permits("q", old.known["q"])
    assert lint.Baseline.from_json(old.to_json()).known == old.known
    with pytest.raises(SqlError, match="grew"):
        lint.Baseline().reduced(old.known)


def test_publish(tmp_path, session, registry):
    c = describe(session, registry, "select id from users where name = @n", name="find")
    text = publish.stub([c])
    assert "def find(session: SparkSession, *, n: str) -> DataFrame" in text
    compile(text, "stub", "exec")
    out = tmp_path / "generated"
    assert publish.publish(out, {"a.pyi": text}) and publish.publish(out, {"a.pyi": text}) == []
    assert publish.problems(out, {"b.pyi": text}) == ["b.pyi is missing", "a.pyi is no longer generated"]
    (out / publish.RECEIPT).write_text(publish.receipt({"a.sql": "x"}, "s", {"a.pyi": text}))
    assert publish.current(out, {"a.sql": "x"}, "s") and not publish.current(out, {"a.sql": "y"}, "s")
    (out / "mine.pyi").write_text("mine")
    with pytest.raises(SqlError, match="isn't a generated file"):
        publish.publish(out, {"mine.pyi": text})


def test_publication_that_died(tmp_path, monkeypatch):
    """Between its two renames: the old folder comes back."""
    import os

    out = tmp_path / "generated"
    publish.publish(out, {"a.pyi": publish.HEADER + "one"})
    real, calls = os.replace, []

    def dies(a, b):
        calls.append(a)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(a, b)

    monkeypatch.setattr(publish.os, "replace", dies)
    monkeypatch.setattr(publish, "recover", lambda root: False)  # it is gone before it can clean up
    with pytest.raises(KeyboardInterrupt):
        publish.publish(out, {"a.pyi": publish.HEADER + "two"})
    monkeypatch.undo()
    assert not out.exists() and publish.recover(out) and (out / "a.pyi").read_text().endswith("one")
    assert not publish.recover(out) and sorted(p.name for p in tmp_path.iterdir()) == ["generated"]
    publish.publish(out, {"a.pyi": publish.HEADER + "two"})
    assert (out / "a.pyi").read_text().endswith("two") and sorted(p.name for p in tmp_path.iterdir()) == ["generated"]


def test_inventory(tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.sql").write_text("-- func: x\nselect 1\n-- func: y\nselect 2\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.sql").write_text("-- func: x\nselect  1 -- same\n-- func: z\nselect 3\n")
    git("commit", "-qam", "two")
    assert changed(tmp_path, "HEAD~1", "HEAD") == [{"path": "a.sql", "name": "z", "change": "added"}, {"path": "a.sql", "name": "y", "change": "removed"}]


def test_sync_plan(spark):
    now = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "c", 3)], "k int, x string, y int")
    want = spark.createDataFrame([(1, "a", None), (2, "B", 2), (4, "d", 4)], "k int, x string, y int")
    got = sorted(map(tuple, semantics.sync_plan(now, want, ["k"], ["x", "y"]).collect()))
    assert got == [(1, "a", None, "same"), (2, "B", 2, "update"), (3, "c", 3, "other"), (4, "d", 4, "insert")]


def test_foreign_violations(store):
    assert foreign_violations(store.snapshot()) == []
