"""What the value-set validator takes and refuses."""

import pytest
from pyspark.sql import functions as F

from sqlloom import engine
from sqlloom.blocks import parse
from sqlloom.operators import semantics
from sqlloom.operators.dml import Executor
from sqlloom.operators.store import Store
from sqlloom.plans import contract
from sqlloom.sources.registry import Registry, parse_create
from sqlloom.text import SqlError

MOVES = "CREATE TABLE moves (id INTEGER PRIMARY KEY, state TEXT NOT NULL, earlier TEXT)"
OTHER = "CREATE TABLE boxes (id INTEGER PRIMARY KEY, state TEXT NOT NULL)"
STATES = {"MoveState": semantics.ValueSet("MoveState", ("packed", "sent"), (("moves", "state"), ("moves", "earlier")))}
BOXES = {"BoxState": semantics.ValueSet("BoxState", ("open",), (("boxes", "state"),))}


def bound(*sets):
    r = Registry()
    for ddl in (MOVES, OTHER):
        r.add(parse_create(ddl))
    r.views["move_view"] = "SELECT state, id FROM moves"
    for s in sets:
        semantics.bind_value_sets(r, s)
    return r


@pytest.fixture(scope="module")
def one(spark):
    r = bound(STATES)
    return contract.shadow(spark, r), r


@pytest.fixture(scope="module")
def two(spark):
    r = bound(STATES, BOXES)
    return contract.shadow(spark, r), r


def describe(found, sql, head=""):
    session, registry = found
    return contract.analyze(session, registry, parse(f"-- func: q\n{head}{sql}")[0])


TAKEN = [
    "select state from moves where state = 'packed'",
    "select m.state from moves m join boxes b on m.id = b.id where m.state = 'packed' and b.state = 'any'",
    "select state from moves where state = @s and @s = 'packed'",
    "select state from moves where state in ('packed', 'sent') or state is null or state is not 'sent'",
    "select case state when 'packed' then 1 else 0 end as n from moves",
    "select case when id = 1 then state else 'packed' end as s from moves",
    "update moves set state = case when id = @id then 'packed' else 'sent' end",
    "update moves set earlier = null, state = earlier where state <> 'sent'",
    "insert into moves (state) values ('packed'), (@s)",
    "with t as (select state from moves where state = 'packed') select state from t where state = 'sent'",
    "select d.state from (select state from moves) d where d.state = 'packed'",
    "select state from move_view where state = 'packed'",
    "select json_object('state', state) as j, json_array(state, id) as k from moves",
    "select cast(json_group_array(state) as text) as j from moves",
    "select json_object('state', m.state) as j from moves m union all select json_object('state', b.state) from boxes b",
    "select m.state from moves m union all select m.earlier from moves m",
    "select @s as state from boxes union all select state from moves where state = @s",
    "with t as (select @s as state from boxes union all select state from moves where state = @s) select state from t",
    "select (select id from moves where state = @s limit 1) as n",
    "select coalesce((select m.id from moves m where m.state = 'packed' limit 1), 0) as n",
    "select exists(select 1 from moves m where m.state = 'packed') as n",
    "select state, row_number() over (partition by state order by id) as n, max(state) over () as top from moves",
    "insert into moves (state) select 'packed' from boxes where state = 'any'",
    "insert into moves (state) select @s from boxes where id = @id",
    "insert into moves (state, earlier) select m.state, m.earlier from moves m where m.state = 'packed'",
    "delete from moves where state = 'sent' returning state",
    "insert into moves (id, state) values (1, 'sent') on conflict (id) do update set state = excluded.state where moves.state = 'packed'",
]
REFUSED = [
    "select state from moves where state = 'pakced'",
    "select m.state from moves m join boxes b on m.id = b.id where m.state = 'pakced'",
    "select state from moves where state = @s and @s = 'pakced'",
    "select state from moves where state in ('packed', 'pakced')",
    "select case state when 'pakced' then 1 else 0 end as n from moves",
    "select case when id = 1 then state else 'pakced' end as s from moves",
    "update moves set state = case when id = @id then 'pakced' else 'sent' end",
    "update moves set state = (id in (1, 2))",
    "update moves set state = json_object('state', state)",
    "update moves set state = (select 'packed')",
    "insert into moves (state) values ('pakced')",
    "insert into moves (state) values (1 = 1)",
    "insert into moves (state) values ((select state from moves limit 1))",
    "with t as (select state from moves where state = 'pakced') select state from t",
    "with t as (select state from moves) select state from t where state = 'pakced'",
    "select d.state from (select state from moves) d where d.state = 'pakced'",
    "select state from move_view where state = 'pakced'",
    "select state from moves union select 'packed'",
    "select 'packed' as state union select state from moves",
    "select m.state from moves m union select b.state from boxes b",
    "select * from moves union select id, state, null from boxes",
    "select state from moves where state = (select 'pakced')",
    "select state from moves where state in (select 'pakced')",
    "select json_object('state', state || '') as j from moves",
    "select json_array(cast(state as text)) as j from moves",
    "select upper(state) as u from moves",
    "select json_object('is', state = 'pakced') as j from moves",
    "select (select state from moves limit 1) as s",
    "select (select id from moves where upper(state) = 'packed' limit 1) as n",
    "select coalesce((select m.state from moves m limit 1), '') as s",
    "select exists(select 1 from moves m where m.state = 'pakced') as n",
    "with t as (select @s as state from boxes union all select state from moves where state = @s) select state from t where state = 'pakced'",
    "insert into moves (state) select 'pakced' from boxes",
    "insert into moves (state) select b.state from boxes b",
    "insert into moves (state) select upper(m.state) from moves m",
    "insert into moves (state) select case when id = 1 then 'packed' else 'sent' end from boxes",
    "insert into moves (state) select (select 'packed') from boxes",
    "insert into moves (id, state, earlier) select * from moves",
    "insert into moves (state) select 'packed' from moves m where m.state = 'pakced'",
    "delete from moves returning case state when 'pakced' then 'packed' else state end as state",
    "insert into moves (id, state) values (1, 'sent') on conflict (id) do update set state = 'pakced'",
]
CONFLICTS = [
    "select m.state from moves m union select b.state from boxes b",
    "select json_object('state', m.state) as j from moves m where m.state = @s union select json_object('state', b.state) from boxes b where b.state = @s",
    "select (select b.id from boxes b where b.state = @s limit 1) as n from moves m where m.state = @s",
    "select m.id from moves m join boxes b on b.state = m.state",
]


@pytest.mark.parametrize("sql", TAKEN)
def test_taken(one, sql):
    describe(one, sql)


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(one, sql):
    with pytest.raises(SqlError, match="value set"):
        describe(one, sql)


@pytest.mark.parametrize("sql", CONFLICTS)
def test_conflicts(two, sql):
    with pytest.raises(SqlError, match="conflicting"):
        describe(two, sql)


def test_identities(one):
    c = describe(one, "select @s as state from boxes union all select state from moves where state = @s")
    assert c.columns[0].value_set == "MoveState" and c.parameters[0].value_set == "MoveState"
    assert describe(one, "select json_object('state', state) as j from moves").columns[0].value_set is None
    assert describe(one, "update moves set {{column}} = @v where id = @id", "-- columns: state, earlier\n").parameters[0].value_set == "MoveState"
    assert describe(one, "select case when id = 1 then state else 'packed' end as s from moves").columns[0].value_set == "MoveState"


def test_strict_reads_and_gates(spark, tmp_path, one):
    """A statement fails on a stored value outside its set; a gate's id opens its child."""
    session, registry = one
    text = "-- func: states\nselect id, state from moves order by id\n-- func: gate\n-- produces: MoveId\nselect id, state from moves where id = @id\n-- func: child\n-- consumes: MoveId=move\nselect earlier from moves where id = @move\n"
    scopes = semantics.Scopes({"MoveId": semantics.ScopedType("MoveId", ("gate",))})
    statements = engine.bind([contract.analyze(session, registry, b) for b in parse(text)], sets=STATES, scopes=scopes)
    store = Store(spark, str(tmp_path / "db"))
    with store.begin() as tx:
        tx.create(parse_create(MOVES))
        Executor(tx).run("insert into moves (state, earlier) values ('packed', 'sent'), ('lost', null)")
    live = store.snapshot().session()
    with pytest.raises(Exception, match="lost is no MoveState"):
        statements["states"].read(live).collect()
    row = statements["gate"].one(live, id=1)
    assert repr(row["id"]) == "<MoveId>" and row["state"] == "packed"
    assert [r["earlier"] for r in statements["child"].read(live, move=row["id"]).collect()] == ["sent"]
    with pytest.raises(TypeError, match="MoveId is needed"):
        statements["child"].read(live, move=1)
    with pytest.raises(SqlError, match="another session"):
        statements["child"].read(store.snapshot().session(), move=row["id"])
    plain = engine.bind([contract.analyze(session, registry, b) for b in parse(text)])
    with pytest.raises(SqlError, match="scopes"):
        plain["gate"].one(live, id=1)


def test_temporal_parameters(spark):
    r = Registry()
    r.add(parse_create("CREATE TABLE visits (id INTEGER PRIMARY KEY, came_at TEXT, born_on TEXT, label TEXT)"))
    semantics.bind_temporal(r, semantics.Temporal(strict=True))
    found = contract.shadow(spark, r), r
    kinds = lambda sql: {p.name: (p.type, p.temporal) for p in describe(found, sql).parameters}
    assert kinds("select id from visits where came_at > @x and label = @since_date") == {"x": ("string", "datetime"), "since_date": ("string", "date")}
    assert kinds("select datetime(@seconds, 'unixepoch') as at_") == {"seconds": ("bigint", None)}
    with pytest.raises(SqlError, match="both"):
        describe(found, "select id from visits where came_at = @x or born_on = @x")


def test_statements_of_schema_and_statistics(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    with store.begin() as tx:
        run = Executor(tx).run
        assert run("create table a (id integer primary key, x text)").count == 0
        run("insert into a (x) values ('p'), ('q')")
        run("create index by_x on a (x)")
        run("alter table a add column y int default 3")
        run("pragma optimize")
    assert store.snapshot().state["statistics"] == {"a": 2}
    with store.begin() as tx:
        Executor(tx).run("drop table a")
    assert not store.snapshot().registry.tables


def test_declared_scalars(spark, one):
    session = contract.shadow(spark, one[1], "-- sqlloom: scalar slug 1 deterministic\n-- sqlloom: scalar pair 2\n")
    c = describe((session, one[1]), "select slug(earlier || 'x') as s, pair(id, 'a') as p from boxes join moves using (id)") if False else describe((session, one[1]), "select slug(b.state) as s, pair(id, 'a') as p from boxes b")
    assert [x.name for x in c.columns] == ["s", "p"]
    with pytest.raises(Exception, match="register it"):
        session.sql("select slug('a') as s").collect()
    for bad in ("-- sqlloom: scalar f 128", "-- sqlloom: scalar 1f 1", "-- sqlloom: scalar f 1\n-- sqlloom: scalar F 2"):
        with pytest.raises(SqlError):
            contract.declare_scalars(spark.newSession(), bad)


def test_project_rows(spark):
    from dataclasses import dataclass

    @dataclass
    class Named:
        id: int
        label: str

    row = spark.range(1).select(F.lit(4).alias("id"), F.lit("pier").alias("name_en")).first()
    assert engine.project(row, Named, {"label": "name_en"}, {"label": str.upper}) == Named(4, "PIER")
    with pytest.raises(SqlError, match="no column label"):
        engine.project(row, Named)


def test_canonical_sync(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    canonical = spark.createDataFrame([("a", "one"), ("b", "two")], "slug string, name string")
    with store.begin() as tx:
        tx.create(parse_create("CREATE TABLE t (id INTEGER, slug TEXT NOT NULL, name TEXT)"))
        Executor(tx).run("insert into t (id, slug, name) values (1, 'a', 'old'), (2, 'c', 'mine')")
        assert semantics.sync(tx, "t", canonical, ["slug"], ["name"]) == {"update": 1, "insert": 1, "other": 1}
        paths = tx.state["paths"]["t"]
        assert semantics.sync(tx, "t", canonical, ["slug"], ["name"]) == {"same": 2, "other": 1} and tx.state["paths"]["t"] == paths
    got = sorted(map(tuple, store.snapshot().read("t").select("slug", "name").collect()))
    assert got == [("a", "one"), ("b", "two"), ("c", "mine")]
