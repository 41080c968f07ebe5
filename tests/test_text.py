import pytest

from sqlloom.blocks import parse
from sqlloom.functions.dialect import rewrite
from sqlloom.lower import lower
from sqlloom.sources.discovery import numbered_files, parse_view, statement_files
from sqlloom.text import SqlError, identifier, overrides, single, split, strip_comments


def test_comments_and_strings():
    assert strip_comments("select '--x', /* y */ 1 -- z").split() == ["select", "'--x',", "1"]
    with pytest.raises(SqlError, match="unterminated comment"):
        strip_comments("select 1 /* x")
    with pytest.raises(SqlError, match="unterminated quote"):
        strip_comments("select 'x")


def test_split_and_single():
    assert split("a; b ';' ; -- c\n;") == ["a", "b ';'"]
    assert single("-- head\n select 1 ;\n-- tail") == "select 1"
    assert split("create trigger t after insert on x begin select 1; select 2; end; select 3") == ["create trigger t after insert on x begin select 1; select 2; end", "select 3"]
    for bad in ("", "-- only", "select 1; select 2"):
        with pytest.raises(SqlError):
            single(bad)


def test_placeholders():
    sql, places = lower("select @userId, :userid, ?, ?7, ?07, $Name, ? -- ?")
    assert sql == "select :user_id, :user_id, :arg2, :arg7, :arg7, :name, :arg9 -- ?"
    assert [(p.name, p.slot) for p in places] == [("user_id", 1), ("arg2", 2), ("arg7", 7), ("name", 8), ("arg9", 9)]
    assert [p.name for p in lower("select @a_b, @aB")[1]] == ["a_b", "a_b_2"]
    assert lower("select ':x', \"@y\"")[1] == []


def test_identifiers_and_overrides():
    assert [identifier(x) for x in ("Max-Value", "1st", "class", "a b", "é")] == ["max_value", "_1st", "class_", "a_b", "_"]
    assert overrides('select a as x!, b as "y"?, c as z from t') == ('select a as x, b as "y", c as z from t', {"x": False, "y": True})


BLOCKS = """-- A file.
-- func: one
-- cardinality: one
select 1;
-- func: change
-- columns: a, b
update t set {{column}} = @value where id = @id
-- func: gate
-- produces: OrderId
select id from t -- trailing
"""


def test_blocks():
    one, change, gate = parse(BLOCKS)
    assert (one.name, one.sql, one.cardinality) == ("one", "select 1", "one")
    assert change.variants()["b"] == "update t set b = @value where id = @id"
    assert gate.produces == ("OrderId",)


@pytest.mark.parametrize(
    "text,why",
    [("select 1", "before the first func"), ("-- func: a b\nselect 1", "no function name"), ("-- func: a\n", "holds no SQL"), ("-- func: a\nselect 1\n-- func: a\nselect 2", "twice"), ("-- func: a\n-- columns: x\nselect 1", "two or more"), ("-- func: a\n-- columns: x, y\nselect 1", "marker"), ("-- func: a\nselect {{column}}", "needs a columns"), ("-- func: a\n-- cardinality: few\nselect 1", "many, one or both"), ("-- func: a\nselect 1; select 2", "2 statements")],
)
def test_bad_blocks(text, why):
    with pytest.raises(SqlError, match=why):
        parse(text)


@pytest.mark.parametrize(
    "sql,want",
    [
        ("a is not b", "(NOT (a <=> b))"),
        ("a is b and c is null", "a <=> b and c is null"),
        ('t."x" = "y"', "t.`x` = `y`"),
        ("a like 'X\\%_Ä'", "translate(a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE 'x\\\\\\\\%_Ä'"),
        ("a || b * c", "(a || b) * c"),
        ("a - (b - c) is not d + 1", "(NOT (a - (b - c) <=> d + 1))"),
        ("1 + 1 << 2 & x", "shiftleft(1 + 1, 2) & x"),
        ("case when x then 4 else 5 end / 2", "try_divide(case when x then 4 else 5 end, 2)"),
        ("select a, b, max(c) as m from t group by a", "select a , max_by(b, c) as b , max(c) as m from t group by a"),
        ("select count(*), b from t", "select count(*) , any_value(b) as b from t"),
        ("select a as k, sum(b) over (order by c) from t", "select a as k , sum(b) over (order by c) from t"),
        ("0xFF", "255"),
        ("'a\\n'", "'a\\\\n'"),
        ("x * y / z % 2", "try_mod(try_divide(x * y, z), 2)"),
        ("max(a, b)", "CASE WHEN (a) IS NULL OR (b) IS NULL THEN NULL ELSE greatest(a, b) END"),
        ("max(a)", "max(a)"),
        ("cast(a as text) || cast(b as integer)", "cast(a AS string) || cast(b AS bigint)"),
        ("with c as not materialized (select 1) select 2", "with c as (select 1) select 2"),
        ("order by a collate nocase desc", "order by a COLLATE UTF8_LCASE desc"),
        ("1 << n", "shiftleft(1, n)"),
        ("total(x)", "coalesce(sum(cast(x AS double)), 0.0D)"),
    ],
)
def test_dialect(sql, want):
    assert rewrite(sql) == want


def test_files(tmp_path):
    (tmp_path / "a.sql").write_text("-- func: x\nselect 1")
    (tmp_path / "generated").mkdir()
    (tmp_path / "generated" / "b.sql").write_text("")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "sqlloom.toml").write_text("")
    (tmp_path / "other" / "c.sql").write_text("")
    assert [p.name for p in statement_files(tmp_path)] == ["a.sql"]
    m = tmp_path / "m"
    m.mkdir()
    for n in ("002_b.sql", "001_a.sql"):
        (m / n).write_text("")
    assert [v for v, _ in numbered_files(m)] == ["001_a", "002_b"]
    (m / "2_c.sql").write_text("")
    with pytest.raises(SqlError, match="share number 2"):
        numbered_files(m)


def test_view_files():
    v = parse_view("create view open (id, name) as select id, name from t where x = 1;")
    assert (v.name, v.columns) == ("open", ("id", "name")) and v.select.startswith("select")
    for bad in ("create view v as select 1", "create view v (a, a) as select 1, 2", "select 1", "create view v (a) as select 1; select 2"):
        with pytest.raises(SqlError):
            parse_view(bad)
