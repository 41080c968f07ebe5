import json

import pytest

from sqlloom.cli import main
from sqlloom.sources import config
from sqlloom.text import SqlError


@pytest.fixture
def project(tmp_path):
    (tmp_path / "sqlloom.toml").write_text('source = "app"\nmigrations = "migrations"\nseeds = "seeds"\nbaseline = "baseline.json"\n[databases]\nmain = "db"\n')
    for d in ("app/db_views", "migrations", "seeds"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "migrations/001_t.sql").write_text("CREATE TABLE t (id INTEGER PRIMARY KEY, x TEXT NOT NULL);")
    (tmp_path / "seeds/t.sql").write_text("INSERT OR IGNORE INTO t VALUES (1, 'a');")
    (tmp_path / "app/find.sql").write_text("-- func: find\nselect x from t where id = @id\n-- func: put\ninsert into t (x) values (@x)\n")
    (tmp_path / "app/db_views/v.sql").write_text("CREATE VIEW v (x) AS SELECT x FROM t")
    return tmp_path


def test_verbs(spark, project, capsys):
    go = lambda *a: main([*a, "--config", str(project / "sqlloom.toml")], spark)
    said = lambda: capsys.readouterr().out
    assert go("migrate", "--dry-run") == 0 and go("migrate") == 0 and go("seed") == 0
    said()
    assert go("check") == 1 and go("generate") == 0 and go("check") == 0 and go("generate") == 0
    assert (project / "app/generated/find.pyi").read_text().count("def ") == 2
    assert go("reconcile-views") == 0 and go("audit-views", "--deny-warnings") == 0
    said()
    assert go("validate") == 0 and json.loads(said())["ok"]
    assert go("dump-schema") == 0
    (project / "schema.sql").write_text(said())
    assert go("dump-schema", "--check", str(project / "schema.sql")) == 0
    assert go("check-plans") == 0 or go("check-plans", "--write-baseline") == 0
    assert go("check-plans") == 0
    assert go("check-migrations") == 0 and go("reset") == 0 and go("optimize") == 0 and go("inspect") == 0
    assert go("migrate", "--target", "other") == 1


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "sqlloom.toml"
    plain = config.load(path)
    assert plain.source == tmp_path.resolve() and plain.output.name == "generated"
    with pytest.raises(SqlError, match="name a database"):
        plain.database()
    path.write_text('[[databases]]\nname = "a"\npath = "x"\n[[databases]]\nname = "b"\npath = "y"\n[temporal]\nstrict = true\n')
    c = config.load(path)
    assert c.temporal.strict and c.database(name="b").endswith("/y") and c.database("/z", "b") == "/z"
    monkeypatch.setenv("DATABASE_URL", "/env")
    assert c.database(name="b") == "/env"
    for bad in ("nope = 1", '[temporal]\nnope = 1', 'source = "a"\noutput = "b"'):
        path.write_text(bad)
        with pytest.raises(SqlError):
            config.load(path)
