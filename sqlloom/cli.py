"""Command line: ``python -m sqlloom.cli VERB``."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import SparkSession

from . import lifecycle, publish
from .blocks import parse
from .functions.dialect import rewrite
from .inventory import changed
from .operators import semantics
from .operators.store import Store
from .plans import contract, lint
from .sources import config as settings
from .sources.discovery import module_name, statement_files, view_files
from .sources.files import shared_folder
from .text import SqlError

VERBS = "inspect generate check check-plans changed-statements check-migrations migrate bootstrap seed reset dump-schema audit-views reconcile-views validate optimize".split()


def contracts(spark: SparkSession, c: settings.Config, store: Store) -> dict[str, list[contract.Contract]]:
    """{module: contracts}, analysed against the database's schema."""
    registry = store.snapshot().registry
    if c.value_sets:
        semantics.bind_value_sets(registry, semantics.load_value_sets(c.value_sets))
    semantics.bind_temporal(registry, c.temporal)
    session = contract.shadow(spark, registry)
    out = {}
    for path in statement_files(c.source):
        if blocks := parse(path.read_text(), str(path.relative_to(c.source))):
            out[module_name(c.source, path)] = [contract.analyze(session, registry, b) for b in blocks]
    return out


def outputs(found: dict[str, list[contract.Contract]]) -> dict[str, str]:
    return {name.replace(".", "/") + ".pyi": publish.stub(cs) for name, cs in found.items()}


def plans(spark: SparkSession, c: settings.Config, store: Store) -> dict[str, list[lint.Finding]]:
    policy = lint.Policy.load(c.policy) if c.policy else lint.Policy(c.fixed_tables)
    session = store.snapshot().session()
    keys = {t.name: t.primary_key for t in store.snapshot().registry.tables.values()}
    out = {}
    for module, cs in contracts(spark, c, store).items():
        for x in cs:
            if x.access == "read":
                df = session.sql(x.sql, args={p.name: contract.literal(p) for p in x.parameters} or None)
                name = f"{module}.{x.name}"
                out[name] = policy.check(name, lifecycle.digest(x.sql), df) if policy.exceptions else lint.findings(df, policy.fixed, keys)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sqlloom")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("--config", default="sqlloom.toml")
    p.add_argument("--database", help="folder of the store")
    p.add_argument("--target", help="a database of the configuration")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--atomic", action="store_true")
    p.add_argument("--deny-warnings", action="store_true")
    p.add_argument("--check", help="dump-schema: compare with this file")
    p.add_argument("--write-baseline", action="store_true")
    p.add_argument("--scope", default="tables", choices=("tables", "columns"))
    p.add_argument("commits", nargs="*")
    a = p.parse_args(argv)
    try:
        return run(a, settings.load(a.config), spark)
    except SqlError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run(a: argparse.Namespace, c: settings.Config, spark: SparkSession | None) -> int:
    if a.verb == "changed-statements":
        print(json.dumps(changed(c.root, *(a.commits or ("HEAD~1", "HEAD"))), indent=1))
        return 0
    spark = spark or SparkSession.builder.appName("sqlloom").getOrCreate()
    if a.verb == "check-migrations":
        place = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
        try:
            print(lifecycle.check_migrations(spark, c.migrations, place))
        finally:
            Store(spark, place).drop()
        return 0
    store = Store(spark, c.database(a.database, a.target))
    views = view_files(c.source)
    if a.verb == "inspect":
        for cs in contracts(spark, c, store).values():
            contract.report(spark, cs).show(1000, False)
    elif a.verb in ("generate", "check"):
        wanted = outputs(contracts(spark, c, store))
        inputs = {str(p.relative_to(c.source)): p.read_text() for p in statement_files(c.source)}
        fingerprint = store.snapshot().registry.fingerprint()
        if a.verb == "check":
            found = publish.problems(c.output, wanted)
            print("\n".join(found) or "up to date")
            return int(bool(found))
        if not publish.current(c.output, inputs, fingerprint):
            print("\n".join(publish.publish(c.output, wanted)) or "up to date")
            (c.output / publish.RECEIPT).write_text(publish.receipt(inputs, fingerprint, wanted))
    elif a.verb == "check-plans":
        found = plans(spark, c, store)
        old = lint.Baseline.from_json(c.baseline.read_text()) if c.baseline and c.baseline.exists() else lint.Baseline()
        if a.write_baseline:
            new = old.reduced(found) if old.known else lint.Baseline({n: f for n, f in found.items() if f})
            c.baseline.write_text(new.to_json())
            return 0
        bad = {n: f for n, f in found.items() if f and not old.permits(n, f)}
        for n, fs in bad.items():
            print("\n".join(f"{n}: {f.kind} {f.table or ''} {f.detail}" for f in fs))
        return int(bool(bad))
    elif a.verb == "migrate":
        print("\n".join(lifecycle.migrate(store, c.migrations, a.atomic, a.dry_run)) or "nothing is pending")
    elif a.verb in ("seed", "bootstrap"):
        print("\n".join(lifecycle.seed(store, getattr(c, "seeds" if a.verb == "seed" else "bootstrap"))))
    elif a.verb == "reset":
        lifecycle.reset(store, c.migrations, views, c.bootstrap, c.seeds)
    elif a.verb == "dump-schema":
        if a.check:
            lifecycle.check_dump(store.snapshot().registry, a.check)
        else:
            print(lifecycle.dump(store.snapshot().registry), end="")
    elif a.verb == "audit-views":
        extra, _ = lifecycle.audit_views(store.snapshot(), views, a.deny_warnings)
        print("\n".join(f"warning: {n} has no file" for n in extra) or "views agree")
    elif a.verb == "reconcile-views":
        print("\n".join(lifecycle.reconcile(store, views)))
    elif a.verb == "validate":
        checks = lifecycle.validate(store, c.migrations, views)
        print(lifecycle.validation_json(checks))
        return int(not all(x["ok"] for x in checks))
    elif a.verb == "optimize":
        found = lifecycle.optimize(store.snapshot(), a.scope)
        if found is not None:
            found.show(1000, False)
    return 0


__all__ = ["main", "rewrite"]

if __name__ == "__main__":
    sys.exit(main())
