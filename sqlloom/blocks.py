"""Statement blocks of ``.sql`` files and the directives above them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .text import SqlError, single, tokens

DIRECTIVE = re.compile(r"^\s*--\s*(func|cardinality|batch|columns|produces|consumes|unscoped)\b\s*:?\s*(.*?)\s*$")
NAME = re.compile(r"[A-Za-z_]\w*\Z")
MARKER = re.compile(r"\{\{\s*column\s*\}\}")


@dataclass(frozen=True)
class Block:
    name: str
    sql: str
    line: int
    cardinality: str | None = None  #: many, one, both or not said
    batch: bool = False
    columns: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()
    consumes: tuple[tuple[str, str], ...] = ()
    unscoped: str | None = None
    path: str = field(default="", compare=False)

    def variants(self) -> dict[str | None, str]:
        """The SQL for each allowed column, or the one statement."""
        if not self.columns:
            return {None: self.sql}
        return {c: MARKER.sub(c, self.sql) for c in self.columns}


def parse(text: str, path: str = "") -> list[Block]:
    """Blocks in order; each begins at its ``-- func: name`` line."""
    blocks: list[Block] = []
    now: dict | None = None
    body: list[str] = []

    def fail(line: int, why: str):
        raise SqlError(f"{path or 'sql'}:{line}: {why}")

    def finish():
        if now is None:
            return
        sql = "\n".join(body)
        if not tokens(sql):
            fail(now["line"], f"{now['name']} holds no SQL")
        try:
            sql = single(sql)
        except SqlError as e:
            fail(now["line"], f"{now['name']}: {e}")
        markers = len(MARKER.findall(sql))
        if now["columns"] and markers != 1:
            fail(now["line"], f"{now['name']}: columns needs one {{{{column}}}} marker, found {markers}")
        if markers and not now["columns"]:
            fail(now["line"], f"{now['name']}: {{{{column}}}} needs a columns directive")
        blocks.append(Block(sql=sql, path=path, **now))

    for number, line in enumerate(text.splitlines(), 1):
        m = DIRECTIVE.match(line)
        if not m:
            if now is None and line.strip() and not line.lstrip().startswith("--"):
                fail(number, "SQL before the first func directive")
            body.append(line)
            continue
        what, value = m[1], m[2]
        if what == "func":
            finish()
            if not NAME.match(value):
                fail(number, f"{value!r} is no function name")
            if any(b.name == value for b in blocks):
                fail(number, f"{value} is defined twice")
            now, body = {"name": value, "line": number, "columns": ()}, []
            continue
        if now is None:
            fail(number, f"{what} before the first func directive")
        if now.get(what):
            fail(number, f"{what} is given twice")
        if what == "cardinality":
            if value not in ("many", "one", "both"):
                fail(number, f"cardinality is many, one or both, not {value!r}")
            now["cardinality"] = value
        elif what == "batch":
            if value:
                fail(number, "batch takes no value")
            now["batch"] = True
        elif what == "columns":
            names = tuple(x.strip() for x in value.split(","))
            if len(names) < 2 or len({n.lower() for n in names}) < len(names) or not all(map(NAME.match, names)):
                fail(number, "columns needs two or more distinct names")
            now["columns"] = names
        elif what == "unscoped":
            if not value:
                fail(number, "unscoped needs a reason")
            now["unscoped"] = value
        else:
            pairs = []
            for x in value.split(","):
                left, _, right = (p.strip() for p in x.partition("="))
                if not NAME.match(left) or right and not NAME.match(right):
                    fail(number, f"{what} lists names, not {x.strip()!r}")
                pairs.append(left if what == "produces" else (left, right or left))
            now[what] = tuple(pairs)
    finish()
    return blocks
