"""json_tree: every value inside a JSON text, as rows.

The depth isn't known before the text is read, so that no composition of
built-in functions gives it; ``json_each`` needs no Python and is rewritten to
``variant_explode``.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SCHEMA = "key string, value string, type string, atom string, id int, parent int, fullkey string, path string"


def kind_of(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    kinds = {int: "integer", float: "real", str: "text", list: "array", dict: "object"}
    return kinds[type(value)]


def shown(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(int(value))
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def walk(text: str | None, path: str):
    """Rows from the outermost value inwards, each before those within it."""
    if text is None:
        return
    stack = [(None, json.loads(text), None, path, path)]
    number = 0
    while stack:
        key, value, parent, full, within = stack.pop()
        kind = kind_of(value)
        yield key, shown(value), kind, None if kind in ("array", "object") else shown(value), number, parent, full, within
        inner = []
        if isinstance(value, dict):
            inner = [(k, v, number, f"{full}.{k}", full) for k, v in value.items()]
        elif isinstance(value, list):
            inner = [(str(i), v, number, f"{full}[{i}]", full) for i, v in enumerate(value)]
        stack += reversed(inner)
        number += 1


@udtf(returnType=SCHEMA)
class JsonTree:
    def eval(self, text: str, path: str):
        yield from walk(text, path)


def register(spark: SparkSession) -> None:
    spark.udtf.register("json_tree_rows", JsonTree)
