"""Quality rules: cross-document line frequency.

Every line is normalised (lower-cased A-Z, white space collapsed) and hashed;
for each host and line the documents that hold it are counted.  Lines in more
than ``max_docs`` documents of a host are boilerplate and are removed there; a
document of which less than ``min_left`` percent of the words remains is
depleted and rejected.  Simple counts of the text itself reject short and
repetitive documents first.

Texts are read once; hashes of lines travel, texts don't.  A line counts once
in a document, and counts are combined before they shuffle, so that no task
gets all documents of a frequent line.  Only lines that a bitmap takes for
frequent ones go back to meet their host's list, spread over ``SALTS`` copies
of it, as one line may be in a third of all documents.

Null texts have no words and are rejected.  A null host is a host.  Repeated
rows and copies are documents of their own, judged and counted each.  An empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounded, materialize, text_of
from .exact_dedup import passing

MAX_DOCS = 20
MIN_LEFT = 50
MIN_WORDS = 50
MAX_REPEAT = 50
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
SALTS = 16


def hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that are in the text twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == len(words):
        return 0
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:  # else the third factor fits 63 bits as it is
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(seen) + ids[2:]
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def profile(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines)."""
    data = text.encode()
    words = data.split()
    seen: set[str] = set()
    again, lines = 0, []
    for line in text.split("\n"):
        parts = line.encode().lower().split()
        if parts:
            again += line in seen
            seen.add(line)
            lines.append({"h": hash64(b" ".join(parts)), "w": len(parts)})
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), again, repeated_words(words), lines


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINES = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))


def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = list(zip(*(profile(t.as_py()) for t in batch["text"]), strict=True)) or [()] * 6
        arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], LINES)]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], *arrays], names=["id", "host", *BASE, "lines"])


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT) -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, kept and the lines and
    words removed."""
    arrow_bounded(docs.sparkSession)
    plain = docs.select(F.col(doc_id).alias("id"), F.col(host).alias("host"), text_of(text).alias("text"))
    ids, hosts = (plain.schema[c].dataType.simpleString() for c in ("id", "host"))
    base = ", ".join(f"{c} long" for c in BASE)
    found = plain.mapInArrow(profiles, f"id {ids}, host {hosts}, {base}, lines array<struct<h: bigint, w: bigint>>")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "rules-profiles")
    lines = found.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("docs"))
    frequent = counts.filter(F.col("docs") > max_docs).select("host", "h", F.xxhash64("host", "h").alias("at"))
    frequent = materialize(frequent, "rules-frequent")
    each = found.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.w")
    _, maybe = passing(each.withColumn("at", F.xxhash64("host", "h")), "at", frequent.select("at"))
    spread = frequent.select(F.col("host").alias("_host"), F.col("h").alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    same = (F.col("h") == F.col("_h")) & (F.pmod(F.col("row"), F.lit(SALTS)) == F.col("_salt")) & F.col("host").eqNullSafe(F.col("_host"))
    gone = maybe.join(spread, same).groupBy("row").agg(F.count("*").alias("removed_lines"), F.sum("w").alias("removed_words"))
    zero = F.lit(0).cast("long")
    out = found.join(gone, "row", "left").withColumns({c: F.coalesce(c, zero) for c in ("removed_lines", "removed_words")})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    kept = ~failed & (100 * (F.col("n_words") - F.col("removed_words")) >= min_left * F.col("n_words"))
    return out.select(F.col("id").alias(doc_id), *BASE, failed.alias("base_failed"), kept.alias("kept"), "removed_lines", "removed_words")
