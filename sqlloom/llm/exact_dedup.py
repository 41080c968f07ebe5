"""Exact dedup: two passes of a Bloom filter, DataFrame functions only.

Pass one counts the hashes that fall on each cell of a filter, combined before
they shuffle, and sets the bits of the cells that were hit more than once.
Pass two looks every row up in those bits: rows on clear bits are unique and
pass straight through; the others, copies and the few false positives, shuffle
and are grouped by the SHA-256 of the normalised text, so that the result is
exact whatever the filter says.

The filter has ``BITS_PER_ROW`` cells a row and one hash: a row is taken for a
possible copy by mistake in one of sixteen.  A second hash would make it one of
seventy, and pass one would shuffle twice as many cells, which is dearer than
the rows saved.  Cells travel one by one: at 1,000 tasks a bitmap of each task
would be fuller of zeros than of hits.

A filter of at most ``max_filter_bits`` is broadcast.  A larger one is kept in
buckets of 32,768 bits, and rows meet their bucket in a join by bucket, dealt
once; only hashes and numbers of rows travel, never texts.

Equal means identical after lower-casing A-Z; a null text equals the empty
one.  The row with the largest id stays (null ids are the smallest); of rows
that repeat the id as well, one stays.  An empty table gives no rows; other
columns of the input are ignored by ``groups`` and kept by ``distinct``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, text_of

BITS_PER_ROW = 16
BITMAP_BITS = 32768  #: fixed by Spark's bitmap functions
MAX_FILTER_BITS = 1 << 28  #: 32 MB


def fingerprint(text: str) -> Column:
    return F.sha2(ascii_lower(text_of(text)), 256)


def set_bit(bits: str, position: str) -> Column:
    """Whether a bitmap (null: none set) has the bit at ``position``."""
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(position) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.expr(f"shiftleft(1, cast({position} % 8 as int))")) != 0, F.lit(False))


def looked_up(rows: DataFrame, cell: Column, bits: DataFrame, small: bool) -> DataFrame:
    """``rows`` with ``__dedup_may``: whether the bit of their cell is set.

    Cells count from 1, as the bitmap functions number their buckets.
    """
    looked = rows.withColumns({"__dedup_at": F.bitmap_bucket_number(cell), "__dedup_position": F.bitmap_bit_position(cell)})
    mine = F.broadcast(bits) if small else bits
    looked = looked.join(mine, F.col("__dedup_at") == F.col("__dedup_bucket"), "left")
    return looked.withColumn("__dedup_may", set_bit("__dedup_bits", "__dedup_position")).drop("__dedup_at", "__dedup_position", "__dedup_bucket", "__dedup_bits")


def bitmaps(cells: DataFrame) -> DataFrame:
    """(__dedup_bucket, __dedup_bits) of the cells in the column ``cell``."""
    placed = cells.groupBy(F.bitmap_bucket_number("cell").alias("__dedup_bucket"))
    return materialize(placed.agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("__dedup_bits")), "dedup-filter")


def possibly_repeated(keys: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Splits ``keys`` (with a long column ``h``) into unique and maybe repeated rows."""
    cells = max(BITMAP_BITS, keys.count() * BITS_PER_ROW)
    cell = F.pmod(F.col("h"), F.lit(cells)) + 1
    hit = keys.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).filter("n > 1").select("cell")
    looked = looked_up(keys, cell, bitmaps(hit), cells <= max_filter_bits)
    return tuple(looked.filter(c).select(keys.columns) for c in (~F.col("__dedup_may"), F.col("__dedup_may")))


def passing(rows: DataFrame, column: str, ids: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` is surely not among ``ids``, rows where it may be).

    ``ids`` has one column.  Only the second need to shuffle to meet them; the
    filter that tells is broadcast, and larger lists of ids get fewer bits each:
    at one bit an id 63 % of the other rows are taken for members.  With less
    than that it isn't worth its broadcast, and all rows count as members.
    """
    n = ids.count()
    if n > max_filter_bits:
        return rows.filter(F.lit(False)), rows
    cells = min(max_filter_bits, max(BITMAP_BITS, n * BITS_PER_ROW))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(cells)) + 1
    looked = looked_up(rows, place(column), bitmaps(ids.select(place(ids.columns[0]).alias("cell"))), True)
    return tuple(looked.filter(c).select(rows.columns) for c in (~F.col("__dedup_may"), F.col("__dedup_may")))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per row: id, keep_id, group_size, kept, text_sha256."""
    keys = docs.select(F.col(doc_id).alias("id"), fingerprint(text).alias("sha"))
    keys = materialize(keys.withColumns({"h": F.xxhash64("sha"), "row": F.monotonically_increasing_id()}), "dedup-keys")
    unique, maybe = possibly_repeated(keys, max_filter_bits)
    best = maybe.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("n")).filter("n > 1")
    best = materialize(best, "dedup-groups")
    in_group = maybe.join(best, "sha", "left")
    alone = F.col("best").isNull()
    again = in_group.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
        "sha",
    )
    straight = unique.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return straight.unionAll(again).toDF(doc_id, "keep_id", "group_size", "kept", "text_sha256")


def distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Only rows that may be copies are hashed again and matched; all others pass
    straight through.  The match is by id and hash, and always a sort-merge
    join, so that the plan is the same for every size.
    """
    found = groups(docs, doc_id, text).filter("group_size > 1")
    copies = materialize(found.select(F.col(doc_id).alias("__dedup_id"), F.col("text_sha256").alias("__dedup_sha"), F.col("kept").alias("__dedup_kept")), "dedup-copies")
    straight, maybe = passing(docs, doc_id, copies.select("__dedup_id"))
    mine = maybe.withColumn("__dedup_hash", fingerprint(text))
    same = mine[doc_id].eqNullSafe(F.col("__dedup_id")) & (F.col("__dedup_hash") == F.col("__dedup_sha"))
    told = copies.groupBy("__dedup_id", "__dedup_sha").agg(F.count("*").alias("__dedup_rows"), F.max("__dedup_kept").alias("__dedup_one"))
    told = materialize(told, "dedup-told")
    # Rows of no group, and rows that are the only one of their id in a group.
    known = told.select("__dedup_id", "__dedup_sha", (F.col("__dedup_one") & (F.col("__dedup_rows") == 1)).alias("__dedup_stays")).hint("merge")
    out = mine.join(known, same, "left").filter(F.coalesce("__dedup_stays", F.lit(True)))
    both = straight.unionAll(out.select(docs.columns))
    twice = told.filter("__dedup_one and __dedup_rows > 1")
    if twice.isEmpty():
        return both
    # Rows that repeat the id that stays: one of them.
    again = mine.join(twice, same, "left_semi").dropDuplicates([doc_id, "__dedup_hash"])
    return both.unionAll(again.select(docs.columns))
