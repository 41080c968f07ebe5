"""N-gram Jaccard self-join with count vectors in R-trees.

A document is its set of word n-grams, hashed to 64 bits.  Documents of equal
sets form a class, and classes are joined:

* Linked sets share an n-gram among the first n - ceil(t n) + 1 of each, in any
  order that holds for all sets.  The most frequent n-grams of a sample of the
  texts go last, so that the first ones are mostly rare; the sample changes the
  speed only.  Classes that share one of these form a bucket.
* A bucket goes into an R-tree.  A class is the point of its n-gram counts over
  ``GROUPS`` groups; the overlap of two sets is at most the sum of the smaller
  coordinates, which bounds whole nodes.  Nodes are bounded on ``COARSE`` sums
  of groups, points on all of them.  What survives ties classes together to
  neighbourhoods; a bucket returns a spanning forest, not its pairs.
* A neighbourhood goes into an R-tree with its sets, each of which travels once
  for most.  Pairs that survive are verified in the same task on the sets
  themselves.  A task returns the number of links of each class and a spanning
  forest of them, never the pairs.

An R-tree over all classes at once would be read leaf by leaf: two random sets
are told apart by their points, but a node's largest coordinates bound almost
nothing, so that time would grow with the square of the table.

Buckets and neighbourhoods are cut into blocks of ``BLOCK`` classes and
``BLOCK_GRAMS`` n-grams, and a task holds two blocks.  Time is quadratic in the
different texts of a neighbourhood, as the number of its links may be; copies
cost nothing.

Null texts and texts without words have no n-grams and link with nothing.
Shorter texts than n words are one n-gram.  Repeated rows are documents of
their own, in one class.  An empty table gives no rows; other columns of the
input are ignored by ``join`` and kept by ``representatives``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounded, discard, give_back, materialize, release, text_of
from .components import components
from .exact_dedup import passing

GROUPS = 256  #: of the trees' points
PER_GROUP = 8  #: n-grams of a group of a fine point, at most on average
COARSE = 16
LEAF = 16
BLOCK = 1024  #: classes of a block
BLOCK_GRAMS = 1 << 19  #: n-grams of a block, unless one set has more
SAMPLE = 4096  #: texts in which n-grams are counted, about; more of large tables:
SAMPLE_PART = 16  #: one in so many
FREQUENT = 1 << 18  #: n-grams that go last, at most (2 MB)
ROWS = 512  #: texts that are described at once
FLUSH = 20_000  #: rows of a result batch
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * M1
    x = (x ^ x >> np.uint64(29)) * M2
    return x ^ x >> np.uint64(32)


WHITE = np.zeros(256, bool)
WHITE[list(b" \t\n\v\f\r")] = True
PLACES = 64
#: A value for each byte at each place of a word; a word's hash is their sum.
VALUES = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * M3)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each lower-cased word, in order."""
    data = np.frombuffer(text.lower(), np.uint8)
    at = np.flatnonzero(~WHITE[data])
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    value = VALUES[place % PLACES * 256 + data[at]]
    if length.max() > PLACES:  # further places multiply by odd numbers
        value *= mix((place // PLACES).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64) * M1)


def grams(text: bytes, size: int) -> np.ndarray:
    """Distinct hashed n-grams of the lower-cased words, in order."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out * M3 + h[k : k + n])
    return np.unique(out)


def leading(found: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The n-grams of which linked sets share one: by whether they are among
    the sorted ``frequent``, then by hash."""
    n = len(found)
    first = n + (-percent * n // 100) + 1 if n else 0
    late = np.zeros(n, bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
    return found[np.lexsort((mix(found + M1), late))[:first]]


def fine_point(found: np.ndarray) -> np.ndarray:
    """Counts over so many groups that each holds a few n-grams; the first bits
    of an n-gram are its group, so that neighbours add up to coarser groups."""
    bits = max(8, int(len(found) / PER_GROUP - 1).bit_length())
    return np.bincount((found >> np.uint64(64 - bits)).astype(np.intp), minlength=1 << bits)


def pack(counts: np.ndarray) -> bytes:
    """A mark, then one byte a group where that holds all counts, else four."""
    small = not len(counts) or counts.max() < 256
    return bytes([bool(small)]) + counts.astype(np.uint8 if small else np.int32).tobytes()


def unpack(point: bytes) -> np.ndarray:
    return np.frombuffer(point, np.uint8 if point[0] else np.int32, offset=1).astype(np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point if len(point) == groups else point.reshape(groups, -1).sum(1, dtype=np.int32)


def set_key(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def describe(size: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, keys, sigs, points = [], [], [], []
            for text in batch["text"].cast(pa.binary()):
                found = grams(text.as_py(), size)
                n.append(len(found))
                keys.append(set_key(found))
                sigs.append(leading(found, percent, frequent.value).view(np.int64))
                points.append(pack(fine_point(found)))
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["hash"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), flat, pa.array(points, pa.binary())], names=["id", "hash", "n", "key", "sigs", "point"])

    return run


def gram_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for t in batch["text"].cast(pa.binary()):
                yield pa.record_batch([pa.array(grams(t.as_py(), size).view(np.int64))], names=["gram"])

    return run


def frequent_grams(plain: DataFrame, size: int) -> np.ndarray:
    """N-grams of two texts or more of a sample, the most frequent first kept."""
    rows = plain.count()
    part = min(1 << 20, max((1 << 20) // SAMPLE_PART, -(-SAMPLE * (1 << 20) // max(rows, 1))))
    sample = plain.select("text").distinct() if part == 1 << 20 else plain.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 20)) < part).select("text").distinct()
    counts = sample.mapInArrow(gram_rows(size), "gram long").groupBy("gram").count().filter("count > 1")
    found = counts.orderBy(F.desc("count"), "gram").limit(FREQUENT).select("gram").toArrow()
    return np.sort(found["gram"].to_numpy().astype(np.int64).view(np.uint64))


def set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [grams(t.as_py(), size) for t in batch["text"].cast(pa.binary())]
            yield pa.record_batch([pa.array(map(set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "grams"])

    return run


class RTree:
    """Bulk-loaded over count vectors; a node keeps the largest coordinate of
    its points in each coarse group, and their smallest set."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        coarse = self.coarse(points)
        order = np.lexsort((coarse[:, 1], coarse[:, 0], sizes))
        self.order, self.percent, self.points = order, percent, points[order]
        self.levels = [(coarse[order], sizes[order])]
        while len(self.levels[-1][0]) > LEAF:
            high, low = self.levels[-1]
            at = np.arange(0, len(high), LEAF)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(low, at)))

    @staticmethod
    def coarse(points: np.ndarray) -> np.ndarray:
        return points.reshape(len(points), COARSE, -1).sum(2, dtype=np.int32)

    def query(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points whose bound on the overlap lets them link."""
        near = self.coarse(point[None])[0]
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            bound = np.minimum(high[at], near).sum(1, dtype=np.int64)
            at = at[(100 + self.percent) * bound >= self.percent * (size + low[at])]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        bound = np.minimum(self.points[at], point).sum(1, dtype=np.int64)
        return self.order[at[(100 + self.percent) * bound >= self.percent * (size + self.levels[0][1][at])]]


def count_vectors(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The points of sets that lie one after another in ``flat``."""
    row = np.repeat(np.arange(len(n)), n)
    group = (flat >> np.uint64(56)).astype(np.int64)
    return np.bincount(row * GROUPS + group, minlength=len(n) * GROUPS).reshape(len(n), GROUPS).astype(np.int32)


class Cell:
    """The classes of one or two blocks of a neighbourhood."""

    def __init__(self, i: int, j: int, rows: list[tuple], percent: int):
        """Of blocks i and j; rows: node, block, copies, grams; by node."""
        self.node, block, self.copies = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:3])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        self.n = np.array(list(map(len, sets)), np.int64)
        flat = np.concatenate(sets)
        self.start = np.cumsum(self.n) - self.n
        self.points = count_vectors(flat, self.n)
        self.number = np.unique(flat, return_inverse=True)[1]
        self.mark = np.zeros(len(flat), bool)
        self.one = i == j
        self.held, self.asks = np.flatnonzero(block == i), np.flatnonzero(block == j)
        self.percent = percent

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """A class and the classes that it links with, each pair once."""
        if not len(self.held):
            return
        tree = RTree(self.points[self.held], self.n[self.held], self.percent)
        for i in self.asks:
            got = self.held[tree.query(self.points[i], self.n[i])]
            if self.one:
                got = got[got < i]
            if len(got):
                linked = got[self.verified(i, got)]
                if len(linked):
                    yield i, linked

    def verified(self, i: int, got: np.ndarray) -> np.ndarray:
        """Which of the sets ``got`` link with set i."""
        mine = self.number[self.start[i] : self.start[i] + self.n[i]]
        self.mark[mine] = True
        n = self.n[got]
        first = np.cumsum(n) - n
        at = np.repeat(self.start[got] - first, n) + np.arange(n.sum())
        shared = np.add.reduceat(self.mark[self.number[at]], first, dtype=np.int64)
        self.mark[mine] = False
        return 100 * shared >= self.percent * (self.n[i] + n - shared)

    def found(self) -> Iterator[tuple]:
        """(node, null, links) of each class, (node, node, null) of a forest."""
        count = np.zeros(len(self.node), np.int64)
        root = np.arange(len(self.node))
        for i, linked in self.links():
            count[i] += self.copies[linked].sum()
            count[linked] += self.copies[i]
            old = np.unique(np.append(root[linked], root[i]))
            if len(old) > 1:
                root[np.isin(root, old)] = old[0]
        for i in np.flatnonzero(count):
            yield int(self.node[i]), None, int(count[i])
            if root[i] != i:
                yield int(self.node[root[i]]), int(self.node[i]), None


class Bucket:
    """The points of one or two blocks of a bucket."""

    def leaf(self) -> Iterator[tuple]:
        bound = np.minimum(self.points[:, None], self.points[None]).sum(2)
        near = (100 + self.percent) * bound >= self.percent * (self.n[:, None] + self.n[None])
        root = list(range(len(self.n)))
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            if root[i] != root[j] and self.near(i, j):
                old, new = root[j], root[i]
                root = [new if r == old else r for r in root]
                yield int(self.node[i]), int(self.node[j])

    def __init__(self, i: int, j: int, rows: list[tuple], percent: int):
        """Of blocks i and j; rows: node, block, n, point; by node."""
        self.node, block, self.n = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:3])
        self.fine = [unpack(r[3]) for r in rows]
        self.points = np.stack([folded(p, GROUPS) for p in self.fine])
        self.held, self.asks = np.flatnonzero(block == i), np.flatnonzero(block == j)
        self.percent = percent

    def near(self, i: int, j: int) -> bool:
        """Whether the finer points of two sets let them link."""
        groups = min(len(self.fine[i]), len(self.fine[j]))
        if groups == GROUPS:
            return True
        bound = np.minimum(folded(self.fine[i], groups), folded(self.fine[j], groups)).sum()
        return (100 + self.percent) * bound >= self.percent * (self.n[i] + self.n[j])

    def found(self) -> Iterator[tuple]:
        """(node, node) of a forest over the pairs whose bound lets them link."""
        if not len(self.held):
            return
        if len(self.node) <= LEAF and len(self.held) == len(self.node):  # one leaf
            yield from self.leaf()
            return
        tree = RTree(self.points[self.held], self.n[self.held], self.percent)
        root = np.arange(len(self.node))
        for i in self.asks:
            if (root == root[0]).all():
                return
            got = self.held[tree.query(self.points[i], self.n[i])]
            if len(self.fine[i]) > GROUPS:
                got = np.array([j for j in got if self.near(i, j)], np.intp)
            old, first = np.unique(root[got], return_index=True)
            for j in got[first][old != root[i]]:
                yield int(self.node[i]), int(self.node[j])
            root[np.isin(root, old)] = root[i]


def in_cells(kind: type, percent: int, by: str, columns: tuple[str, str], names: list[str]):
    """What ``kind`` finds in each cell; rows come sorted by cell and node."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[tuple]]]:
        now, rows = None, []
        for batch in batches:
            plain = [batch[c].to_pylist() for c in (by, "i", "j", "node", "block", columns[0])]
            for *row, found in zip(*plain, batch[columns[1]], strict=True):
                if row[:3] != now:
                    if rows:
                        yield now, rows
                    now, rows = row[:3], []
                rows.append((*row[3:], found.as_py()))
        if rows:
            yield now, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rows = list(dict.fromkeys(held)) if kind is Bucket else held  # many buckets tie the same classes
            made = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            held.clear()
            return pa.record_batch(made, names=names)

        for (_, i, j), rows in cells(batches):
            if len(rows) > 1:
                held += kind(i, j, rows, percent).found()
            if len(held) >= FLUSH:
                yield flush()
        if held:
            yield flush()
        give_back()

    return run


def in_blocks(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks, of its ``blocks``, that has its."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> named_struct('i', least(x, block), 'j', greatest(x, block)))")
    return placed.withColumn("ij", F.explode(pairs)).withColumns({"i": F.col("ij.i"), "j": F.col("ij.j")}).drop("ij", "blocks")


def joined(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """One row per row of ``docs``: id, hash of the text, n, component, links, keeps."""
    spark = docs.sparkSession
    arrow_bounded(spark)
    plain = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    frequent = spark.sparkContext.broadcast(frequent_grams(plain, size))
    hashed = plain.withColumn("hash", F.xxhash64("text"))
    found = hashed.mapInArrow(describe(size, percent, frequent), f"id {kind}, hash long, n long, key binary, sigs array<long>, point binary")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "join-sets")
    classes = found.filter("n > 0").groupBy("key").agg(F.min(F.struct("id", "row")).alias("first"), F.min("id").alias("low"), F.min("n").alias("n"), F.count("*").alias("copies"))
    classes = materialize(classes.select("key", F.col("first.row").alias("node"), F.col("first.id").alias("id"), "low", "n", "copies"), "join-classes")

    # Leading n-grams that two classes or more have.  Rows that repeat a class
    # are told by a bitmap of their numbers; the wide rows don't shuffle.
    repeated = classes.filter("copies > 1").select("key", "node")
    repeats = found.filter("n > 0").select("key", "row").join(repeated, "key").filter("row <> node").select("row")
    repeats = materialize(repeats, "join-repeats")
    straight, maybe = passing(found.filter("n > 0").select("row", "n", "sigs", "point"), "row", repeats)
    mine = straight.unionAll(maybe.join(repeats, "row", "left_anti"))
    dealt = mine.select(F.col("row").alias("node"), F.explode("sigs").alias("sig"))
    common = materialize(dealt.groupBy("sig").agg(F.count("*").alias("times")).filter("times > 1").select("sig"), "join-common")
    members = materialize(passing(dealt, "sig", common)[1].join(common, "sig"), "join-members")
    release(spark)

    # Buckets of the same classes are read once.
    told = members.groupBy("sig").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    told = told.groupBy("size", "low", "high", "x", "y").agg(F.min("sig").alias("sig"))
    buckets = members.join(told.select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "sig")
    buckets = in_blocks(buckets).join(mine.select(F.col("row").alias("node"), "n", "point"), "node")
    buckets = buckets.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "node")
    ties = materialize(buckets.mapInArrow(in_cells(Bucket, percent, "sig", ("n", "point"), ["a", "b"]), "a long, b long"), "join-ties")
    release(spark)

    # Neighbourhoods, and the blocks of each.
    neighbours = components(ties)
    near = neighbours.withColumnRenamed("root", "near")
    placed = near.join(classes.select("node", "key", "id", "n", "copies"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    placed = materialize(placed.join(placed.groupBy("near").agg(blocks.alias("blocks")), "near"), "join-placed")
    _, maybe = passing(plain, "id", placed.select("id"))
    texts = maybe.join(placed.select("id").distinct().withColumnRenamed("id", "_id"), maybe["id"].eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = texts.mapInArrow(set_rows(size), "key binary, grams binary").dropDuplicates(["key"])
    cells = in_blocks(placed).join(sets, "key").select("near", "i", "j", "node", "block", "copies", "grams")
    cells = cells.repartition("near", "i", "j").sortWithinPartitions("near", "i", "j", "node")
    verified = materialize(cells.mapInArrow(in_cells(Cell, percent, "near", ("copies", "grams"), ["a", "b", "links"]), "a long, b long, links long"), "join-links")

    roots = components(verified.filter("b is not null").select("a", "b"))
    counts = verified.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    rooted = classes.join(roots, "node", "left").join(counts, "node", "left")
    rooted = rooted.select("key", "node", "low", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    lows = rooted.groupBy("root").agg(F.min(F.struct("low", "node")).alias("best"))
    named = rooted.join(lows, "root").select("key", F.col("best.low").alias("component"), (F.col("best.node") == F.col("node")).alias("leads"), "node", "links")
    named = materialize(named, "join-components")
    discard(repeats, common, members, ties, neighbours, placed, verified, roots, classes)
    out = found.select("id", "hash", "n", "key", "row").join(named, "key", "left")
    keeps = F.col("node").isNull() | (F.col("leads") & (F.col("node") == F.col("row")))
    return out.select("id", "hash", "n", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"), keeps.alias("keeps"))


def join(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, links, keeps.

    ``component_id``: the smallest id that links reach.  ``links``: the number
    of other documents that it links with, copies counted.  ``keeps``: true for
    one row of each component.
    """
    out = joined(docs, size, percent, doc_id, text)
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "links", "keeps")


def representatives(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one that ``keeps`` names.

    Rows are told by id and text, so that rows of one id with other texts stay.
    """
    told = joined(docs, size, percent, doc_id, text).filter("n > 0").groupBy("id", "hash")
    told = told.agg(F.count_if(F.col("keeps")).alias("kept"), F.count("*").alias("rows")).filter("kept < rows")
    told = materialize(told.select(F.col("id").alias("__join_id"), F.col("hash").alias("__join_hash"), (F.col("kept") > 0).alias("__join_kept")), "join-gone")
    straight, maybe = passing(docs, doc_id, told.select("__join_id"))
    hashed = maybe.withColumn("__join_text", F.xxhash64(text_of(text)))
    same = hashed[doc_id].eqNullSafe(F.col("__join_id")) & (F.col("__join_text") == F.col("__join_hash"))
    out = straight.unionAll(hashed.join(told, same, "left_anti").select(docs.columns))
    twice = told.filter("__join_kept")
    if twice.isEmpty():
        return out
    # Rows that are repeated whole: one of each that leads its component.
    one = hashed.join(twice, same, "left_semi").groupBy(doc_id, "__join_text").agg(F.first(F.struct(*docs.columns)).alias("__join_row"))
    return out.unionAll(one.select("__join_row.*"))
