"""Mixing sources to target weights, DataFrame and SQL functions only.

Every source is cut into blocks of documents by hash.  A source's quota is the
number of blocks to draw so that their words reach its target; the last block
is drawn in part.  A multivariate-hypergeometric splitting tree deals the
quotas to output shards: a node halves its shards, and draws how many of each
source's blocks go left as if all blocks had been shuffled, so that every
shard gets a random and exact share.  Within a source, draws run through a
permutation of its blocks (an affine map of the block number, another for each
pass), so that shards get disjoint blocks; a block comes again only after all
others of its source.  A shard's rows are shuffled by hash within the shard,
and ``mixed`` writes them shard by shard in that order.

Only sums travel: words per source, per block, and per 1,024 blocks for
running sums, so a source with a third of all rows is spread like the others.
The tree's rows hold one number per source.  All draws follow from hashes of
id, source and text, whatever the files look like; rows that agree in these
three are interchangeable.

Sizes count words; null texts have none.  Null is a source, last in order.
Repeated rows are documents of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, n_words, text_of
from .exact_dedup import passing

SEED = 20_240_501
#: Primes above any number of blocks, one for each pass: coprime to it.
STEPS = (2_147_483_629, 2_147_483_587, 2_147_483_579)
BLOCK_WORDS = 1 << 15
SHARD_WORDS = 1 << 22
RUN = 1024  #: blocks that are summed together
CHUNK = 256  #: sources that are drawn together


def targets(sizes: DataFrame, weights: list[int], share: float, limit: float) -> DataFrame:
    """One row per source: its words, rows, target; weights repeat in order.

    Sources whose weighted share is above ``limit`` times their size stop
    there, and the rest is shared again by weight until none is above.  In the
    order of limit over weight the stopped sources come first, so one running
    sum finds them.  Rows are as many as sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("i", F.row_number().over(order) - 1)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("i") % len(weights) + 1).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    per = per.withColumns({"budget": F.sum("source_size").over(every) * F.lit(float(share)), "all_w": F.sum("w").over(every)})
    per = per.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), zero), "w_before": F.coalesce(F.sum("w").over(before), zero)})
    stopped = F.col("cap") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("budget") - F.col("cap_before"))
    per = per.withColumn("stopped", stopped)
    used, used_w = (F.coalesce(F.sum(F.when(F.col("stopped"), F.col(c))).over(every), zero) for c in ("cap", "w"))
    per = per.withColumns({"used": used, "used_w": used_w})
    target = F.when(F.col("stopped"), F.col("cap")).otherwise(F.col("w") * (F.col("budget") - F.col("used")) / (F.col("all_w") - F.col("used_w")))
    return per.select("source", "i", "source_size", "rows", target.alias("target"))


def rank(block: Column, turn: Column, blocks: Column, i: Column) -> Column:
    """Place of a block in the permutation of pass ``turn`` (0, 1, 2)."""
    step = F.element_at(F.array(*map(F.lit, STEPS)), turn.cast("int") + 1)
    shift = F.pmod(F.xxhash64(F.lit(SEED), i, turn), F.lit(1 << 40))
    return F.pmod(block * step + shift, blocks)


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL: how many of ``marked`` among ``total`` are in a draw of ``drawn``.

    The inverse of the distribution at ``u``; weights run up by the ratio of
    neighbours, scaled by that of the mode, over twelve deviations to each side
    of it.  What lies beyond has less weight than a double resolves, so that
    the values to go through are as many as the root of the draw.
    """
    mode = f"floor((({drawn} + 1.0D) * ({marked} + 1.0D)) / ({total} + 2.0D))"
    spread = f"(12 + 12 * sqrt({drawn} * 1.0D * {marked} / greatest({total}, 1L) * ({total} - {marked}) / greatest({total}, 1L)))"
    low = f"greatest(0L, {drawn} - ({total} - {marked}), cast({mode} - {spread} as bigint))"
    high = f"least({drawn}, {marked}, cast({mode} + {spread} as bigint))"
    steps = f"if({high} > {low}, sequence({low} + 1, {high}), cast(array() as array<bigint>))"
    ratio = f"ln((({marked} - k + 1.0D) * ({drawn} - k + 1.0D)) / (k * ({total} - {marked} - {drawn} + k + 0.0D)))"
    top = f"aggregate({steps}, 0.0D, (a, k) -> if(k <= {mode}, a + {ratio}, a))"
    first = f"exp(-{top})"
    mass = f"aggregate({steps}, named_struct('l', -{top}, 't', {first}), (a, k) -> named_struct('l', a.l + {ratio}, 't', a.t + exp(a.l + {ratio})), a -> a.t)"
    start = f"named_struct('l', -{top}, 'c', {first}, 'm', {u} * {mass}, 'k', {low})"
    return f"aggregate({steps}, {start}, (a, k) -> if(a.c >= a.m, a, named_struct('l', a.l + {ratio}, 'c', a.c + exp(a.l + {ratio}), 'm', a.m, 'k', k)), a -> a.k)"


def total_of(numbers: str) -> str:
    return f"aggregate({numbers}, 0L, (a, x) -> a + x)"


def draws_of(numbers: str, room: str, name: str) -> str:
    """SQL: how many of each of ``numbers`` are in a draw of ``room`` of them all."""
    chance = f"pmod(xxhash64({SEED}, lo, hi, {name}, j), 4503599627370496L) / 4503599627370496.0D"
    draw = hypergeometric("s.rest", "x.q", "s.room", "x.u")
    return f"""aggregate(transform({numbers}, (c, j) -> named_struct('q', c, 'u', {chance})),
        named_struct('rest', {total_of(numbers)}, 'room', {room}, 'out', cast(array() as array<bigint>)),
        (s, x) -> transform(array({draw}), g -> named_struct('rest', s.rest - x.q, 'room', s.room - g, 'out', array_append(s.out, g)))[0],
        s -> s.out)"""


def split(quotas: DataFrame, shards: int) -> DataFrame:
    """(shard, i, quota): the splitting tree over one row with array ``q``.

    A node draws for chunks of ``CHUNK`` sources first, then within each, so
    that time grows with the number of sources.
    """
    chunks = f"transform(sequence(0, greatest(0, (size(q) - 1) div {CHUNK})), c -> slice(q, c * {CHUNK} + 1, {CHUNK}))"
    nodes = quotas.filter("q is not null").selectExpr("0L AS lo", f"{shards}L AS hi", f"{total_of('q')} AS all", f"{chunks} AS q")
    nodes = materialize(nodes, "mix-tree")
    at = lambda x, leaves=shards: f"floor(cast({x} as decimal(20)) * all / {leaves})"
    while shards > 1:
        done, todo = nodes.filter("hi - lo = 1"), nodes.filter("hi - lo > 1")
        todo = todo.withColumn("mid", F.expr("(lo + hi) div 2"))
        todo = todo.withColumns({"sums": F.expr(f"transform(q, c -> {total_of('c')})"), "room": F.expr(f"cast({at('mid')} - {at('lo')} as bigint)")})
        todo = todo.withColumn("parts", F.expr(f"arrays_zip(q, {draws_of('sums', 'room', '-1')}, sequence(0, size(q) - 1))").cast("array<struct<q: array<bigint>, room: bigint, n: int>>"))
        todo = todo.withColumn("left", F.expr(f"transform(parts, p -> {draws_of('p.q', 'p.room', 'p.n')})"))
        right = "zip_with(q, left, (x, y) -> zip_with(x, y, (a, b) -> a - b))"
        halves = todo.select(F.explode(F.expr(f"array(named_struct('lo', lo, 'hi', mid, 'all', all, 'q', left), named_struct('lo', mid, 'hi', hi, 'all', all, 'q', {right}))")).alias("x"))
        # A level is as small as its sums; written, it keeps the plans flat.
        above, nodes = nodes, materialize(done.unionAll(halves.select("x.lo", "x.hi", "x.all", "x.q")), "mix-tree")
        discard(above)
        shards = -(-shards // 2)
    leaves = nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("c", "part"))
    leaves = leaves.select("shard", "c", F.posexplode("part").alias("p", "quota"))
    return leaves.select("shard", (F.col("c") * CHUNK + F.col("p")).alias("i"), "quota")


def mix(docs: DataFrame, weights: list[int], share: float, limit: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, draws).

    documents: row, key, other (hashes of the whole row), id, size, source_size,
    target; draws: row, pass, shard, position, one for each time that the mix
    takes a row.
    """
    whole = row_keys(docs)
    sizes = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), n_words(text_of(text)).alias("size"), F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(source), F.col(text)).alias("h"), whole[0].alias("key"), whole[1].alias("other"))
    sizes = materialize(sizes.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sizes = sizes.withColumn("u", F.pmod("h", F.lit(1 << 52)) / F.lit(float(1 << 52)))
    blocks = F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("rows")) / block_words)).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = targets(sizes, weights, share, limit).withColumns({"blocks": blocks, "full": full})
    per = materialize(per.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-sources")
    placed = sizes.join(per, sizes["source"].eqNullSafe(per["source"])).drop(per["source"])
    placed = placed.withColumn("block", F.floor(F.col("u") * F.col("blocks")).cast("long"))

    # Words before each block, in the order of the pass that is drawn in part.
    sums = placed.groupBy("i", "block", "blocks", "full", "rest").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("rank", rank(F.col("block"), F.col("full"), F.col("blocks"), F.col("i"))).withColumn("run", F.floor(F.col("rank") / RUN))
    sums = materialize(sums, "mix-blocks")
    up_to = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.groupBy("i", "run").agg(F.sum("words").alias("run_words"))
    runs = runs.select("i", "run", F.coalesce(F.sum("run_words").over(up_to("i", "run")), F.lit(0)).alias("before_run"))
    within = F.coalesce(F.sum("words").over(up_to("i", "run", "rank")), F.lit(0))
    state = sums.withColumn("within", within).join(runs, ["i", "run"]).withColumn("before", F.col("before_run") + F.col("within"))
    state = materialize(state.drop("run", "within", "before_run", "words"), "mix-running")
    partial = (F.col("before") < F.col("rest")) & (F.col("rest") >= 1)
    drawn = state.filter(partial)
    # A draw's number counts blocks without documents too, so the quota does.
    parts = materialize(drawn.groupBy("i").agg((F.max("rank") + 1).alias("part")), "mix-parts")
    quotas = per.join(parts, "i", "left")
    quotas = quotas.withColumn("q", F.col("full") * F.col("blocks") + F.coalesce("part", F.lit(0)))
    total = quotas.agg(F.sum("q")).first()[0] or 0
    shards = max(1, -(-total * block_words // shard_words))
    one = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))
    leaves = split(one, shards).filter("quota > 0")
    leaves = leaves.withColumn("end", F.sum("quota").over(Window.partitionBy("i").orderBy("shard")))
    numbered = leaves.select("i", "shard", F.explode(F.expr("sequence(end - quota, end - 1)")).alias("draw"))

    turns = state.filter("full > 0").withColumn("pass", F.explode(F.expr("sequence(0L, full - 1)")))
    whole = turns.select("i", "block", "blocks", "pass", rank(F.col("block"), F.col("pass"), F.col("blocks"), F.col("i")).alias("rank"), F.lit(None).cast("double").alias("budget"))
    left = drawn.join(parts, "i")
    left = left.select("i", "block", "blocks", F.col("full").alias("pass"), "rank", F.when(F.col("rank") == F.col("part") - 1, F.col("rest") - F.col("before")).alias("budget"))
    draws = whole.unionAll(left).withColumn("draw", F.col("pass") * F.col("blocks") + F.col("rank"))
    dealt = F.coalesce("shard", F.raise_error(F.lit("a drawn block has no shard")).cast("long")).alias("shard")
    draws = draws.join(numbered, ["i", "draw"], "left").select("i", "block", "pass", dealt, "budget")
    rows = placed.select("row", "h", "size", "i", "block").join(draws, ["i", "block"])

    # The block in part: its documents from the largest down, while they fit.
    fits = "named_struct('left', budget, 'rows', cast(array() as array<struct<row: bigint, h: bigint>>))"
    cut = rows.filter("budget IS NOT NULL").groupBy("i", "pass", "shard", "budget").agg(F.sort_array(F.collect_list(F.struct("size", "h", "row")), False).alias("docs"))
    take = f"aggregate(docs, {fits}, (a, d) -> if(d.size <= a.left, named_struct('left', a.left - d.size, 'rows', array_append(a.rows, named_struct('row', d.row, 'h', d.h))), a), a -> a.rows)"
    cut = cut.select(F.explode(F.expr(take)).alias("x"), "pass", "shard").select("x.row", "x.h", "pass", "shard")
    taken = materialize(rows.filter("budget IS NULL").select("row", "h", "pass", "shard").unionAll(cut), "mix-taken")
    by_hash = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "shard", "h", "pass"), "h", "pass", "row")
    taken = taken.withColumn("position", F.row_number().over(by_hash).cast("long")).drop("h")
    documents = placed.select("row", "key", "other", "id", "size", "source_size", "target")
    return documents, taken


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes that tell rows by all their columns."""
    return F.xxhash64(*docs.columns), F.xxhash64(F.lit(SEED), *docs.columns)


def takes(docs: DataFrame, weights: list[int], share: float, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: its size, its source's size and target, the
    words that the mix takes of it, repeats counted, and the places (shard and
    position there) at which it takes them."""
    documents, draws = mix(docs, weights, share, doc_id=doc_id, **options)
    places = draws.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("shard", "position"))).alias("places"))
    out = documents.join(places, "row", "left")
    times = F.coalesce(F.size("places"), F.lit(0))
    none = F.array().cast("array<struct<shard: bigint, position: bigint>>")
    return out.select(F.col("id").alias(doc_id), "size", "source_size", "target", (F.col("size") * times).alias("taken"), F.coalesce("places", none).alias("places"))


def mixed(docs: DataFrame, weights: list[int], share: float, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept,
    shard by shard, each in its shuffled order.

    Draws meet the rows by two hashes of all columns; rows that are the same in
    all columns stand for each other.
    """
    documents, draws = mix(docs, weights, share, doc_id=doc_id, **options)
    drawn = materialize(documents.select("row", "key", "other").join(draws, "row").select(F.col("key").alias("__mix_key"), F.col("other").alias("__mix_other"), F.col("shard").alias("__mix_shard"), F.col("position").alias("__mix_position")), "mix-drawn")
    twice = materialize(documents.groupBy("key", "other").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("__mix_twice"), "other"), "mix-twice")
    key, other = row_keys(docs)
    rows = docs.withColumns({"__mix_key1": key, "__mix_key2": other})
    if not twice.isEmpty():
        once, again = passing(rows, "__mix_key1", twice.select("__mix_twice"))
        rows = once.unionAll(again.dropDuplicates(["__mix_key1", "__mix_key2"]))
    same = (F.col("__mix_key1") == F.col("__mix_key")) & (F.col("__mix_key2") == F.col("__mix_other"))
    out = rows.join(drawn.hint("merge"), same)
    return out.repartition("__mix_shard").sortWithinPartitions("__mix_shard", "__mix_position").select(docs.columns)
