import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import clash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sqlloom.llm import byte_bpe, byte_conv, chat, context_mixing, exact_dedup, mixing, ngram_join, quality_rules, token_counts, warc
from sqlloom.llm.common import crc_fold, materialize

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNT = public_tokenizers.path("word_bpe_49k.json")
WHITE = b" \t\n\x0b\x0c\r"


def words(text, lower=True):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def lower_ascii(text):
    return (text or "").encode().lower()


# exact dedup


def brute_groups(data):
    groups = defaultdict(list)
    for doc_id, text, *_ in data:
        groups[lower_ascii(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left, hashlib.sha256(text).hexdigest()))
            left = left and i != keep
    return out


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_dedup_matches_brute_force(documents, data, bits):
    got = [tuple(r) for r in exact_dedup.groups(documents, max_filter_bits=bits).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_groups(data)))


def test_dedup_filter_in_a_join(documents, data, monkeypatch):
    """A filter beyond the bound: rows meet its buckets in a join."""
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 2048)
    out = exact_dedup.groups(documents, max_filter_bits=1 << 15)
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_groups(data)))


@pytest.mark.parametrize("bits", [1 << 28, 1 << 15, 40])
def test_passing_loses_no_member(spark, bits):
    rows = spark.range(3000).selectExpr("nullif(id, 7) AS id", "id * 2 AS other")
    ids = rows.filter("id % 60 = 0 or id is null").select("id")
    no, maybe = exact_dedup.passing(rows, "id", ids, bits)
    assert no.columns == maybe.columns == ["id", "other"]
    members, others = ({r["other"] for r in f.collect()} for f in (maybe, no))
    assert members | others == {2 * i for i in range(3000)} and not members & others
    assert {0, 14, 120, 5880} <= members and (bits < 1 << 28 or len(members) < 600)


def test_dedup_distinct_keeps_columns(documents, data):
    left = exact_dedup.distinct(clash(documents))
    assert set(documents.columns) <= set(left.columns)
    got = Counter((r["doc_id"], lower_ascii(r["text"])) for r in left.collect())
    want = Counter()
    for i, _, _, kept, sha in brute_groups(data):
        if kept:
            want[i, sha] += 1
    assert Counter((i, hashlib.sha256(t).hexdigest()) for (i, t) in got.elements()) == want


# mixing


def water_fill(sizes, weights, share, limit):
    left, target = dict(sizes), {}
    budget = share * sum(sizes.values())
    w = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    while left:
        unit = budget / sum(w[s] for s in left)
        over = [s for s in left if w[s] * unit > limit * sizes[s]]
        if not over:
            return target | {s: w[s] * unit for s in left}
        for s in over:
            target[s] = limit * sizes[s]
            budget -= target[s]
            del left[s]
    return target


def test_mixing_targets_and_limits(documents, data):
    out = mixing.takes(documents, [5, 2, 1], 1.5, block_words=500, shard_words=2000).collect()
    assert len(out) == len(data)
    size = defaultdict(int)
    for _, text, _, source, _ in sorted(data, key=lambda r: (r[3] is None, (r[3] or "").encode())):
        size[source] += len(words(text))
    want = water_fill(size, [5, 2, 1], 1.5, 2)
    source_of = defaultdict(set)
    for i, _, _, s, _ in data:
        source_of[i].add(s)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        s = next(iter(source_of[r["doc_id"]]))
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s, t in taken.items():
        assert t <= want[s] + 1e-6 and t >= want[s] - max(60, 0.05 * want[s]), (s, t, want[s])
    again = mixing.takes(documents, [5, 2, 1], 1.5, block_words=500, shard_words=2000).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_mixing_draws_are_disjoint_and_sharded(documents):
    rows, draws = mixing.mix(documents, [5, 2, 1], 1.5, block_words=300, shard_words=1200)
    got = draws.collect()
    assert len({(r["row"], r["pass"]) for r in got}) == len(got)
    shards = Counter(r["shard"] for r in got)
    assert len(shards) > 4
    for s in shards:
        assert sorted(r["position"] for r in got if r["shard"] == s) == list(range(1, shards[s] + 1))


@pytest.mark.parametrize("share", [0.5, 0.9, 1.5])
def test_mixing_of_documents_larger_than_a_block(spark, share):
    rows = [(i, "w " * (600 + i % 7), f"s{i % 2}") for i in range(120)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, source string"), "long")
    out = mixing.takes(docs, [1], share, block_words=300, shard_words=9000).collect()
    taken = Counter()
    for r in out:
        taken[r["source_size"], r["target"]] += r["taken"]
    assert len(out) == len(rows) and taken
    for (_, target), n in taken.items():
        assert target - 607 < n <= target + 1e-6


def test_mixing_does_not_depend_on_the_files(spark, documents):
    """Blocks, draws, shards and order are those of other files with the same rows."""
    options = {"block_words": 500, "shard_words": 2000}
    other = materialize(documents.repartition(7, "text").orderBy(F.desc("n_chars")), "other")
    a, b = (Counter(map(repr, mixing.takes(d, [5, 2, 1], 1.5, **options).collect())) for d in (documents, other))
    assert a == b
    a, b = ([repr(r) for r in mixing.mixed(d, [5, 2, 1], 1.5, **options).collect()] for d in (documents, other))
    assert a == b


def test_mix_is_written_by_shard(documents):
    options = {"block_words": 300, "shard_words": 1200}
    takes = mixing.takes(documents, [5, 2, 1], 1.5, **options).collect()
    place = {(p["shard"], p["position"]): r["doc_id"] for r in takes for p in r["places"]}
    assert len(place) == sum(len(r["places"]) for r in takes) and len({s for s, _ in place}) > 4
    out = mixing.mixed(documents, [5, 2, 1], 1.5, **options).withColumn("part", F.spark_partition_id()).collect()
    shards = {}
    for (shard, _), i in sorted(place.items()):
        shards.setdefault(shard, []).append(i)
    parts = {}
    for r in out:
        parts.setdefault(r["part"], []).append(r["doc_id"])
    for ids in parts.values():  # each partition is whole shards in order
        while ids:
            shard = next(s for s, want in shards.items() if ids[: len(want)] == want)
            ids = ids[len(shards.pop(shard)) :]
    assert not shards


def test_hypergeometric_of_large_numbers(spark):
    """As many values as the root of the draw; near the mean by the deviation."""
    n, k, m = 2_000_000_000, 600_000_000, 1_000_000_000
    frame = spark.createDataFrame([((i + 0.5) / 9,) for i in range(9)], "u double")
    drawn = [r[0] for r in frame.selectExpr(mixing.hypergeometric(f"{n}L", f"{k}L", f"{m}L", "u")).collect()]
    deviation = (m * (k / n) * (1 - k / n) * (n - m) / (n - 1)) ** 0.5
    from statistics import NormalDist

    for i, x in enumerate(drawn):
        assert abs(x - m * k / n - deviation * NormalDist().inv_cdf((i + 0.5) / 9)) < 0.01 * deviation


def test_split_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 4)
    quotas = [(7 * i) % 23 for i in range(18)]
    got = mixing.split(spark.createDataFrame([(quotas,)], "q array<long>"), 6).collect()
    per, room = Counter(), Counter()
    for r in got:
        per[r["i"]] += r["quota"]
        room[r["shard"]] += r["quota"]
        assert r["quota"] >= 0
    assert [per[i] for i in range(18)] == quotas and max(room.values()) - min(room.values()) <= 1


def test_split_is_exact_and_hypergeometric(spark):
    quotas = [40, 25, 0, 7]
    got = mixing.split(spark.createDataFrame([(quotas,)], "q array<long>"), 5).collect()
    by = defaultdict(dict)
    for r in got:
        by[r["shard"]][r["i"]] = r["quota"]
    assert [sum(by[s][i] for s in by) for i in range(4)] == quotas
    sizes = sorted(sum(v.values()) for v in by.values())
    assert sizes[-1] - sizes[0] <= 1
    # the sampler is the inverse of the distribution
    from math import comb

    n, k, m = 30, 12, 11
    us = [(i + 0.5) / 400 for i in range(400)]
    frame = spark.createDataFrame([(u,) for u in us], "u double")
    drawn = [r[0] for r in frame.selectExpr(mixing.hypergeometric(f"{n}L", f"{k}L", f"{m}L", "u")).collect()]
    cdf, total = [], 0.0
    for x in range(0, m + 1):
        total += comb(k, x) * comb(n - k, m - x) / comb(n, m)
        cdf.append(total)
    assert drawn == [next(x for x, c in enumerate(cdf) if c >= u - 1e-12) for u in us]


def test_mixed_rows(documents):
    takes = Counter()
    for r in mixing.takes(documents, [5, 2, 1], 1.5).collect():
        if r["size"]:
            takes[r["doc_id"]] += r["taken"] // r["size"]
    got = mixing.mixed(documents, [5, 2, 1], 1.5)
    assert got.columns == documents.columns
    assert Counter(r["doc_id"] for r in got.collect() if words(r["text"])) == +takes
    other = mixing.mixed(clash(documents).withColumn("times", F.lit(9)), [5, 2, 1], 1.5)
    assert Counter(r["doc_id"] for r in other.collect() if words(r["text"])) == +takes


# token counts and BPE


def test_token_counts_equal_the_library(documents, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(COUNT)
    out = token_counts.token_counts(documents, COUNT, 2048).collect()
    want = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in data)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in out)


def test_token_counts_of_other_special_strings(tmp_path):
    """Special strings without angle brackets, and with white space inside."""
    import json

    from tokenizers import Tokenizer

    with open(COUNT) as f:
        model = json.load(f)
    for i, content in enumerate(("[[x]]", "two words\n here", "¤")):
        model["added_tokens"].append({"id": 60_000 + i, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    for drop in ("two words\n here", None):
        path = str(tmp_path / f"{drop is None}.json")
        kept = [a for a in model["added_tokens"] if a["content"] != drop]
        with open(path, "w") as f:
            json.dump(model | {"added_tokens": kept}, f)
        t, counts = Tokenizer.from_file(path), token_counts.Counts(path)
        for text in ("a[[x]]b [[x]] [[x", "one two words\n here and <|endoftext|>two words", "¤¤ it's¤ 5", "", " \n"):
            assert counts.of(text.encode()) == len(t.encode(text, add_special_tokens=False).ids), text


def library():
    import base64

    import tiktoken

    with open(BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(documents, data):
    enc = library()
    out = byte_bpe.digests(documents, BPE, public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, x, *_ in data:
        ids = enc.encode_ordinary(x or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, out)) == want


def test_bpe_of_long_runs():
    import time

    c, rng = byte_bpe.codec(BPE, public_tokenizers.PATTERN), random.Random(8)
    texts = ["=" * 64_000, "ab" * 9_001, "abc" * 5_000, "-=" * 3000 + "-", "".join(rng.choice("abcde") for _ in range(20_000)), "\n" * 5000, "é" * 4000]
    for text in texts:
        assert c.encode(text) == library_cached().encode_ordinary(text)
    for text in texts:
        for n in (257, 600):
            assert c.merge_long(text.encode()[:n]) == library_cached()._core_bpe.encode_single_piece(text.encode()[:n])
    began = time.time()
    assert c.decode(c.encode("=" * 1_000_000)) == b"=" * 1_000_000
    assert time.time() - began < 20


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=400), st.text("ab ", max_size=600), st.text("the ing", max_size=500), st.text("=-_ \n", max_size=500)))
def test_bpe_tree_on_any_text(text):
    c = byte_bpe.codec(BPE, public_tokenizers.PATTERN)
    assert c.encode(text) == library_cached().encode_ordinary(text)
    assert c.tree(text.encode()) == c.merge(text.encode())
    assert c.decode(c.encode(text)) == text.encode()


_library = []


def library_cached():
    if not _library:
        _library.append(library())
    return _library[0]


# quality rules


def brute_repeats(ws):
    windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    return len({i + k for i, w in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if windows[w] > 1 for k in range(3)})


def test_quality_rules(documents, data):
    out = quality_rules.judge(documents, max_docs=2, min_left=50).collect()
    having = defaultdict(set)
    for row, (_, text, _, host, _) in enumerate(data):
        for line in (text or "").split("\n"):
            if line.encode().split():
                having[host, b" ".join(words(line))].add(row)
    want = Counter()
    for i, text, _, host, _ in data:
        ws, text = words(text, False), text or ""
        lines = [x for x in text.split("\n") if x.encode().split()]
        gone = [len(words(x)) for x in lines if len(having[host, b" ".join(words(x))]) > 2]
        failed = len(ws) < 50 or 100 * brute_repeats(ws) > 50 * len(ws)
        want[i, len(ws), len(b"".join(ws).decode()), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute_repeats(ws), failed, not failed and 100 * (len(ws) - sum(gone)) >= 50 * len(ws), len(gone), sum(gone)] += 1
    assert Counter(map(tuple, out)) == want
    assert any(r["removed_lines"] and not r["kept"] and not r["base_failed"] for r in out)


# n-gram join


def gram_set(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(data, size, percent):
    sets = [gram_set(x, size) for _, x, *_ in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(data):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return Counter((d, len(sets[i]), low[find(i)]) for i, (d, *_) in enumerate(data))


def brute_links(data, size, percent):
    sets = [gram_set(x, size) for _, x, *_ in data]
    links = [0] * len(data)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
    return Counter((d, n) for (d, *_), n in zip(data, links, strict=True))


@pytest.mark.parametrize("size,percent", [(3, 90), (1, 80), (5, 80)])
@pytest.mark.parametrize("block", [4096, 3])
def test_join_components_and_links(documents, data, size, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    out = ngram_join.join(documents, size, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(data, size, percent)
    assert Counter((r["doc_id"], r["links"]) for r in out) == brute_links(data, size, percent)
    keeps = Counter(r["component_id"] for r in out if r["keeps"] and r["n_shingles"])
    assert set(keeps.values()) == {1}


def test_representatives_keep_one_row_of_each_component(spark, documents, data):
    near = next(x for i, x, *_ in data if i == 105)
    extra = [(300, "a text of its own under an id that a near copy has too", "en", "s0", 0), (300, near, "en", "s0", 0), (None, near + " end", "en", "s0", 0)]
    every = [*data, *extra]
    docs = materialize(documents.unionByName(spark.createDataFrame(extra, documents.schema)), "representatives")
    root = {}  # of a row's text: rows of one text are linked
    sets = {text: gram_set(text, 3) for _, text, *_ in every}
    for text, mine in sets.items():
        root[text] = text
        for other in list(root):
            if mine and sets[other] and 10 * len(mine & sets[other]) >= 9 * len(mine | sets[other]) and root[other] != root[text]:
                old, new = root[other], root[text]
                root = {t: new if r == old else r for t, r in root.items()}
    got = [tuple(r) for r in ngram_join.representatives(docs, 3, 90).collect()]
    assert not Counter(got) - Counter(every)
    assert Counter(r for r in got if not sets[r[1]]) == Counter(r for r in every if not sets[r[1]])
    left = Counter(root[r[1]] for r in got if sets[r[1]])
    assert left == dict.fromkeys({root[t] for t in sets if sets[t]}, 1)


def test_join_chains_need_the_tree(spark, monkeypatch):
    """Links that no star finds: neighbours in a chain of slow changes."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(3)
    found, w = [], [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):
        found.append((i, " ".join(w), "en", "s", 0))
        w[rng.randrange(len(w))] = f"x{i}"
    rng.shuffle(found)
    docs = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long")
    got = ngram_join.join(docs, 3, 90).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(found, 3, 90)
    assert Counter((r["doc_id"], r["links"]) for r in got) == brute_links(found, 3, 90)


def random_sets(rng, n, words):
    """Sets of 3-grams in groups of near copies, of many sizes."""
    found = []
    while len(found) < n:
        base = [f"{rng.randrange(words)}" for _ in range(rng.randrange(4, 130))]
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            found.append(" ".join(w[rng.randrange(3) :]).encode())
    return found


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 80), (2, 60)])
def test_linked_sets_share_a_leading_gram(size, percent):
    """Whatever n-grams count as frequent, and the tree's bound keeps them."""
    texts = random_sets(random.Random(size * percent), 500, 5000)
    sets = [ngram_join.grams(t, size) for t in texts]
    every = np.unique(np.concatenate(sets))
    for frequent in (every[:0], every[::3], every):
        signed = [set(ngram_join.leading(s, percent, frequent).tolist()) for s in sets]
        linked = 0
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    linked += 1
                    assert signed[i] & signed[j]
        assert linked > 50


def test_fine_points_tell_long_sets_apart():
    """Points of long sets fold to the trees' points, bound every overlap, and
    keep unrelated sets from being tied."""
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 63, 12_000).astype(np.uint64) * np.uint64(2)) for _ in range(4)]
    near = np.unique(np.concatenate((base[0][600:], base[1][:500])))
    sets = [*base, near, base[2][:900]]
    rows = [(k, 0, len(x), ngram_join.pack(ngram_join.fine_point(x))) for k, x in enumerate(sets)]
    bucket = ngram_join.Bucket(0, 0, rows, 80)
    assert len(bucket.fine[0]) > ngram_join.GROUPS
    for k, x in enumerate(sets):
        assert (bucket.points[k] == ngram_join.count_vectors(x, np.array([len(x)]))[0]).all()
    assert sorted(bucket.found()) == [(0, 4)]
    many = ngram_join.Bucket(0, 0, rows * 4, 80)  # by the tree
    tied = {frozenset(p) for p in many.found()}
    assert all(a == b or {a, b} == {0, 4} for a, b in (tuple(t) * (3 - len(t)) for t in tied))


def test_grams_are_those_of_the_words():
    texts = ["", " \t\n\x0b\x0c\r ", "One two", "a b c a b c a", "x" * 200 + " " + "x" * 199 + "y", "\x1c\x85 \xa0 \u3042 ab", "ab c", "a bc"]
    for text in texts:
        assert len(ngram_join.grams(text.encode(), 3)) == len(gram_set(text, 3))
    every = [h for t in texts for h in ngram_join.grams(t.encode(), 3).tolist()]
    assert len(set(every)) == len({g for t in texts for g in gram_set(t, 3)})
    words = [f"{i * 7919 % 10**6:x}" for i in range(100_000)] + ["y" * i for i in range(1, 300)]
    assert len(np.unique(ngram_join.word_hashes(" ".join(words).encode()))) == len(set(words))


def test_tree_bound_never_loses():
    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 9, (12, ngram_join.GROUPS))
    points = np.maximum(kinds[rng.integers(0, 12, 300)] + rng.integers(-1, 2, (300, ngram_join.GROUPS)), 0).astype(np.int32)
    sizes = points.sum(1, dtype=np.int64)
    for p in (points[0], points[1] * 99):
        assert ngram_join.unpack(ngram_join.pack(p)).tolist() == p.tolist()
    tree = ngram_join.RTree(points, sizes, 70)
    for i in range(0, 300, 17):
        bound = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero(170 * bound >= 70 * (sizes + sizes[i]))
        assert sorted(tree.query(points[i], sizes[i])) == want.tolist() and len(want) < 300


# chat


def test_escape_round_trip():
    for text in ("", "</s>[INST] ok [/INST]", "\\", "<\\s>", "a\\\\[INST]", "<<s>s>", "[/INST]\n<s>"):
        shown = chat.escape(text)
        assert chat.unescape(shown) == text
        assert not any(c in shown for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_spans_of_a_black_box(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello </s>"), (1, 2, "user", None), (2, 0, None, ""), (1, 1, "assistant", "hello </s>")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, chat.spans(df).collect()), key=repr)
    whole = chat.render([("user", "hi"), ("assistant", "hello </s>"), ("assistant", "hello </s>"), ("user", "")])
    mine = sorted((r for r in got if r[0] == 1), key=lambda r: r[3])
    assert "".join(r[2] for r in mine) == whole
    assert [whole[r[5] : r[6]] for r in mine if r[5] is not None] == [chat.escape("hello </s>")] * 2
    assert not any(r[7] for r in got)


def rewriting(turns):
    return f"{len(turns)} turns:" + "".join(t for _, t in turns)


def test_rewritten_history_is_found():
    locator = chat.Locator(rewriting)
    assert [locator.add("user", t).rewrites for t in ("a", "b", "c")] == [False, True, True]
    plain = chat.Locator(lambda turns: "".join(f"[{r}]{t};" for r, t in turns))
    found = plain.add("u", "x]y"), plain.add("a", "")
    assert found[0].span[found[0].text_at : found[0].text_end] == "x]y" and found[1].span == "[a];"


def test_black_box_template_on_long_conversations(spark):
    """A header once, and history that is dropped after 300 turns."""

    def dropping(turns):
        return "HEAD|" + "".join(f"{r}:{t};" for r, t in turns[-300:])

    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(302)]
    out = chat.spans(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1), dropping).orderBy("turn").collect()
    assert [r["turn"] for r in out if r["rewrites"]] == [300, 301]
    assert not any("HEAD" in r["span"] for r in out[1:300])
    for r in out[:300]:
        if r["turn"] % 2:
            assert r["span"][r["loss_start"] - r["start"] : r["loss_stop"] - r["start"]] == f"t{r['turn']}"
        else:
            assert r["loss_start"] is None and r["loss_stop"] is None


def test_long_conversation(spark):
    data = [(9, i, ("user", "assistant")[i % 2], f"turn {i} [INST]") for i in range(700)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    r = chat.digests(df).first()
    said = "".join(t for *_, role, t in data if role == "assistant")
    assert r["n_turns"] == 700 and r["loss_chars"] == len(said)
    assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in data).encode()).hexdigest()
    assert r["formatted_chars"] == len(chat.render([(role, t) for *_, role, t in data]))


CHAT_ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a </s>\\[INST]"), (1, 1, "assistant", "a </s>\\[INST]"), (1, 1, "assistant", "b"), (1, None, None, None), (2, 5, "assistant", None), (2, 4, None, "x"), (2, 4, "user", ""), (None, 0, "assistant", "of no conversation"), (None, None, "user", None), (3, 1, "assistant", "")]


def brute_chat(rows):
    def escaped(text):
        for a in ("\\", "<s>", "</s>", "[INST]", "[/INST]"):
            text = text.replace(a, a[0] + "\\" + a[1:])
        return text

    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in found.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        shown = sum(len("<s>[INST][/INST]</s>" + escaped(t[2]) + escaped(t[3])) for t in turns)
        out.add((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), shown))
    return out


@pytest.mark.parametrize("more", [(), ("conv", "span", "state", "n_turns", "template")])
def test_chat_digests_of_nulls_ties_and_repeats(spark, more):
    df = spark.createDataFrame(CHAT_ROWS, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.select("*", *(F.lit(7).alias(c) for c in more))
    assert set(map(tuple, chat.digests(df).collect())) == brute_chat(CHAT_ROWS)


def test_numbering_template_of_many_turns():
    """Whole prefixes: every span is what the template adds, or rewrites."""
    numbered = lambda turns: "".join(f"[{i}|{r}]{t};" for i, (r, t) in enumerate(turns))
    locator, turns = chat.Locator(numbered), [("user", f"t{i}") for i in range(700)]
    found = [locator.add(*t) for t in turns]
    assert "".join(x.span for x in found) == numbered(turns) and not any(x.rewrites for x in found)


# WARC


def pages_of(spark):
    data = [(5, "http://WWW.Example.com/b?z=1&a=2#x", "<p>one</p>"), (3, "http://example.com/a", "<p>one</p>"), (4, None, None), (6, "http://x.org\r\nX: 1", ""), (7, "http://x.org/ ", "a\r\n\r\nWARC/1.1\r\n"), (8, "http://x.org/", "é"), (None, "http://x.org/n", "é"), (8, "http://x.org/", "é")]
    return data, spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    import base64

    data, df = pages_of(spark)
    got = Counter((r["page"], r["bytes"], r["digest"], r["type"], r["refers"]) for r in warc.round_trip(df, least_bytes=least).collect())
    want, seen = Counter(), defaultdict(list)
    for page, _, html in data:
        seen[html or ""].append(page)
    for page, _, html in data:
        payload = (html or "").encode()
        first = min((p for p in seen[html or ""] if p is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        response = page == first and not seen.get((html, "done")) or len(payload) < least
        if page == first:
            seen[html, "done"] = [1]
        want[page, len(payload), digest, "response" if response else "revisit", None if response else first] += 1
    assert got == want


def test_warc_index_is_in_global_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 40)
    monkeypatch.setattr(warc, "BLOCK", 8)
    data = [(i, f"http://h{i * 7 % 13}.com/p{i * 5 % 17}", f"page {i % 90}") for i in range(200)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(6)
    rows = warc.round_trip(df).collect()
    keys = [(r["key"].encode(), r["ts"], r["page"]) for r in rows]
    assert len(keys) == 200 and keys == sorted(keys)


def test_warc_of_clashing_columns(spark):
    _, df = pages_of(spark)
    other = df.select("*", *(F.lit(7).alias(c) for c in ("id", "at", "sha", "row", "first", "first_id", "archive", "value", "run", "key", "n")))
    a, b = (Counter((r["key"], r["ts"], r["page"], r["type"], r["digest"], r["refers"]) for r in warc.round_trip(d).collect()) for d in (df, other))
    assert a == b


def test_archives_can_be_sought(spark, tmp_path):
    """An offset opens its record alone, also after a page of 17 MB."""
    import glob
    import gzip
    import zlib

    rng = random.Random(4)
    pages = [(i, f"http://h/{i}", "".join(rng.choice("abcdefghijklmnop") for _ in range(n))) for i, n in enumerate([10, 400_000, 20, 300_000, 0, 900_000, 30, 17 << 20])]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "warc")
    warc.write(docs, path)
    rows = {r["page"]: r for r in warc.index(spark, path).collect()}
    assert sorted(rows) == list(range(8))
    files = {"/".join(f.split("/")[-2:]): f for f in glob.glob(f"{path}/*/*.txt")}
    for i, _, html in pages:
        with open(files[rows[i]["run"]], "rb") as f:
            f.seek(rows[i]["offset"])
            record = zlib.decompressobj(31).decompress(f.read())
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(html.encode() + b"\r\n\r\n")
    for f in files.values():
        with open(f, "rb") as stream:
            assert gzip.decompress(stream.read()).count(b"WARC/1.1\r\n") >= 1


def test_members_end_with_a_zero_byte():
    for n in (0, 1, 70_000, (1 << 24) - 1, 1 << 24, (1 << 24) + 5):
        data = bytes(n)
        joined = warc.member(data) + b"\0" + warc.member(b"next") + b"\0"
        assert [c for _, c in warc.members(joined)] == [c for c in (data, b"next") if c]


def test_archives_close_before_their_bound():
    import types

    batch = pa_batch([(i, i, f"u{i}", str(i) * 50_000, i, None, None) for i in range(40)])
    old = warc.TaskContext, warc.ARCHIVE_BYTES
    warc.TaskContext, warc.ARCHIVE_BYTES = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)), 2000
    try:
        out = [r for b in warc.build(iter([batch])) for r in zip(b["archive"].to_pylist(), b["value"].to_pylist(), strict=True)]
    finally:
        warc.TaskContext, warc.ARCHIVE_BYTES = old
    sizes = Counter()
    for name, value in out:
        sizes[name] += len(value) + 1
    assert len(sizes) > 3 and max(sizes.values()) <= 2001 and all(n.startswith("000003-") for n in sizes)


def pa_batch(rows):
    import pyarrow as pa

    names = ("id", "row", "url", "html", "at", "first_id", "first_row")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8):
        runs = [sorted((f"k{rng.randrange(9)}", str(rng.randrange(5)), rng.randrange(99), "", 0, "", None, f"r{i}", j) for j in range(rng.randrange(6))) for i in range(k)]
        got = list(warc.LoserTree(runs))
        assert got == sorted((e for r in runs for e in r), key=warc.order)


# quality classifier


def test_network_learns_and_covers_the_text():
    rng = random.Random(2)
    good = [" ".join(rng.choice("river stone light harbour".split()) for _ in range(60)) for _ in range(60)]
    bad = [t.replace(" ", "$$$ ") for t in good]
    texts = [t.encode() for t in good + bad]
    y = np.array([1.0] * 60 + [0.0] * 60, np.float32)
    net = byte_conv.Network().fit(texts, y, rounds=150)
    assert (((net.logits(texts)) > 0) == (y > 0)).mean() > 0.95
    one = net.logits([b"a" * 100])
    # texts don't influence each other, and each half chunk counts
    mixed = net.logits([b"", b"a" * 100, good[0].encode() * 400, bad[0].encode()])
    assert mixed[1] == pytest.approx(one[0], abs=1e-4) and np.isfinite(mixed).all()
    long = good[0].encode() * 3
    for at in range(0, 2900, 700):
        changed = long[:at] + b"$" * 300 + long[at + 300 :]
        assert abs(net.logits([long])[0] - net.logits([changed])[0]) > 1e-4 or at + 300 > len(long)


def test_network_learns_from_the_middle_of_long_texts():
    """The label shows only between bytes 2,750 and 3,250 of 6,000."""
    rng = random.Random(3)
    plain = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [(plain(2750) + ("#%$&" * 125 if i % 2 else plain(500)) + plain(2750)).encode() for i in range(90)]
    labels = np.array([i % 2 for i in range(90)], np.float32)
    net = byte_conv.Network().fit(texts[:80], labels[:80], batch=16)
    assert ((net.logits(texts[80:]) > 0) == labels[80:]).all()


def plain_logit(net, text):
    """The network with loops: filters, chunks, hidden layer, mean."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = byte_conv.pad(text)
    step, half = byte_conv.STEP, byte_conv.HALF
    out = []
    for at in range(0, len(t) - step, step):
        window = np.concatenate([p["e"][b] for b in t[at : at + 2 * step]])
        out.append([float(window @ p["f"][:, k]) for k in range(byte_conv.FILTERS)])
    starts = list(range(0, len(out), half))
    chunks = [out[s : s + 2 * half] for s in (starts[:-1] or starts)]
    hidden = []
    for c in chunks:
        pooled = [max(0.0, max(row[k] for row in c) + p["fb"][k]) for k in range(byte_conv.FILTERS)]
        hidden.append(np.tanh(np.array(pooled) @ p["h"] + p["hb"]))
    return float(np.mean(hidden, axis=0) @ p["o"] + p["ob"][0])


def test_network_equals_plain_loops():
    rng = np.random.default_rng(1)
    net = byte_conv.Network()
    net.p["fb"] += rng.normal(0, 0.2, byte_conv.FILTERS).astype(np.float32)
    lengths = (0, 1, 7, 8, 9, 500, 512, 515, 516, 517, 1024, 1028, 1029, 3001)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in lengths]
    assert net.logits(texts) == pytest.approx([plain_logit(net, t) for t in texts], abs=1e-4)


def test_gradient_equals_differences():
    """One round's step against the loss at weights nearby."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (40, 700, 1500, 2600)]
    y = np.array([0, 1, 1, 0], np.float32)

    def loss(net):
        z = np.array([plain_logit(net, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    before, after = byte_conv.Network(), byte_conv.Network().fit(texts, y, rounds=1, batch=4, rate=1e-3)
    # Adam's first step is the sign of the gradient: it must lead down everywhere.
    for name, at in (("e", (int(texts[1][5]), 3)), ("f", (11, 4)), ("h", (3, 2)), ("o", (5,)), ("ob", (0,)), ("hb", (1,))):
        up, down = byte_conv.Network(), byte_conv.Network()
        up.p[name][at] += 1e-2
        down.p[name][at] -= 1e-2
        slope = loss(up) - loss(down)
        moved = float(after.p[name][at] - before.p[name][at])
        assert abs(slope) < 1e-7 or slope * moved < 0, name
    assert loss(after) < loss(before)


def test_parts_give_what_the_whole_gives(monkeypatch):
    net = byte_conv.Network()
    text = bytes(np.random.default_rng(0).integers(97, 110, 9000, dtype=np.uint8))
    whole = net.logits([text])
    monkeypatch.setattr(byte_conv, "PART", 2048)
    assert net.logits([text]) == pytest.approx(whole, abs=1e-4)


def test_classifier_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = byte_conv.fit(documents, labels, crc_fold("doc_id", 3) != 1)
    out = byte_conv.score(documents, net).collect()
    assert len(out) == documents.count() and {r["score"] for r in out} == {0.5}


def test_classifier_of_an_empty_table(spark, documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    net = byte_conv.fit(no_documents, labels, crc_fold("doc_id", 3) != 1)
    assert byte_conv.score(no_documents, net).collect() == [] and byte_conv.keep(no_documents, net).collect() == []
    assert {r["score"] for r in byte_conv.score(documents, net).collect()} == {0.5}


def test_fitting_sample_is_bounded(spark, documents, monkeypatch):
    """Rows beyond the bounds aren't fitted on, whole rows are."""
    rows = [(i, "plain words here " * 5 if i % 2 else "$$ %% ## " * 9) for i in range(60)] + [(90, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(byte_conv, "FIT_LONGEST", 1000)
    monkeypatch.setattr(byte_conv, "FIT_BYTES", 2000)
    monkeypatch.setattr(byte_conv.Network, "fit", lambda self, texts, y: seen.append(texts) or self)
    byte_conv.fit(docs, labels, F.lit(True))
    known = {t.encode() for _, t in rows}
    assert 10 < len(seen[0]) < 40 and sum(map(len, seen[0])) <= 2000 and set(seen[0]) <= known and max(map(len, seen[0])) <= 1000


# LM scoring


def test_lm_base_and_counts(documents, data):
    import zlib

    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    out = context_mixing.score(documents, crc_fold("doc_id", 7) != 2).collect()
    c = Counter()
    for i, x, *_ in data:
        if train(i):
            c.update([*words(x), b""])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, x, *_ in data:
        t = [*words(x), b""]
        want[i, not train(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(float(np.log10((c[w] + 1) / (n + v + 1))) for w in t), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    sizes = Counter((i, len((x or "").encode()) == 0) for i, x, *_ in data)
    assert Counter((r["doc_id"], r["bits_per_byte"] is None) for r in out) == sizes


def test_lm_score_equals_plain_sums(spark, documents, data):
    """Every text again by loops: spelled tokens and training segments."""
    import zlib

    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in data]
    sent = {}
    scored = context_mixing.score_tokens

    def keep(model):
        sent["model"] = model.value
        return scored(model)

    context_mixing.score_tokens = keep
    try:
        out = context_mixing.score(documents, crc_fold("doc_id", 7) != 2).collect()
    finally:
        context_mixing.score_tokens = scored
    m = context_mixing.Mixer(*sent["model"])
    counts = Counter(t for (_, x, *_), on in zip(data, train, strict=True) if on for t in [*words(x), b""])
    every = sorted({t for _, x, *_ in data for t in [*words(x), b""]}, key=lambda t: t + b" ")
    cost = dict(zip(every, m.log10(every, np.array([counts[t] for t in every], float)), strict=True))

    def parts(x):
        out, now = [], []
        for w in words(x):
            now.append(w)
            if int(ngram_join.word_hashes(w)[0]) % context_mixing.SEGMENT == 0:
                out, now = [*out, tuple(now)], []
        return [*out, tuple(now)] if now else out

    segments = Counter(p for (_, x, *_), on in zip(data, train, strict=True) if on for p in parts(x))
    n = sum(segments.values())
    want = Counter()
    for (i, x, *_), on in zip(data, train, strict=True):
        mine = parts(x)
        own = Counter(mine) if on else Counter()
        history, weights, total, past = {}, [0.5, 0.5], cost[b""], 0
        for p in mine:
            keys = [(k, past & (1 << k) - 1) for k in (1, 3)]
            seen = [history.setdefault(k, [1.0, 0.5] if k[1] & 1 else [0.02, 1.0]) for k in keys]
            x_ = [np.log(a / b) for a, b in seen]
            q = min(max(1 / (1 + np.exp(-np.dot(weights, x_))), 1e-4), 1 - 1e-4)
            listed, spelled = q * max(segments[p] - own[p], 0) / n, np.log10(1 - q) + sum(cost[w] for w in p)
            total += np.logaddexp(np.log(listed) if listed else -np.inf, spelled * np.log(10)) / np.log(10)
            hit = listed > 0 and np.log10(listed) > spelled
            weights = [w + 0.02 * (hit - q) * v for w, v in zip(weights, x_, strict=True)]
            for s in seen:
                s[0 if hit else 1] += 1
            past = past << 1 | hit
        want[i, round(total, 4)] += 1
    assert Counter((r["doc_id"], round(r["score"], 4)) for r in out) == want


def test_lm_does_not_depend_on_partitions(spark, documents):
    a = {(r["doc_id"], r["n_tokens"]): r["score"] for r in context_mixing.score(documents, crc_fold("doc_id", 7) != 2).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        other = materialize(documents.repartition(5), "other")
        b = {(r["doc_id"], r["n_tokens"]): r["score"] for r in context_mixing.score(other, crc_fold("doc_id", 7) != 2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-6)


def test_lm_segments():
    rng = np.random.default_rng(7)
    h = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    one = lambda x: context_mixing.segments_of(x, np.array([len(x)]))
    found, lengths, parts = one(h)
    assert lengths.sum() == 5000 and 10 < lengths.mean() < 25 and parts.tolist() == [len(found)]
    again = one(np.concatenate((h[:7], h[40:])))[0]
    assert len(np.intersect1d(found, again)) > 0.95 * len(found)  # segments find each other after a change
    together = context_mixing.segments_of(h, np.array([0, 3000, 0, 0, 2000, 0]))
    assert together[0].tolist() == [*one(h[:3000])[0], *one(h[3000:])[0]]
    assert together[2].tolist() == [0, len(one(h[:3000])[0]), 0, 0, len(one(h[3000:])[0]), 0]
    assert len(one(h[:0])[0]) == 0


def test_lm_is_a_probability():
    """The bits of a byte's 256 values sum to one, whatever the state."""
    rng = np.random.default_rng(4)
    tables = rng.integers(0, 50, (context_mixing.SLOTS, 2)).astype(np.float32)
    m = context_mixing.Mixer(tables, np.full((context_mixing.N_CTX, context_mixing.GATES), 0.2, np.float32), np.zeros((context_mixing.GATES, context_mixing.APM_BINS, 2)))
    total = 0.0
    for b in range(256):
        if chr(b).isspace() and b < 128:
            continue
        s = context_mixing.Spelling([bytes([b])])
        cost = 0.0
        for bit, one, st_, gate in m.planes(s, [bytes([b])], np.array([0.0]), False):
            x = m.mix(st_, gate)
            p = 1 / (1 + np.exp(-x[0]))
            cost += np.log(p if bit[0] else 1 - p)
        total += np.exp(cost)
    assert 0.5 < total <= 1.001


def test_lm_bits_sum_to_one_in_the_trie():
    """With trained weights, below prefixes that were seen with one bit only."""
    rng = np.random.default_rng(5)
    seen = sorted({bytes(rng.choice(list(b"abcdefgh"), rng.integers(3, 9))) for _ in range(3000)}, key=lambda t: t + b" ")
    counts = rng.integers(1, 9, len(seen)).astype(np.float64)
    tables = np.zeros((context_mixing.SLOTS, 2), np.float32)
    s = context_mixing.Spelling(seen)
    for j in range(8):
        bit, slots = s.plane(j)
        for at, slot in zip(context_mixing.TABLE_AT, slots, strict=False):
            np.add.at(tables, (slot + at, bit), counts[s.token])
    learned = context_mixing.Mixer(tables)
    for _ in range(20):
        learned.learn(seen, counts)
    m = context_mixing.Mixer(tables, learned.weights, learned.apm)
    known = {t[:5]: c for t, c in zip(seen, counts, strict=True) if len(t) >= 5}
    for prefix in sorted({t[:4] for t in known})[:40]:
        tokens = [prefix + bytes([b]) for b in range(256)]
        s = context_mixing.Spelling(tokens)
        p = np.ones(256)
        for bit, _, st_, gate in m.planes(s, tokens, np.array([known.get(t, 0.0) for t in tokens]), False):
            q = m.chance(m.mix(st_, gate), gate)
            p *= np.where(bit == 1, q, 1 - q)[s.start + 4]
        assert abs(p.sum() - 1) < 1e-3


# all of them


EMPTY = {
    "lm": lambda d: context_mixing.score(d, crc_fold("doc_id", 7) != 2),
    "rules": quality_rules.judge,
    "mix": lambda d: mixing.takes(d, [5, 2, 1], 1.5),
    "mixed": lambda d: mixing.mixed(d, [5, 2, 1], 1.5),
    "dedup": exact_dedup.groups,
    "distinct": exact_dedup.distinct,
    "tokens": lambda d: token_counts.token_counts(d, COUNT, 10),
    "bpe": lambda d: byte_bpe.digests(d, BPE, public_tokenizers.PATTERN),
    "conv": lambda d: byte_conv.score(d, byte_conv.Network()),
    "keep": lambda d: byte_conv.keep(d, byte_conv.Network()),
    "join": ngram_join.join,
    "representatives": ngram_join.representatives,
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_table(no_documents, name):
    assert EMPTY[name](no_documents).collect() == []


def test_empty_pages_and_conversations(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("name", ["lm", "rules", "mix", "dedup", "tokens", "bpe", "conv", "join"])
def test_other_columns_change_nothing(documents, name):
    a, b = EMPTY[name](documents), EMPTY[name](clash(documents))
    assert a.columns == b.columns
    if name not in ("lm", "conv"):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    else:  # scores agree but for the last digits
        x, y = (sorted(((repr(r["doc_id"]), round(r["score"], 4)) for r in f.collect())) for f in (a, b))
        assert x == y


def test_oracle_columns(spark, sf_dir):
    import duckdb

    from sqlloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf_dir)
        want = con.execute(sql)
        cols = [d[0] for d in want.description]
        assert sorted(cols) == sorted(got.columns)
        assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(repr, want.fetchall()))
