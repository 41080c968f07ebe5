"""Each stage against a plain version, on what its predecessor kept."""

import hashlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from test_operators import brute_components, library, lower_ascii, words

import corpus_pipeline
from sqlloom.llm import byte_conv, mixing
from sqlloom.llm.common import crc_fold, materialize, table
from sqlloom.llm.queries import SHARE, WEIGHTS


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        kept.append([tuple(r) for r in docs.collect()])
        if name != "byte BPE":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    quality, exact, near, mixed, encoded = kept
    all_rows = [tuple(r) for r in table(spark, sf_dir, "documents").collect()]

    labels = table(spark, sf_dir, "labels")
    net = byte_conv.fit(table(spark, sf_dir, "documents"), labels, crc_fold("doc_id", 3) != 1)
    want = [r for r in all_rows if net.logits([r[1].encode()])[0] >= 0]
    assert len(set(quality) ^ set(want)) <= 1  # a score may lie on the bar
    bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    assert sum(r[0] in bad for r in quality) < 0.3 * len(bad)

    best = {}
    for r in quality:
        key = lower_ascii(r[1])
        best[key] = max(best.get(key, -1), r[0])
    assert sorted(r[0] for r in exact) == sorted(best.values())
    assert set(exact) <= set(quality)

    lows = {(d, low) for d, _, low in brute_components(exact, 5, 80)}
    assert sorted(r[0] for r in near) == sorted(d for d, low in lows if d == low)
    assert set(near) <= set(exact)

    sizes = Counter()
    for r in sorted(near, key=lambda r: (r[3] is None, (r[3] or "").encode())):
        sizes[r[3]] += len(words(r[1]))
    from test_operators import water_fill

    target = water_fill(sizes, WEIGHTS, SHARE, 2)
    taken = Counter()
    for r in mixed:
        taken[r[3]] += len(words(r[1]))
    for s in sizes:
        assert target[s] - max(60, 0.05 * target[s]) <= taken[s] <= target[s] + 1e-6
    assert set(mixed) <= set(near) and max(Counter(mixed).values()) <= 2
    again = mixing.mixed(spark.createDataFrame(near, docs_schema(spark, sf_dir)), WEIGHTS, SHARE)
    assert again.agg(F.count("*")).first()[0] > 0

    enc = library()
    want = Counter()
    for r in mixed:
        ids = enc.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(encoded) == want
    assert public_tokenizers.PATTERN


def docs_schema(spark, sf_dir):
    return table(spark, sf_dir, "documents").schema


def test_stages_of_nulls_repeats_and_other_columns(spark, sf_dir, documents):
    """The fixture through every stage, with and without columns of its own."""
    names = ("id", "hash", "key", "row", "block", "shard", "position", "__dedup_one", "n", "label")
    for docs in (documents, documents.select("*", *(F.lit(7).alias(c) for c in names))):
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, sf_dir), "stage")
            if name != "byte BPE":
                assert out.columns == docs.columns
                docs = out
            assert out.count() and {r["doc_id"] for r in out.select("doc_id").collect()} <= ids


def test_stages_of_an_empty_table(spark, sf_dir, no_documents):
    docs = no_documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
        docs = docs if name == "byte BPE" else materialize(out, "stage")


def test_run_gives_the_stages(spark, sf_dir):
    a = Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert a and a == Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
