"""A corpus from documents: five stages, each on all that the last one kept.

The stages drop what the quality classifier rejects, then exact copies, then
near copies; mix the sources to target weights, which takes some documents
twice; and encode the texts.  SQL can't express a trained classifier or the
mix's draws, so there is no oracle; tests compare each stage with a plain
version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sqlloom.llm import byte_bpe, byte_conv, exact_dedup, mixing, ngram_join
from sqlloom.llm.common import crc_fold, shared_dir, table
from sqlloom.llm.queries import BPE_FILE, SHARE, WEIGHTS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1; it learns as in op8."""
    network = byte_conv.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), crc_fold("doc_id", 3) != 1)
    return byte_conv.keep(docs, network)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it."""
    return mixing.mixed(docs, WEIGHTS, SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte BPE", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
