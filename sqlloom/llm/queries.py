"""The registered queries: each applies one operator to its whole table.

``ORACLES`` has the same results as DuckDB SQL where SQL can express them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, byte_conv, chat, context_mixing, exact_dedup, mixing, ngram_join, quality_rules, token_counts, warc
from .common import crc_fold, table

WEIGHTS = [5, 2, 1]
SHARE = 1.5
TOKEN_LIMIT = 2048
BPE_FILE = "byte_bpe_50k.tiktoken"
COUNT_FILE = "word_bpe_49k.json"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return context_mixing.score(docs, crc_fold("doc_id", 7) != F.lit(2))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"), WEIGHTS, SHARE)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_FILE), TOKEN_LIMIT)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(extra))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_fold("doc_id", 3)
    network = byte_conv.fit(docs.select("doc_id", "text"), labels, fold != 1)
    out = byte_conv.score(docs, network)
    return out.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = warc.round_trip(table(spark, sf_dir, "pages"))
    return entries.select(F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_warc": op10_warc,
}

RULES_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
three AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
hits AS (
  SELECT r, i FROM three QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM hits, range(3) AS t(k) GROUP BY r),
l AS (
  SELECT r, source, text, i, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT r, source, text, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line
        FROM (SELECT r, source, text, string_split(text, chr(10)) AS ls FROM d))),
lines AS (
  SELECT r, source, text, i, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM l WHERE len(lw) > 0),
dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
frequent AS (
  SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT r) > {quality_rules.MAX_DOCS}),
gone AS (
  SELECT lines.r, count(*) AS c, sum(n) AS n FROM lines JOIN frequent
  ON lines.source IS NOT DISTINCT FROM frequent.source AND lines.norm = frequent.norm GROUP BY lines.r),
f AS (
  SELECT doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(gone.c, 0) AS removed_lines, coalesce(gone.n, 0) AS removed_words
  FROM w LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= {quality_rules.MIN_LEFT} * n_words AS kept,
  CAST(removed_lines AS BIGINT) AS removed_lines, CAST(removed_words AS BIGINT) AS removed_words
FROM f"""

DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
  row_number() OVER (PARTITION BY sha ORDER BY doc_id DESC) = 1 AS kept, sha AS text_sha256
FROM d WINDOW g AS (PARTITION BY sha)"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(replace(replace(replace(replace(role || text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length('<s>[INST][/INST]</s>') AS shown FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

#: SHA-1 in base 32 isn't in DuckDB; op10 is tested by reading archives back.
ORACLES: dict[str, str] = {
    "op2_quality_rules": RULES_SQL,
    "op4_exact_dedup": DEDUP_SQL,
    "op6_chat_formatting": CHAT_SQL,
}
