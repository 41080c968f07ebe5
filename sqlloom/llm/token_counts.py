"""Token counts with a whole-token shortcut.

Before any text is read, every vocabulary string that ends a word is encoded
on its own; those that come back as that one token are proven whole.  A text
is cut at ASCII white space, where the tokenizer always cuts too; each chunk is
normalised and cut into pre-tokens by the tokenizer's own rules, proven
pre-tokens count as one and only the rest goes through the merges.  Special
strings inside a text, whatever they look like, are found before normalisation,
as the library does, and count as one; those that hold white space are looked
for in whole texts, the others in each chunk.  Short chunks that a worker has
met keep their count in a bounded cache, which changes the speed only.

Each text is read whole in one pass without a shuffle.  Null counts as empty;
repeated rows are counted each; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounded, text_of

CACHE = 400_000  #: chunks of ``CACHED`` bytes at most
CACHED = 64
WORD_END = "</w>"


class Counts(dict):
    """Tokens of a white-space chunk, by the chunk's bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.model = t.model
        tokens = t.get_added_tokens_decoder().values()
        if odd := [a.content for a in tokens if a.single_word or a.lstrip or a.rstrip or a.normalized]:
            raise ValueError(f"special strings with conditions aren't supported: {odd}")
        self.added = frozenset(a.content for a in tokens)
        spaced = any(a.encode().split() != [a.encode()] for a in self.added)
        pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.in_text, self.in_chunk = (pattern, None) if spaced else (None, pattern)
        self.whole = self.prove(t.get_vocab(with_added_tokens=False))

    def prove(self, vocabulary: dict[str, int]) -> frozenset[str]:
        """Pre-tokens that the model encodes as exactly one token."""
        found = set()
        for token, number in vocabulary.items():
            if token.endswith(WORD_END) and (word := token[: -len(WORD_END)]):
                got = self.model.tokenize(word)
                if len(got) == 1 and got[0].id == number:
                    found.add(word)
        return frozenset(found)

    def part(self, text: str) -> int:
        n = 0
        for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text)):
            n += 1 if word in self.whole else len(self.model.tokenize(word))
        return n

    def __missing__(self, chunk: bytes) -> int:
        text = chunk.decode()
        if self.in_chunk and self.in_chunk.search(text):
            n = sum(1 if p in self.added else self.part(p) for p in self.in_chunk.split(text) if p)
        else:
            n = self.part(text)
        if len(chunk) <= CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = n
        return n

    def of(self, text: bytes) -> int:
        if self.in_text and len(parts := self.in_text.split(text.decode())) > 1:
            return sum(1 if p in self.added else sum(map(self.__getitem__, p.encode().split())) for p in parts)
        return sum(map(self.__getitem__, text.split()))


_counts: dict[str, Counts] = {}


def count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = Counts(path)
        counts = _counts[path]
        for batch in batches:
            sizes = [(len(t), counts.of(t)) for t in (x.as_py() for x in batch["text"].cast(pa.binary()))]
            yield pa.record_batch([batch["id"], *(pa.array(c, pa.int64()) for c in (zip(*sizes, strict=True) if sizes else ((), ())))], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    ``tokenizer``: place of a tokenizers ``.json`` file with white space dropped
    and word ends marked, readable on every executor.
    """
    arrow_bounded(docs.sparkSession)
    plain = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    out = plain.mapInArrow(count_batches(tokenizer), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
