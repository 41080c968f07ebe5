"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut into pieces by the tokenizer's pattern.  A piece is a vocabulary
entry, or short enough to merge directly, or it is halved: the halves are
encoded on their own and joined.  A join re-encodes a window of tokens around
the boundary and grows it until the tokens outside provably stand: a sequence
is the encoding of its bytes exactly if every two neighbours are the encoding
of theirs, so it is enough that the pairs at both edges of the window encode
to themselves.  Decoding concatenates the tokens' bytes up a tree of halves.

Halves end at a power of two, where the tokens of repeated characters end too,
so that joins of long runs settle at once; windows of more than ``LIST`` bytes
merge through a heap, in time with their length but for a logarithm.

A worker keeps the encodings of short pieces that it has met in a bounded cache,
which changes the speed only.  Texts are read whole, in one pass without a
shuffle.  Null counts as empty; an empty text has no ids; repeated rows are
encoded each; an empty table gives no rows; other columns of the input are
ignored by ``encode`` and kept by ``with_ids``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounded, text_of

CACHE = 300_000  #: pieces of ``CACHED`` characters at most
CACHED = 32
LEAF = 48  #: bytes that are merged directly
LIST = 256  #: bytes whose pairs are searched in a list
DECODE_LEAF = 4096


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {n: t for t, n in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Repeatedly joins the leftmost neighbours of the lowest rank."""
        if len(data) > LIST:
            return self.merge_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        far = len(ranks) + 1
        cost = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:], strict=False)]
        while cost:
            least = min(cost)
            if least == far:
                break
            i = cost.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del cost[i]
            if i < len(cost):
                cost[i] = ranks.get(parts[i] + parts[i + 1], far)
            if i:
                cost[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
        return [ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """As ``merge``; part i begins at byte i, and neighbours are linked."""
        ranks, n = self.ranks, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = after[i]
            if not alive[i] or middle >= n or after[middle] != stop:
                continue  # one of the two has been joined since
            alive[middle] = 0
            after[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : after[stop]])) is not None:
                    heapq.heappush(heap, (r, i, after[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(data[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        return [ranks[data[i : after[i]]] for i in range(n) if alive[i]]

    def stands(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = 1
        while True:
            window = b"".join(map(self.bytes_of.__getitem__, left[-width:] + right[:width]))
            middle = self.merge(window)
            before, after = left[:-width], right[width:]
            if (not before or self.stands(before[-1], middle[0])) and (not after or self.stands(middle[-1], after[0])):
                return before + middle + after
            width *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = 1 << (len(data) - 1).bit_length() - 1
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, text: str) -> list[int]:
        data = text.encode()
        whole = self.ranks.get(data)
        ids = self.tree(data) if whole is None else [whole]
        if len(text) <= CACHED:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.pieces.get
        for p in self.find(text):
            out += known(p) or self.piece(p)
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def with_ids(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids, an array of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in batches:
            found = pa.array([c.encode(t.as_py() or "") for t in batch[text]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, ids])

    arrow_bounded(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema.add(ids, "array<int>"))


def digests(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each row: id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        shown = {n: str(n) for n in c.bytes_of}
        for batch in batches:
            rows = []
            for t in batch["text"]:
                ids = c.encode(t.as_py())
                said = " ".join(map(shown.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch["id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    arrow_bounded(docs.sparkSession)
    plain = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    out = plain.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", doc_id)
