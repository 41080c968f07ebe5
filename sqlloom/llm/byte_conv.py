"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of eight bytes slide over the whole text
in steps of four; each filter's maximum is taken over chunks that overlap by
half and cover the document; a hidden layer reads each chunk, and the mean
over all chunks gives one probability.

The network is fitted on the driver on a bounded sample of labelled rows, on
all chunks of each text: in the order of the hash of their ids, at most
``MAX_FIT`` rows of at most ``FIT_LONGEST`` bytes and ``FIT_BYTES`` together.
The weights are a few thousand numbers.  Scoring reads every byte of every
text, in one pass without a shuffle.

Null texts count as empty and get a score like any other.  Repeated rows are
scored each; an empty table gives no rows; other columns of the input are
ignored by ``score``.  Without labels of both kinds the score is the share of
label 1, or a half.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bounded, text_of

WIDTH = 8  #: numbers of a byte's embedding
STEP = 4  #: bytes from filter to filter; a filter covers two steps
FILTERS = 32
HIDDEN = 16
HALF = 128  #: filter positions in half a chunk
CHUNK = 2 * HALF * STEP  #: bytes
MAX_FIT = 3000
FIT_LONGEST = 1 << 18
FIT_BYTES = 16 << 20
FIT_PART = 256  #: half chunks that are convolved at once when fitting
ROUNDS = 900
SEED = 7
PART = 1 << 18  #: bytes that are convolved at once


def pad(data: bytes) -> bytes:
    """Whole steps, and two at least."""
    return data.ljust(max(2 * STEP, -(-len(data) // STEP) * STEP), b"\0")


class Network:
    def __init__(self, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(SEED)
        n = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        row = STEP * WIDTH
        self.p = {"e": n(256, WIDTH, scale=0.5), "f": n(2 * row, FILTERS, scale=(2 * row) ** -0.5), "fb": np.zeros(FILTERS, np.float32), "h": n(FILTERS, HIDDEN, scale=FILTERS**-0.5), "hb": np.zeros(HIDDEN, np.float32), "o": n(HIDDEN, scale=HIDDEN**-0.5), "ob": np.zeros(1, np.float32)}

    def convolve(self, rows: np.ndarray) -> np.ndarray:
        """Filters over rows of STEP embedded bytes."""
        half = rows.shape[-1]
        out = rows[..., :-1, :] @ self.p["f"][:half]
        out += rows[..., 1:, :] @ self.p["f"][half:]
        return out

    def head(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(np.maximum(pooled + self.p["fb"], 0) @ self.p["h"] + self.p["hb"])

    def logits(self, texts: Iterable[bytes]) -> np.ndarray:
        """All bytes of the texts; long ones in parts that share their edges."""
        pools: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        counts = []
        reach = HALF * STEP * (PART // (HALF * STEP))
        for t in texts:
            t = pad(t)
            halves = 0
            at = 0
            while True:
                end = at + reach + STEP  # the last filter of a part needs a step more
                part = t[at:end]
                held.append(part)
                size += len(part)
                halves += -(-(len(part) // STEP - 1) // HALF)
                if size >= PART:
                    pools.append(self.pool(held))
                    held, size = [], 0
                if end >= len(t):
                    break
                at += reach
            counts.append(halves)
        if held:
            pools.append(self.pool(held))
        if not counts:
            return np.zeros(0)
        halves = np.concatenate(pools)
        n = np.array(counts)
        first = np.cumsum(n) - n
        # chunk i is halves i and i + 1; a text of one half is one chunk
        chunks = np.maximum(halves, np.concatenate((halves[1:], halves[-1:])))
        last = first + n - 1
        chunks[last] = halves[last]
        weight = np.ones(len(halves))
        weight[last[n > 1]] = 0
        hidden = self.head(chunks) * weight[:, None]
        return np.add.reduceat(hidden, first) / np.maximum(n - 1, 1)[:, None] @ self.p["o"] + self.p["ob"]

    def pool(self, parts: list[bytes]) -> np.ndarray:
        """Maxima of each filter over the half chunks of each part."""
        data = np.frombuffer(b"".join(parts), np.uint8)
        out = self.convolve(self.p["e"][data].reshape(-1, STEP * WIDTH))
        at, keep, start = [], [], 0
        for p in parts:
            rows = len(p) // STEP
            mine = range(start, start + rows - 1, HALF)
            at += mine
            keep += [True] * len(mine)
            at.append(start + rows - 1)  # the filter across two parts
            keep.append(False)
            start += rows
        return np.maximum.reduceat(out, at[:-1])[np.array(keep[:-1])]

    def fit(self, texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS, batch: int = 48, rate: float = 3e-3) -> Network:
        rng = np.random.default_rng(SEED)
        # Half chunks of all texts; a chunk is two neighbours, as in scoring.
        padded = [pad(t) for t in texts]
        size = np.array([len(t) for t in padded])
        data = np.frombuffer(b"".join(padded) + bytes(HALF * STEP + STEP), np.uint8)
        places = size // STEP - 1
        n = -(-places // HALF)
        first = np.cumsum(n) - n
        nth = np.arange(n.sum()) - np.repeat(first, n)
        start = np.repeat(np.cumsum(size) - size, n) + nth * HALF * STEP
        short = np.minimum(np.repeat(places, n) - nth * HALF, HALF)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        row = STEP * WIDTH
        for step in range(1, rounds + 1):
            docs = rng.choice(len(texts), min(batch, len(texts)), replace=False)
            pick = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in docs])
            found = []
            for i in range(0, len(pick), FIT_PART):
                mine = pick[i : i + FIT_PART]
                x = self.p["e"][data[start[mine][:, None] + np.arange((HALF + 1) * STEP)]].reshape(len(mine), HALF + 1, row)
                conv = self.convolve(x)
                conv[np.arange(HALF)[None, :] >= short[mine][:, None]] = -1e9
                at = conv.argmax(1)
                found.append((at, np.take_along_axis(conv, at[:, None, :], 1)[:, 0]))
            at, most = (np.concatenate(a) for a in zip(*found, strict=True))
            chunks = np.maximum(n[docs] - 1, 1)
            left = np.concatenate([np.arange(c) + o for c, o in zip(chunks, np.cumsum(n[docs]) - n[docs], strict=True)])
            right = left + np.repeat(n[docs] > 1, chunks)
            doc = np.repeat(np.arange(len(docs)), chunks)
            share = 1 / chunks.astype(np.float32)[doc]
            won = np.where(most[left] >= most[right], left[:, None], right[:, None])  # chunk, filter: its half
            pooled = np.maximum(most[left], most[right]) + self.p["fb"]
            active = np.maximum(pooled, 0)
            hidden = np.tanh(active @ self.p["h"] + self.p["hb"])
            mean = np.add.reduceat(hidden * share[:, None], np.cumsum(chunks) - chunks)
            prob = 1 / (1 + np.exp(-(mean @ self.p["o"] + self.p["ob"])))
            g = ((prob - labels[docs]) / len(docs)).astype(np.float32)
            grad = {"o": mean.T @ g, "ob": g.sum(keepdims=True)}
            gh = (g[doc] * share)[:, None] * self.p["o"] * (1 - hidden**2)
            grad |= {"h": active.T @ gh, "hb": gh.sum(0)}
            gp = gh @ self.p["h"].T * (pooled > 0)
            grad |= {"f": np.zeros_like(self.p["f"]), "fb": gp.sum(0)}
            # What each half's maximum gets from its one or two chunks.
            filters = np.arange(FILTERS)
            gm = np.bincount((won * FILTERS + filters).ravel(), gp.ravel(), len(most) * FILTERS).reshape(-1, FILTERS).astype(np.float32)
            ge = np.zeros((WIDTH, 256))
            for i in range(0, len(pick), FIT_PART):
                part = slice(i, i + FIT_PART)
                half, f = np.nonzero(gm[part])
                mine, weight = pick[part][half], gm[part][half, f]
                read = data[(start[mine] + at[part][half, f] * STEP)[:, None] + np.arange(2 * STEP)]
                window = self.p["e"][read].reshape(len(mine), 2 * row) * weight[:, None]
                grad["f"] += np.stack([np.bincount(f, w, FILTERS) for w in window.T]).astype(np.float32)
                gx = (self.p["f"].T[f] * weight[:, None]).reshape(-1, WIDTH)
                ge += np.stack([np.bincount(read.ravel(), w, 256) for w in gx.T])
            grad["e"] = ge.T.astype(np.float32)
            now = rate * min(1, 4 * (1 - step / (rounds + 1)))
            for k, d in grad.items():
                a, b = moment[k]
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                self.p[k] -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        return self


class Constant:
    def __init__(self, share: float):
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.value = np.log(share / (1 - share))

    def logits(self, texts: Iterable[bytes]) -> np.ndarray:
        return np.full(sum(1 for _ in texts), self.value)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text"):
    """A network for ``label`` from the labelled rows where ``learn`` holds."""
    marks = labels.filter(F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).alias("label")).filter(F.col("id").isNotNull())
    plain = docs.filter(learn).select(F.col(doc_id).alias("id"), text_of(text).alias("text"))
    # The sample's ids and lengths first, so that only its texts are joined.
    lengths = docs.filter(learn).select(F.col(doc_id).alias("id"), F.octet_length(text_of(text)).alias("bytes"))
    wanted = lengths.join(marks, "id").filter(F.col("bytes") <= FIT_LONGEST).distinct()
    wanted = wanted.orderBy(F.xxhash64("id"), "id", "label", "bytes").limit(MAX_FIT)
    before = Window.orderBy(F.xxhash64("id"), "id", "label", "bytes").rowsBetween(Window.unboundedPreceding, 0)
    wanted = wanted.withColumn("total", F.sum("bytes").over(before)).filter(F.col("total") <= FIT_BYTES).select("id", "label", "bytes")
    rows = plain.join(F.broadcast(wanted), (plain["id"] == wanted["id"]) & (F.octet_length("text") == F.col("bytes")))
    rows = rows.select(plain["id"], "text", "label").distinct().orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("text")).limit(MAX_FIT).collect()
    y = np.array([r["label"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    return Network().fit([r["text"].encode() for r in rows], y)


def score(docs: DataFrame, network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): the probability of label 1, one row per row of ``docs``."""
    arrow_bounded(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.value.logits(t.as_py() for t in batch["text"].cast(pa.binary()))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))
            yield pa.record_batch([batch["id"], pa.array(p)], names=["id", "score"])

    plain = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", doc_id)


def keep(docs: DataFrame, network, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, unchanged."""
    arrow_bounded(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = np.log(least / (1 - least))
        for batch in batches:
            texts = (t.as_py() or b"" for t in batch[text].cast(pa.binary()))
            yield batch.filter(pa.array(model.value.logits(texts) >= bar))

    return docs.mapInArrow(run, docs.schema)
