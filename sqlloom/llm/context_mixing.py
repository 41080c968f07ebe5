"""LM scoring: logistic mixing of hashed-context bit predictors.

A text is its lower-cased tokens (words, then one end).  The model spells each
token byte by byte, each byte bit by bit, with a closing space; five contexts
predict every bit: the position in the word, the last one, two and three bytes
(counts in hash tables of fixed size) and the whole word so far (exact counts
in a sorted bit trie).  Their predictions meet in the logistic domain, with
weights from a set that a gate picks by how often the long contexts were seen;
an adaptive map refines the mix.  These contexts stop at the word, so equal
tokens cost the same bits and one scoring of each distinct token serves the
whole corpus.

Contexts across words are those of a match model.  Words whose hash says so end
a segment, of ``SEGMENT`` words on average.  Before each segment one bit says
whether it is one of the training segments, which are then as likely as they
are frequent, or is spelled; both ways to the same segment are added up.  Two
predictors of that bit, by the last match and the last three, adapt online
through the text and are mixed in the logistic domain with weights that learn.

Training covers every training token and segment: counts are sums over the
corpus, from which a training text leaves its own out.  The weights of the
spelling are learned online, in passes over streams of the vocabulary, each
token weighing its count, and are averaged over the streams.  Streams follow
from the vocabulary alone, so that scores don't depend on partitions.

Data flow: texts are read once, where they lie, and become blocks of token
numbers and segment hashes; counts are combined before they shuffle; the
vocabulary is dealt by the first three bytes, which keeps whole trie branches
together; its scores, and the segments that come again, return to the blocks.
Only hash tables and weights, whose size is a constant, reach the driver and
are broadcast.

Null texts count as empty (one end token).  Repeated rows are scored each and
all learned from.  An empty table gives an empty result.  Other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounded, give_back, materialize, release, text_of
from .exact_dedup import passing
from .ngram_join import M2, mix, word_hashes

END = b""  #: the end token; spelled as a lone space
#: Slots of the tables for the contexts: position, one, two and three bytes.
TABLE_BITS = (14, 16, 19, 20)
TABLE_AT = tuple(int(x) for x in np.cumsum([0, *(1 << b for b in TABLE_BITS)]))
SLOTS = TABLE_AT[-1]
CHUNK = 1 << 16
N_CTX = len(TABLE_BITS) + 1
TRIE_FROM, TRIE_TO = 3, 24  #: bytes of prefix that the trie covers
GATES = 64
APM_BINS = 33
BATCH = 4096  #: tokens that are spelled at once
BLOCK_BYTES = 16 << 20  #: text of one block of documents
STREAM = 1 << 18  #: distinct tokens of one stream of learning
FAN_IN = 32  #: tables that one task adds up
SEGMENT = 16  #: words, on average
HISTORY = ((1, (0.02, 1.0), (1.0, 0.5)), (3, (0.02, 1.0), (1.0, 0.5)))  #: matches that a predictor sees; its first counts after a miss, after a hit
DELTA = np.float32(0.05)


class Spelling:
    """A batch of tokens, flattened to bytes; each token ends with a space."""

    def __init__(self, tokens: list[bytes]):
        joined = b" ".join(tokens) + b" "
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        self.start = np.cumsum(lengths) - lengths
        self.token = np.repeat(np.arange(len(tokens)), lengths)
        self.pos = np.arange(len(joined)) - self.start[self.token]
        self.b = np.frombuffer(joined, np.uint8).astype(np.uint32)
        last = []
        for k in (1, 2, 3):
            prev = np.zeros(len(joined), np.uint32)
            prev[k:] = self.b[:-k]
            prev[self.pos < k] = 0
            last.append(prev)
        one, two = last[0], last[0] | last[1] << np.uint32(8)
        three = two | last[2] << np.uint32(16)
        mixed = [(ctx + np.uint32(1)) * np.uint32(0x9E3779B1) for ctx in (two, three)]
        self.ctx = [np.minimum(self.pos, 63).astype(np.uint32) << np.uint32(8), one << np.uint32(8), *(h ^ h >> np.uint32(15) for h in mixed)]

    def plane(self, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Bit i of each byte, the highest first, and the slots of its contexts."""
        node = (self.b | np.uint32(256)) >> np.uint32(8 - i)
        out = [self.ctx[0] | node, self.ctx[1] | node]
        for ctx, bits in zip(self.ctx[2:], TABLE_BITS[2:], strict=True):
            h = ctx + node * np.uint32(0x85EBCA6B)
            out.append(((h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits))
        return self.b >> np.uint32(7 - i) & np.uint32(1), [x.astype(np.intp) for x in out]


def trie_mass(tokens: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Mass of the tokens that share their first d bits with each token.

    ``tokens`` are in byte order with their closing space.  Row d of the result
    is for a prefix of ``8 * TRIE_FROM + d`` bits.
    """
    width = TRIE_TO + 1
    grid = np.frombuffer(b"".join((t[:TRIE_TO] + b" ").ljust(width, b"\0") for t in tokens), np.uint8).reshape(len(tokens), width)
    diff = grid[1:] ^ grid[:-1]
    first = np.argmax(diff != 0, axis=1)
    x = diff[np.arange(len(diff)), first] if len(diff) else np.zeros(0, np.uint8)
    shared = np.where(x == 0, 8 * width, 8 * first + 8 - np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64))
    deep = int(8 * (min(TRIE_TO, max(map(len, tokens), default=0)) + 1))
    out = np.zeros((max(1, deep - 8 * TRIE_FROM + 1), len(tokens)), np.float32)
    for d in range(8 * TRIE_FROM, deep + 1):
        at = np.flatnonzero(np.concatenate(([True], shared < d)))
        out[d - 8 * TRIE_FROM] = np.repeat(np.add.reduceat(counts, at), np.diff(np.append(at, len(tokens))))
    return out


class Mixer:
    """Weights and refinement; the tables hold counts of zeros and ones."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray | None = None, apm: np.ndarray | None = None):
        self.tables = tables
        self.weights = np.full((N_CTX, GATES), 0.3, np.float32) if weights is None else weights
        self.apm = np.zeros((GATES, APM_BINS, 2)) if apm is None else apm
        self.step = 0
        if weights is not None:  # for scoring
            self.stretched = np.log((tables[:, 1] + DELTA) / (tables[:, 0] + DELTA))
            self.grade = self.level(tables.sum(1))
            centre = 1 / (1 + np.exp(-np.linspace(-12, 12, APM_BINS)))
            self.refined = ((self.apm[..., 1] + 20 * centre) / (self.apm.sum(-1) + 20)).astype(np.float32).ravel()

    @staticmethod
    def level(n: np.ndarray) -> np.ndarray:
        """0 to 3, by the count of the three-byte context."""
        return np.minimum(((n + np.float32(1)).view(np.int32) >> 23) - 127, 9) // 3

    def planes(self, s: Spelling, tokens: list[bytes], counts: np.ndarray, learning: bool):
        """For each bit of a byte: the bits, the stretched inputs and the gates.

        When learning, a token's own occurrence is left out of the counts.
        """
        mass = trie_mass(tokens, counts)
        flat, width = mass.ravel(), len(tokens)
        depth = 8 * (s.pos - TRIE_FROM)
        at = depth * width + s.token
        inside = (depth >= 0) & (s.pos < TRIE_TO)
        at[~inside] = 0
        off = (~inside).astype(np.float32)
        own = (counts > 0).astype(np.float32)[s.token] if learning else np.float32(0)
        pairs = self.tables.view(np.complex64).ravel() if learning else None
        up = np.maximum(flat.take(at) - own, 0)
        up[~inside] = 0
        for i in range(8):
            bit, slots = s.plane(i)
            one = bit.astype(np.float32)
            st = []
            if learning:
                own1 = own * one
                own0 = own - own1
                for slot, first in zip(slots, TABLE_AT, strict=False):
                    n = pairs[first:].take(slot)
                    n0, n1 = np.maximum(n.real - own0, 0), np.maximum(n.imag - own1, 0)
                    st.append(np.log((n1 + DELTA) / (n0 + DELTA)))
                grade = self.level(n0 + n1)
            else:
                for slot, first in zip(slots, TABLE_AT, strict=False):
                    st.append(self.stretched[first:].take(slot))
                grade = self.grade[first:].take(slot)
            at[inside] += width
            same = np.maximum(flat.take(at) - own, 0)
            same[~inside] = 0
            other = np.maximum(up - same, 0)
            sign = one * 2 - 1
            st.append(np.log((same + DELTA) / (other + DELTA)) * sign)
            seen = np.minimum(((up + np.float32(1)).view(np.int32) >> 23) - 127, 7)
            # Whichever bit comes, the gate is the same: it is known before the bit.
            gate = seen * 8 + (((same == 0) | (other == 0)) & (up > 0)) * 4 + grade
            yield bit, one, st, gate.astype(np.intp)
            up = same

    def mix(self, st: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        x = self.weights[0].take(gate) * st[0]
        for i in range(1, N_CTX):
            x += self.weights[i].take(gate) * st[i]
        return np.clip(x, -11.99, 11.99, out=x)

    @staticmethod
    def bins(x: np.ndarray):
        at = (x + np.float32(12)) * np.float32((APM_BINS - 1) / 24)
        low = at.astype(np.intp)
        return low, at - low.astype(np.float32)

    def learn(self, tokens: list[bytes], counts: np.ndarray) -> None:
        """Online steps, one for each bit of the batch's bytes."""
        s = Spelling(tokens)
        w = counts[s.token].astype(np.float32)
        for bit, one, st, g in self.planes(s, tokens, counts, True):
            x = self.mix(st, g)
            err = w * (one - 1 / (1 + np.exp(-x)))
            total = np.bincount(g, w, GATES)
            self.step += 1
            rate = 0.3 / (1 + self.step / 100) ** 0.5
            for i in range(N_CTX):
                grad = np.bincount(g, err * st[i], GATES)
                power = np.bincount(g, w * st[i] * st[i], GATES)
                self.weights[i] += (rate * grad / (power * 0.15 + total * 0.3 + 1e-9)).astype(np.float32)
            low, frac = self.bins(x)
            key = (g * APM_BINS + low) * 2 + bit
            flat = self.apm.reshape(-1)
            flat += np.bincount(key, w * (1 - frac), flat.size)
            flat += np.bincount(key + 2, w * frac, flat.size + 2)[: flat.size]

    def chance(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability that the bit is one."""
        low, frac = self.bins(x)
        key = gate * APM_BINS + low
        q = self.refined.take(key)
        q += (self.refined.take(key + 1) - q) * frac
        return np.float32(0.5) * (q + 1 / (1 + np.exp(-x)))

    def log10(self, tokens: list[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        s = Spelling(tokens)
        cost = np.zeros(len(s.b))
        for bit, one, st, gate in self.planes(s, tokens, counts, False):
            q = self.chance(self.mix(st, gate), gate)
            cost += np.log10(np.clip(np.where(bit == 1, q, 1 - q), np.float32(1e-6), np.float32(1)))
        return np.add.reduceat(cost, s.start)


ROW = pa.schema([("kind", pa.int8()), ("block", pa.int64()), ("train", pa.bool_()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("segments", pa.binary()), ("lengths", pa.binary()), ("token", pa.binary()), ("number", pa.int32()), ("segment", pa.int64()), ("every", pa.int64()), ("parts", pa.int64())])
ROW_SQL = "kind tinyint, block long, train boolean, n_bytes long, n long, tokens binary, segments binary, lengths binary, token binary, number int, segment long, every long, parts long"
TEXT, TOKEN, SEG = 0, 1, 2


def compact(values: np.ndarray) -> bytes:
    """Small numbers: all first bytes, then all second ones, and so on."""
    return pa.compress(values.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()


def segments_of(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, length) of each segment of texts of so many ``words``, whose words
    lie one after another in ``hashes``; and how many segments each text has."""
    last = hashes % np.uint64(SEGMENT) == 0
    stops = np.cumsum(words)
    last[stops[words > 0] - 1] = True
    ends = np.flatnonzero(last) + 1
    lengths = np.diff(ends, prepend=0)
    first = ends - lengths
    place = (np.arange(len(hashes)) - np.repeat(first, lengths)).astype(np.uint64)
    sums = np.add.reduceat(mix(hashes + place * M2), first) if len(first) else np.zeros(0, np.uint64)
    found = mix(sums + lengths.astype(np.uint64)).view(np.int64)
    return found, lengths.astype(np.int32), np.diff(np.searchsorted(ends, stops, "right"), prepend=0)


class Block:
    """Texts that lie together, as numbers of the block's distinct tokens."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {END: 0}
        self.texts: list[tuple] = []
        self.size = 0

    def add(self, key: object, text: bytes, train: bool) -> None:
        number = self.numbers
        tokens = text.lower().split()
        tokens.append(END)
        self.texts.append((key, len(text), train, np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int32, len(tokens))))
        self.size += len(text)

    def rows(self, block: int, keys: pa.DataType) -> Iterator[pa.RecordBatch]:
        names = list(self.numbers)
        hashes = np.concatenate((np.zeros(1, np.uint64), word_hashes(b" ".join(names[1:]))))
        schema = pa.schema([("id", keys), *ROW])

        def batch(many: int, **columns) -> pa.RecordBatch:
            given = {"block": pa.array([block] * many, pa.int64()), **columns}
            return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(many, f.type) for f in schema], schema=schema)

        keys_, sizes, train, numbers = zip(*self.texts, strict=True)
        train = np.array(train, bool)
        n = np.array(list(map(len, numbers)))
        counts = np.zeros(len(names), np.int64)
        cut = []
        for at in range(0, len(n), 64):
            part = slice(at, at + 64)
            flat = np.concatenate(numbers[part])
            np.add.at(counts, flat[np.repeat(train[part], n[part])], 1)
            cut.append(segments_of(hashes[flat[flat > 0]], n[part] - 1))
        found, lengths, parts = (np.concatenate(x) for x in zip(*cut, strict=True))
        # Segments are numbered as they come, which leaves little to store.
        each, first, place, every = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first)
        numbered = np.empty(len(each), np.int32)
        numbered[order] = np.arange(len(each), dtype=np.int32)
        place, each, every = numbered[place], each[order], every[order]
        trained = np.bincount(place[np.repeat(train, parts)], minlength=len(each))
        stop = np.cumsum(parts)
        for at in range(0, len(n), 256):
            part = range(at, min(at + 256, len(n)))
            cuts = [slice(stop[i] - parts[i], stop[i]) for i in part]
            columns = {
                "id": pa.array([keys_[i] for i in part], keys),
                "train": pa.array(train[at : at + 256]),
                "n_bytes": pa.array([sizes[i] for i in part], pa.int64()),
                "n": pa.array(n[at : at + 256], pa.int64()),
                "parts": pa.array(parts[at : at + 256], pa.int64()),
                "tokens": pa.array([compact(numbers[i]) for i in part], pa.binary()),
                "segments": pa.array([compact(place[c]) for c in cuts], pa.binary()),
                "lengths": pa.array([compact(lengths[c]) for c in cuts], pa.binary()),
            }
            yield batch(len(part), kind=pa.array([TEXT] * len(part), pa.int8()), **columns)
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield batch(len(part), kind=pa.array([TOKEN] * len(part), pa.int8()), token=pa.array(part, pa.binary()), number=pa.array(np.arange(at, at + len(part), dtype=np.int32)), n=pa.array(counts[at : at + len(part)]))
        for at in range(0, len(each), 50_000):
            part = slice(at, at + 50_000)
            many = len(each[part])
            yield batch(many, kind=pa.array([SEG] * many, pa.int8()), number=pa.array(np.arange(at, at + many, dtype=np.int32)), segment=pa.array(each[part]), n=pa.array(trained[part]), every=pa.array(every[part].astype(np.int64)))


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: texts, and the tokens and segments of each block
    with their training occurrences (0 where only others have them)."""
    part, block, made = TaskContext.get().partitionId(), Block(), 0
    keys = None
    for batch in batches:
        keys = batch["id"].type
        for key, text, train in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()), batch["train"].to_pylist(), strict=True):
            block.add(key, text.as_py(), train)
            if block.size >= BLOCK_BYTES:
                yield from block.rows(part << 32 | made, keys)
                block, made = Block(), made + 1
    if block.texts:
        yield from block.rows(part << 32 | made, keys)
    give_back()


def gather_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's share of the hash tables, as chunks."""
    tables = np.zeros(SLOTS * 2)
    for batch in batches:
        all_tokens, counts = batch["token"].to_pylist(), batch["c"].to_numpy()
        for i in range(0, len(all_tokens), BATCH):
            s = Spelling(all_tokens[i : i + BATCH])
            w = counts[i : i + BATCH].astype(np.float64)[s.token]
            for j in range(8):
                bit, slots = s.plane(j)
                for at, slot in zip(TABLE_AT, slots, strict=False):
                    np.add.at(tables, 2 * (slot + at) + bit, w)
    task = TaskContext.get().partitionId()
    for i in range(0, len(tables), CHUNK):
        if (part := tables[i : i + CHUNK]).any():
            yield pa.record_batch([pa.array([task], pa.int32()), pa.array([i // CHUNK], pa.int32()), pa.array([part.astype(np.int64).tobytes()], pa.binary())], names=["task", "chunk", "sums"])


def add_chunks(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_py(), np.int64) for b in rows["sums"])
    return pa.table({"task": rows["task"].slice(0, 1), "chunk": rows["chunk"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def branches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Sorted tokens in batches that cut no branch of the trie."""
    tokens: list[bytes] = []
    counts: list[int] = []
    for batch in batches:
        tokens += batch["token"].to_pylist()
        counts += batch["c"].to_pylist()
        at = 0
        while len(tokens) - at > 2 * BATCH:
            cut = at + BATCH
            while cut < len(tokens) and tokens[cut][:TRIE_FROM] == tokens[cut - 1][:TRIE_FROM]:
                cut += 1
            if cut == len(tokens):
                break
            yield tokens[at:cut], np.array(counts[at:cut], np.float64)
            at = cut
        tokens, counts = tokens[at:], counts[at:]
    if tokens:
        yield tokens, np.array(counts, np.float64)


def by_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The batches of each stream; rows come sorted by stream."""
    now, held = None, []
    for batch in batches:
        streams = batch["stream"].to_numpy()
        at = 0
        for end in [*(np.flatnonzero(np.diff(streams)) + 1), len(streams)]:
            if streams[at] != now:
                if held:
                    yield held
                now, held = streams[at], []
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield held


def learn_weights(tables):
    """What each stream learns, times its mass: one row for each number."""

    def run(batches):
        for stream in by_stream(b for b in batches if b.num_rows):
            m, mass = Mixer(tables.value), 0.0
            for tokens, counts in branches(iter(stream)):
                if counts.any():
                    m.learn(tokens, counts)
                    mass += counts.sum()
            if mass:
                values = np.concatenate(([mass], m.weights.astype(np.float64).ravel() * mass, m.apm.ravel()))
                yield pa.record_batch([pa.array(np.arange(len(values))), pa.array(values)], names=["place", "value"])
        give_back()

    return run


def score_tokens(model):
    def run(batches):
        m = Mixer(*model.value)
        for tokens, counts in branches(batches):
            yield pa.record_batch([pa.array(tokens, pa.binary()), pa.array(counts.astype(np.int64)), pa.array(m.log10(tokens, counts).astype(np.float32))], names=["token", "c", "lp"])
        give_back()

    return run


def stretch(p: float) -> float:
    return log(p / (1 - p))


def matched_log10(spelled: np.ndarray, listed: np.ndarray) -> float:
    """log10 probability of a text's segments.

    ``spelled``, ``listed``: of each segment, token by token and as one of the
    training segments (-inf: it is none).
    """
    counts = [[list(miss if not h & 1 else hit) for h in range(1 << k)] for k, miss, hit in HISTORY]
    weights, past, total = [0.5] * len(HISTORY), 0, 0.0
    for a, b in zip(spelled.tolist(), listed.tolist(), strict=True):
        mine = [c[past & (1 << k) - 1] for c, (k, _, _) in zip(counts, HISTORY, strict=True)]
        inputs = [stretch(n1 / (n0 + n1)) for n1, n0 in mine]
        p = 1 / (1 + exp(-sum(w * x for w, x in zip(weights, inputs, strict=True))))
        p = min(max(p, 1e-4), 1 - 1e-4)
        one, other = log10(p) + b, log10(1 - p) + a
        high = max(one, other)
        total += high + log10(10 ** (one - high) + 10 ** (other - high))
        hit = one > other
        for w, x in enumerate(inputs):
            weights[w] += 0.02 * (hit - p) * x
        for n in mine:
            n[not hit] += 1
        past = past << 1 | hit
    return total


def sum_documents(totals: tuple[int, int, int]):
    n, v, listed = totals

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number, c, lp, is_token = (right[x].to_numpy() for x in ("number", "c", "lp", "is_token"))
        tokens, again = np.flatnonzero(is_token), np.flatnonzero(~is_token)
        count, cost = np.zeros(len(tokens)), np.zeros(len(tokens))
        count[number[tokens]], cost[number[tokens]] = c[tokens], lp[tokens]
        base = np.log10((count + 1.0) / (n + 1.0 * (v + 1)))
        times = np.zeros(1 + max(number[again], default=0))
        times[number[again]] = c[again]
        rows = []
        for i in range(left.num_rows):
            train, size, n_tokens = (left[x][i].as_py() for x in ("train", "n_bytes", "n"))
            at = expand(left["tokens"][i].as_py(), n_tokens)
            score = cost[at[-1]]
            if n_tokens > 1:
                parts = left["parts"][i].as_py()
                lengths, segments = (expand(left[x][i].as_py(), parts) for x in ("lengths", "segments"))
                spelled = np.add.reduceat(cost[at[:-1]], np.cumsum(lengths) - lengths)
                others = np.where(segments < len(times), times[np.minimum(segments, len(times) - 1)], 0)
                if train and others.any():  # its own occurrences don't count
                    _, back, own = np.unique(segments, return_inverse=True, return_counts=True)
                    others = np.maximum(others - own[back], 0)
                with np.errstate(divide="ignore"):
                    score += matched_log10(spelled, np.log10(others / max(listed, 1)))
            rows.append((not train, n_tokens, int((count[at] > 0).sum()), n, float(base[at].sum()), float(score), size))
        cols = list(zip(*rows, strict=True))
        give_back()
        return pa.table([left["id"], *(pa.array(x) for x in cols)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    return run


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of tokens, unigram base and model score.

    ``train``: which rows the model learns from.  ``bits_per_byte`` is the
    model's cost of the text over its UTF-8 bytes, null for an empty text.
    """
    spark = docs.sparkSession
    arrow_bounded(spark)
    plain = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = plain.schema["id"].dataType.simpleString()
    rows = materialize(plain.mapInArrow(read_blocks, f"id {kind}, {ROW_SQL}"), "lm-blocks", "zstd")
    in_block = rows.filter(F.col("kind") == TOKEN)
    vocab = in_block.groupBy("token").agg(F.sum("n").alias("c"))
    branch = F.xxhash64(F.substring("token", 1, TRIE_FROM))
    in_order = F.concat("token", F.lit(b" "))
    vocab = materialize(vocab, "lm-vocab")
    release(spark)
    tokens, types, every = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count("*")).first()

    tasks = max(1, -(-every // (2 * STREAM)))
    chunks = vocab.filter("c > 0").coalesce(tasks).mapInArrow(gather_tables, "task int, chunk int, sums binary")
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        chunks = chunks.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("task", "chunk").applyInArrow(add_chunks, "task int, chunk int, sums binary")
    flat = np.zeros(SLOTS * 2, np.float32)
    for row in chunks.collect():  # SLOTS is a constant
        part = np.frombuffer(row["sums"], np.int64)
        flat[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    tables = flat.reshape(-1, 2)

    sent = spark.sparkContext.broadcast(tables)
    streams = max(1, -(-types // STREAM))
    streamed = vocab.filter("c > 0").withColumn("stream", F.pmod(branch, F.lit(streams)).cast("int"))
    streamed = streamed.repartition("stream").sortWithinPartitions("stream", in_order)
    learned = streamed.mapInArrow(learn_weights(sent), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    sums = np.zeros(1 + N_CTX * GATES + GATES * APM_BINS * 2)
    for row in learned.collect():  # as many as the sums
        sums[row["place"]] = row["value"]
    mixed = (sums[1 : 1 + N_CTX * GATES] / max(sums[0], 1.0)).astype(np.float32).reshape(N_CTX, GATES)
    apm = sums[1 + N_CTX * GATES :].reshape(GATES, APM_BINS, 2)
    model = spark.sparkContext.broadcast((tables, mixed, apm))
    dealt = vocab.repartition(branch).sortWithinPartitions(in_order)
    scored = dealt.mapInArrow(score_tokens(model), "token binary, c long, lp float")
    right = in_block.select("block", "number", "token").join(scored, "token").select("block", "number", "c", "lp", F.lit(True).alias("is_token"))

    # Segments that are there again, and in a training text.
    in_texts = rows.filter(F.col("kind") == SEG).select("block", "number", "segment", "n", "every")
    known = in_texts.groupBy("segment").agg(F.sum("n").alias("c"), F.sum("every").alias("every"))
    listed = in_texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = materialize(known.filter("c > 0 and every > 1").select("segment", "c"), "lm-segments")
    release(spark)
    _, maybe = passing(in_texts.select("block", "number", "segment"), "segment", known.select("segment"))
    right = right.unionAll(maybe.join(known, "segment").select("block", "number", "c", F.lit(0.0).cast("float").alias("lp"), F.lit(False).alias("is_token")))
    texts = rows.filter(F.col("kind") == TEXT).select(F.col("block").alias("mine"), "id", "train", "n_bytes", "n", "parts", "tokens", "segments", "lengths")
    out = texts.groupBy("mine").cogroup(right.groupBy("block")).applyInArrow(
        sum_documents((tokens, types, listed)), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    )
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / (F.log10(F.lit(2.0)) * F.col("n_bytes")))
    return out.select(F.col("id").alias(doc_id), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))
