"""WARC archives and their index, sorted by external merge.

Pages become WARC 1.1 records.  Of equal payloads one record is the response
and holds the payload; the others revisit it.  A record is a gzip member of its
own, so that an index entry's offset can be sought; an archive is closed before
it exceeds ``ARCHIVE_BYTES``, however long its pages are (one record is never
cut).  Archives are written by Spark's text sink and read back as whole files by
Spark, so any file system that Spark knows will do.  The sink ends each line
with a zero byte: the last one of a member, which is left out of the line.

Reading gives a run of index entries for each archive, sorted by URL key and
timestamp, in blocks.  A sample of entries cuts the order into ranges of about
``RANGE`` entries; blocks are cut at the ranges' ends, and each range merges its
slices of the runs in a loser tree.  Entries are sorted in their run only, all
that follows is merging; the ranges in order are the capture histories in
global order.

Payloads are compared by SHA-1.  Null html is an empty payload; null URLs are
empty.  Repeated rows are captures of their own: the first is the response.
Only digests and ids are shuffled to find responses; pages of equal payload
are combined before they shuffle.  An empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounded, materialize, shared_dir, text_of

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
NAMESPACE = uuid.UUID("6f1d2c1e-5a0b-4b58-9d3a-0b8f0c7a2e11")
ARCHIVE_BYTES = 32 << 20
RANGE = 100_000
BLOCK = 256  #: entries of a block of a run; one of each is sampled
FEED = 1 << 16  #: bytes that are unpacked at once
CRLF = "\r\n"
EMPTY = gzip.compress(b"", mtime=0)


def url_key(url: str) -> str:
    """Host labels from the right, then path and sorted query, lower-cased."""
    try:
        parts = urlsplit(url.lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{query}" if query else "")


def header_value(value: str) -> str:
    """No line ends or other controls in a header."""
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: quote(m[0]), value)


def record_id(page: object, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}/{row}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member that ends with a zero byte, without that byte.

    A member ends with the length, of which the last byte is zero up to 16 MB;
    longer ones are followed by an empty member.
    """
    data = gzip.compress(record, 6, mtime=0)
    return (data if data[-1] == 0 else data + EMPTY)[:-1]


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, contents) of each gzip member that isn't empty."""
    at = 0
    while at < len(data):
        unpack, start, parts = zlib.decompressobj(31), at, []
        while not unpack.eof:
            fed = data[at : at + FEED]
            if not fed:
                raise ValueError(f"the member at {start} isn't closed")
            parts.append(unpack.decompress(fed))
            at += len(fed) - len(unpack.unused_data)
        if contents := b"".join(parts):
            yield start, contents


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("id", "row", "url", "html", "at", "first_id", "first_row")
    part, archive, size_now = TaskContext.get().partitionId(), 0, 0
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        out = []
        for page, row, url, html, at, first_id, first_row in zip(*(batch[n].to_pylist() for n in names), strict=True):
            payload = html.encode()
            revisit = first_row is not None
            when = (EPOCH + timedelta(seconds=at or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
            http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}"
            block = http if revisit else http + html
            head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, row)}", f"WARC-Target-URI: {header_value(url)}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
            if page is not None:
                head.append(f"X-Page-Id: {page}")
            if revisit:
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first_id, first_row)}"]
                if first_id is not None:
                    head.append(f"X-Refers-To-Page: {first_id}")
            size = len(http) + (0 if revisit else len(payload))
            head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
            data = member((CRLF.join(head) + CRLF + CRLF + block + CRLF + CRLF).encode())
            if size_now and size_now + len(data) > ARCHIVE_BYTES:
                archive, size_now = archive + 1, 0
            size_now += len(data) + 1
            out.append((f"{part:06d}-{archive:04d}", data))
        names_, values = zip(*out, strict=True) if out else ((), ())
        yield pa.record_batch([pa.array(names_, pa.string()), pa.array(values, pa.binary())], names=["archive", "value"])


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield at, headers, data[start:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} isn't closed")
        at = stop + 4


ENTRY = [("key", pa.string()), ("ts", pa.string()), ("page", pa.int64()), ("type", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("refers", pa.int64()), ("run", pa.string()), ("offset", pa.int64())]
ENTRY_SQL = "key string, ts string, page long, type string, bytes long, digest string, refers long, run string, offset long"


def index_run(name: str, data: bytes) -> list[tuple]:
    """The sorted index entries of an archive; payloads are checked."""
    entries = []
    for at, contents in members(data):
        ((_, h, block),) = records(contents)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response" and (size != len(payload) or digest_of(payload) != digest):
            raise ValueError(f"payload of the record at {at} in {name} is damaged")
        page, refers = (int(h[k]) if k in h else None for k in ("X-Page-Id", "X-Refers-To-Page"))
        ts = re.sub(r"\D", "", h["WARC-Date"])
        entries.append((url_key(h["WARC-Target-URI"]), ts, page, h["WARC-Type"], size, digest, refers, name, at))
    entries.sort(key=order)
    return entries


def order(entry: tuple) -> tuple:
    return entry[0].encode(), entry[1], entry[2] is not None, entry[2] or 0, entry[7], entry[8]


def packed(entries: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema(ENTRY)) as writer:
        writer.write_batch(pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*entries, strict=True), ENTRY, strict=True)], schema=pa.schema(ENTRY)))
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(block).read_all()
    return list(zip(*(table[n].to_pylist() for n, _ in ENTRY), strict=True))


RUNS_SQL = "run string, seq int, n int, key string, ts string, page long, offset long, block binary"
SLICES_SQL = "range int, run string, seq int, block binary"


def read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each archive's run, each with one entry for the sample."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            run = "/".join(path.as_py().split("/")[-2:])
            entries = index_run(run, content.as_py())
            for seq, at in enumerate(range(0, len(entries), BLOCK)):
                block = entries[at : at + BLOCK]
                e = block[zlib.crc32(f"{run}/{seq}".encode()) % len(block)]
                row = [run, seq, len(block), e[0], e[1], e[2], e[8], packed(block)]
                types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["run", "seq", "n", "key", "ts", "page", "offset", "block"])


def place(key: str, ts: str, page: int | None, run: str, offset: int) -> tuple:
    """Where an entry stands in the global order."""
    return key.encode(), ts, page is not None, page or 0, run, offset


def cut_blocks(cuts: list[tuple]):
    """Blocks cut at the ranges' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, seq, block in zip(batch["run"], batch["seq"], batch["block"], strict=True):
                entries = unpacked(block.as_py())
                ranges = [bisect_right(cuts, order(e)) for e in (entries[0], entries[-1])]
                if ranges[0] == ranges[1]:
                    parts = {ranges[0]: block.as_py()}
                else:
                    by: dict[int, list[tuple]] = {}
                    for e in entries:
                        by.setdefault(bisect_right(cuts, order(e)), []).append(e)
                    parts = {r: packed(p) for r, p in by.items()}
                n = len(parts)
                yield pa.record_batch([pa.array(list(parts), pa.int32()), pa.array([name.as_py()] * n), pa.array([seq.as_py()] * n, pa.int32()), pa.array(list(parts.values()), pa.binary())], names=["range", "run", "seq", "block"])

    return run


class LoserTree:
    """Merges k sorted runs; each step replays one path of matches."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.k = max(1, len(runs))
        self.keys = [order(r[0]) if r else None for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self.play(i)

    def less(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; ended runs go last."""
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            if self.losers[node] < 0:  # the first to come waits for its match
                self.losers[node] = winner
                return
            if self.less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (i := self.losers[0]) >= 0 and self.keys[i] is not None:
            run = self.runs[i]
            yield run[self.at[i]]
            self.at[i] += 1
            self.keys[i] = order(run[self.at[i]]) if self.at[i] < len(run) else None
            self.play(i)


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of a task one after another; slices come by range, run and place."""

    def ranges() -> Iterator[list[list[tuple]]]:
        now, runs = None, {}
        for batch in batches:
            for r, run, block in zip(batch["range"].to_pylist(), batch["run"].to_pylist(), batch["block"], strict=True):
                if r != now:
                    if runs:
                        yield list(runs.values())
                    now, runs = r, {}
                runs.setdefault(run, []).extend(unpacked(block.as_py()))
        if runs:
            yield list(runs.values())

    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), ENTRY, strict=True)], schema=pa.schema(ENTRY))
        held.clear()
        return batch

    for runs in ranges():
        for entry in LoserTree(runs):
            held.append(entry)
            if len(held) == 10_000:
                yield flush()
    if held:
        yield flush()


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, least_bytes: int = 0) -> None:
    """Writes gzipped archives to ``path``.

    ``captured``: seconds since 2024; the page's id unless given.  Payloads
    under ``least_bytes`` are never revisits.
    """
    arrow_bounded(pages.sparkSession)
    plain = pages.select(F.col(page_id).cast("long").alias("id"), text_of(url).alias("url"), text_of(html).alias("html"), (captured if captured is not None else F.col(page_id)).cast("long").alias("at"))
    plain = plain.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # A repeated row has its id in common; among those the row number decides.
    plain = plain.withColumn("row", F.monotonically_increasing_id())
    large = F.octet_length("html") >= least_bytes
    first = plain.filter(large).groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = materialize(first.select("sha", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")), "warc-first")
    both = plain.join(first.withColumnRenamed("sha", "_sha"), (F.col("sha") == F.col("_sha")) & large, "left")
    own = F.col("row") == F.col("first_row")
    both = both.withColumns({"first_id": F.when(~own, F.col("first_id")), "first_row": F.when(~own, F.col("first_row"))})
    out = both.select("id", "row", "url", "html", "at", "first_id", "first_row").mapInArrow(build, "archive string, value binary")
    # The cast leaves the bytes as they are.
    out.select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\0").text(path)


def range_ends(runs: DataFrame) -> list[tuple]:
    """Places that cut the order into ranges of about ``RANGE`` entries.

    The sample is sorted in Spark; only the ends, one for each range, come to
    the driver.
    """
    every = max(1, RANGE // BLOCK)
    sample = runs.select("key", "ts", "page", "run", "offset").orderBy("key", "ts", F.col("page").asc_nulls_first(), "run", "offset")
    marked = materialize(sample.withColumn("m", F.monotonically_increasing_id()), "warc-sample")
    part = F.shiftrightunsigned("m", 33)
    starts, total = {}, 0
    for r in marked.groupBy(part.alias("p")).agg((F.max("m") - F.min("m") + 1).alias("n")).orderBy("p").collect():
        starts[r["p"]], total = total, total + r["n"]
    if total <= every:
        return []
    known = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))
    number = F.element_at(known, part) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    ends = marked.filter(F.pmod(number, F.lit(every)) == every - 1).select("key", "ts", "page", "run", "offset").collect()
    return sorted(place(*r) for r in ends)


def index(spark, path: str) -> DataFrame:
    """The archives' index in the order of key, timestamp and id."""
    arrow_bounded(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).select("path", "content")
    runs = materialize(files.mapInArrow(read_runs, RUNS_SQL), "warc-runs")
    cuts = range_ends(runs)
    slices = runs.select("run", "seq", "block").mapInArrow(cut_blocks(cuts), SLICES_SQL)
    dealt = slices.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", "run", "seq")
    return dealt.mapInArrow(merge_runs, ENTRY_SQL)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes archives to the shared folder and returns their index."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **options)
    return index(spark, path)
