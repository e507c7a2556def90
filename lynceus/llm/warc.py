"""WARC archives with revisit records, and a two-level capture index over them.

Archives hold one gzip member per record, so a record is a byte range. The index sorts captures by
reversed-host URL key and stores them in compressed blocks; a sparse directory has the first key and the
range of each block. A lookup searches the directory, then the blocks it names, by bisection, and reads the
records by range; many keys at once (`fetch`) do so in the workers, which all have the directory.
Files go to the shared folder under names of their own per task attempt; only what a finished task reports
is ever referred to.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm.shared import cut, new_path

ARCHIVE_BYTES = 256 << 20
#: Captures of an index block (more where there would be more than BLOCKS); bytes that one range read takes at
#: most, and may skip.
BLOCK, BLOCKS, READ_BYTES, GAP_BYTES = 1000, 1 << 17, 8 << 20, 64 << 10
#: Payloads whose revisits are found by a broadcast, at most.
MANY = 4096
#: What Arrow calls the stores that Spark's connectors name otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: com,example,www)/path?query. Scheme, user and fragment don't count."""
    url = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", (url or "").strip()).split("#", 1)[0]
    host, path = re.match(r"([^/?]*)/?(.*)", url, re.S).groups()
    host = host.rpartition("@")[2].lower()
    name, _, port = host.partition(":")
    key = ",".join(reversed(name.split("."))) + (f":{port}" if port and port not in ("80", "443") else "")
    return f"{key})/{path}"


def _header(lines: list[tuple[str, object]]) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))
    return b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in lines)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One response or revisit record, uncompressed. A revisit has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http + payload if refers_to is None else http
    lines: list[tuple[str, object]] = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", url))
    lines.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Refers-To-Date", DATE)]
        if refers_url is not None:
            lines.append(("WARC-Refers-To-Target-URI", refers_url))
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + _header(lines) + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict[str, object]:
    """page_id, url, type, digest, payload, payload_bytes and refers_to of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    at = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(at["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda k: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", at.get(k, ""))) else None
    return {"page_id": number("WARC-Record-ID"), "url": at.get("WARC-Target-URI"), "record_type": at["WARC-Type"], "payload_digest": at["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": payload if at["WARC-Type"] == "response" else None, "payload_bytes": size, "refers_to": number("WARC-Refers-To")}


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _uri(path: str) -> str:
    """A folder that Spark names, as Arrow names it."""
    scheme, found, rest = path.partition("://")
    if found:
        return f"{SCHEMES.get(scheme, scheme)}://{rest}"
    return f"file://{path.removeprefix('file:')}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(_uri(path))


def _store(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write archives; report surt, page_id, archive, offset and length of each record."""
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    out, name, offset = None, "", 0
    for batch in batches:
        rows = []
        for page_id, url, html, digest, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None or offset >= ARCHIVE_BYTES:
                if out is not None:
                    out.close()
                name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            data = _gzip(record(page_id, url, html or b"", base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, refers_url))
            out.write(data)
            rows.append((surt(url), page_id, name, offset, len(data)))
            offset += len(data)
        if rows:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["surt", "page_id", "archive", "offset", "length"])
    if out is not None:
        out.close()


def _index(batches: Iterator[pa.RecordBatch], folder: str, size: int) -> Iterator[pa.RecordBatch]:
    """Write sorted captures in compressed blocks; report first and last key, file, offset, length and captures of each."""
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    out, name, offset, held, done = None, f"index-{uuid.uuid4().hex}.cdx.gz", 0, [], []

    def flush() -> None:
        nonlocal out, offset
        if out is None:
            out = system.open_output_stream(f"{base}/{name}", compression=None)
        data = _gzip("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode())
        out.write(data)
        done.append((held[0][0], held[-1][0], name, offset, len(data), len(held)))
        offset += len(data)
        held.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            if len(held) == size:
                flush()
    if held:
        flush()
    if out is not None:
        out.close()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["first_key", "last_key", "file", "offset", "length", "captures"])


def _block(file, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(file.read_at(length, offset), 31).decode().split("\n")]


def _ranges(rows: list[list]) -> Iterator[tuple[str, list[list]]]:
    """Captures by archive and offset, those near each other together."""
    run: list[list] = []
    for x in sorted(rows, key=lambda x: (x[2], x[3])):
        if run and (x[2] != run[0][2] or x[3] > run[-1][3] + run[-1][4] + GAP_BYTES or x[3] + x[4] - run[0][3] > READ_BYTES):
            yield run[0][2], run
            run = []
        run.append(x)
    if run:
        yield run[0][2], run


class _Files:
    """Open files of a folder, a bounded number of them."""

    def __init__(self, folder: str):
        self.system, self.base = _open(folder)
        self.open: dict[str, pa.NativeFile] = {}

    def __call__(self, name: str) -> pa.NativeFile:
        if name not in self.open:
            if len(self.open) > 64:
                self.open.clear()
            self.open[name] = self.system.open_input_file(f"{self.base}/{name}")
        return self.open[name]


def _records(captures: list[list], at: _Files, payload: bool) -> Iterator[pa.RecordBatch]:
    """The records of some captures, by range reads."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payload]
    for archive, run in _ranges(captures):
        lo = run[0][3]
        data = at(archive).read_at(run[-1][3] + run[-1][4] - lo, lo)
        out = [parse(zlib.decompress(data[x[3] - lo : x[3] - lo + x[4]], 31)) for x in run]
        for i in range(0, len(out), 250):
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out[i : i + 250]], k) for n, k in zip(names, kinds, strict=True)], names)


def _read(batches: Iterator[pa.RecordBatch], folder: str, payload: bool) -> Iterator[pa.RecordBatch]:
    """The records of index blocks."""
    at = _Files(folder)
    for batch in batches:
        for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            yield from _records(_block(at(file), offset, length), at, payload)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])


def _bisect(first: list[str], key: str) -> range:
    """The blocks that can hold a key, from the blocks' sorted first keys."""
    return range(max(0, bisect_left(first, key) - 1), bisect_right(first, key))


def _locate(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(block, key) for each key and block that can hold it."""
    first = [k[0] for k in sent.value]
    for batch in batches:
        rows = [(b, key) for key in batch.column(0).to_pylist() for b in _bisect(first, key)]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.string())], ["block", "key"])


def _fetch(batches: Iterator[pa.RecordBatch], sent, folder: str, payload: bool) -> Iterator[pa.RecordBatch]:
    """The records of keys (block, key), sorted: each block is read once, and searched for its keys by bisection."""
    at, now, captures, keys = _Files(folder), None, [], []
    wanted: list[list] = []
    for batch in batches:
        for block, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now:
                yield from _records(wanted, at, payload)
                now, wanted = block, []
                captures = _block(at(sent.value[block][2]), *sent.value[block][3:])
                keys = [c[0] for c in captures]
            wanted += captures[bisect_left(keys, key) : bisect_right(keys, key)]
    yield from _records(wanted, at, payload)


class Archives:
    """Written archives and their capture index."""

    def __init__(self, folder: str, directory: DataFrame):
        self.folder, self.directory = folder, directory
        self._sorted: list[tuple] | None = None

    @staticmethod
    def _fields(payload: bool) -> str:
        return "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload

    def _blocks(self) -> list[tuple]:
        """The sparse directory (first key, last key, file, offset, length), about BLOCKS rows at most, read once per object.

        In the order of captures: of the blocks that begin with one key, in files of any names, that which has others
        after it is the last.
        """
        if self._sorted is None:
            self._sorted = sorted(tuple(r) for r in self.directory.select("first_key", "last_key", "file", "offset", "length").collect())
        return self._sorted

    def records(self, payload: bool = False) -> DataFrame:
        """Every record, block by block."""
        parts = int(self.directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.directory.repartition(parts, "file", "offset").mapInArrow(partial(_read, folder=self.folder, payload=payload), self._fields(payload))

    def fetch(self, urls: DataFrame, payload: bool = False) -> DataFrame:
        """The records captured under the keys of many URLs (a column url; null is the empty URL), each once.

        Distinct keys find their blocks in the directory, and their captures in the blocks, by bisection; the
        records are read by range. A key of very many captures is looked up block by block, in many tasks.
        """
        spark = self.directory.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sent = spark.sparkContext.broadcast(self._blocks())
        keys = urls.select("url").mapInArrow(_keys, "key string").distinct()
        found = keys.mapInArrow(partial(_locate, sent=sent), "block int, key string")
        found = found.repartition(parts, "block").sortWithinPartitions("block", "key")
        return found.mapInArrow(partial(_fetch, sent=sent, folder=self.folder, payload=payload), self._fields(payload))

    def lookup(self, url: str) -> list[dict[str, object]]:
        """The records captured under a URL's key, from the driver: two bisections and range reads."""
        key, at, out = surt(url), _Files(self.folder), []
        for b in _bisect([k[0] for k in self._blocks()], key):
            _, _, file, offset, length = self._blocks()[b]
            rows = _block(at(file), offset, length)
            keys = [r[0] for r in rows]
            for r in rows[bisect_left(keys, key) : bisect_right(keys, key)]:
                out.append(parse(zlib.decompress(at(r[2]).read_at(r[4], r[3]), 31)))
        return out


def write(pages: DataFrame, least_bytes: int = 0, block: int = BLOCK) -> Archives:
    """Archive a record per row of pages (page_id, url, html), and index the captures.

    Among rows with equal payloads of at least least_bytes, that with the largest page_id is a response and
    the others revisit it; smaller payloads are responses all. Null html is the empty payload; a row without
    a page_id is a response with an empty id; a null url has no target and the key of the empty URL.
    Repeated rows get records of their own. Other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    folder = new_path(spark, "warc")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"))
    part = rows.filter((F.length("html") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    answer = part.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("r"), F.count("*").alias("n")).filter("n > 1")
    # revisits of payloads that very many pages have, at most MANY payloads, are found by a broadcast
    least = max(1000, -(-pages.count() // MANY))
    mine = part.select("page_id", "digest").join(F.broadcast(answer.filter(F.col("n") >= least).select("digest", F.col("r").alias("many"))), "digest", "left")
    few = mine.filter("many is null").drop("many").join(answer.filter(F.col("n") < least).drop("n"), "digest")
    both = few.unionByName(mine.filter("many is not null").withColumnRenamed("many", "r"))
    again = both.filter("page_id <> r.page_id").select("page_id", "digest", F.col("r.page_id").alias("refers_to"), F.col("r.url").alias("refers_url")).distinct()
    rows = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to", "refers_url")
    captures = cut(rows.mapInArrow(partial(_store, folder=folder), "surt string, page_id long, archive string, offset long, length long"), "captures")
    size = max(block, -(-captures.count() // BLOCKS))
    captures = captures.repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    directory = cut(captures.mapInArrow(partial(_index, folder=folder, size=size), "first_key string, last_key string, file string, offset long, length long, captures int"), "directory")
    return Archives(folder, directory)
