"""WARC archives with a two-level capture index.

Writing: each page is one gzip member.  Of pages with equal payloads the one
with the smallest id is a ``response``, the others are ``revisit`` records
without payload that refer to it.  Equal payloads meet by digest in a join, in
which Spark splits a digest that very many pages share.

The index holds one line per capture, sorted by the page's URL with its host
reversed, then by page id.  Lines lie in compressed blocks of ``LINES``; the
end of each index file is a sparse directory, the first key and the place of
each block.  A look-up searches the files' first keys (one per partition),
then the directory, then one block, each by bisection, and reads the record's
bytes alone.

Files go to the shared folder under names of their own; only the tables that
Spark commits say which of them count, so a task that runs twice leaves at
most a file that nobody reads.

A null html is an empty payload; a null URL an empty key; a page without an id
counts as the one with the largest id.
"""
from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.llm.runtime import setup, wide
from petrel.llm.token_files import file_system
from petrel.session import scratch_dir

LINES = 1024                 # captures in a block of the index
ROTATE = 1 << 30             # bytes after which a task begins another archive
DATE = "1970-01-01T00:00:00Z"
_PLAIN = "".join(chr(c) for c in range(33, 127) if chr(c) != "%") + "%"


def surt(url: str | None) -> str:
    """The URL's sort key: reversed host, then path and query; no scheme, user or default port."""
    text = (url or "").strip()
    scheme, mark, rest = text.partition("://")
    if not mark:
        return quote(text, safe=_PLAIN)
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end].rpartition("@")[2].lower(), rest[end:]
    name, _, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    if port in ("", "80" if scheme.lower() == "http" else "443"):
        port = ""
    key = ",".join(reversed(name.split("."))) + (":" + port if port else "") + ")" + path
    return quote(key, safe=_PLAIN)


def capture_key(url: str | None, page_id: int | None) -> str:
    """The index key: pages without an id follow the others of their URL."""
    return surt(url) + " " + ("~" if page_id is None else f"{page_id + (1 << 63):020d}")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(name: str | None) -> int | None:
    value = name[len("<urn:page:"):-1] if name else "none"
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None,
           revisit: bool) -> bytes:
    """One record, uncompressed; ``digest`` in base32 and ``size`` are the full payload's."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url, safe=_PLAIN) if url else _name(page_id)[1:-1]}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    def fields(part: bytes) -> dict[str, str]:
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in part.decode().split("\r\n")[1:])}
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[:int(warc["content-length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


CAPTURES = "key string, file string, at long, size long"


def _write(folder: str, min_bytes: int):
    def run(batches):
        out = uri = None
        at = 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ROTATE:
                    if out:
                        out.close()
                    uri, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    fs, path = file_system(uri)
                    out = fs.open_output_stream(path, compression=None)
                revisit = first is not None and first != page_id and len(payload) >= min_bytes
                data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), len(payload),
                              first, revisit)
                pack = zlib.compressobj(5, zlib.DEFLATED, 31)
                data = pack.compress(data) + pack.flush()
                out.write(data)
                rows.append((capture_key(url, page_id), uri, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["key", "file", "at", "size"])
        if out:
            out.close()
    return run


INDEX = "first string, file string"


def _index(folder: str):
    def run(batches):
        out, uri, at, directory, lines = None, f"{folder}/{uuid.uuid4().hex}.cdx", 0, [], []

        def flush():
            nonlocal at, lines
            data = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            out.write(data)
            directory.append((lines[0].partition("\t")[0], at, len(data)))
            at, lines = at + len(data), []

        for batch in batches:
            for key, file, begin, size in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs, path = file_system(uri)
                    out = fs.open_output_stream(path, compression=None)
                lines.append(f"{key}\t{file}\t{begin}\t{size}")
                if len(lines) == LINES:
                    flush()
        if out:
            if lines:
                flush()
            tail = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([uri])], ["first", "file"])
    return run


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as archives and index them.

    Payloads of fewer than ``min_bytes`` bytes are all responses."""
    spark = pages.sparkSession
    setup(spark)
    fs, path = file_system(folder)
    for part in ("warc", "cdx"):
        fs.create_dir(f"{path}/{part}", recursive=True)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    same = (src.select("page_id", "digest").groupBy("digest")
            .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    rows = src.join(same, "digest", "left").select("page_id", "url", "payload", "digest", "first")
    rows.mapInArrow(_write(folder + "/warc", min_bytes), CAPTURES).write.parquet(folder + "/captures")
    captures = spark.read.schema(CAPTURES).parquet(folder + "/captures")
    lines = captures.repartitionByRange(wide(spark), "key").sortWithinPartitions("key")
    lines.mapInArrow(_index(folder + "/cdx"), INDEX).write.parquet(folder + "/index")


class _Files:
    """Range reads over a few open files."""

    def __init__(self, most: int = 32):
        self.open: OrderedDict = OrderedDict()
        self.most = most

    def _file(self, uri: str):
        if uri not in self.open:
            fs, path = file_system(uri)
            self.open[uri] = fs.open_input_file(path)
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(uri)
        return self.open[uri]

    def read(self, uri: str, at: int, size: int) -> bytes:
        return self._file(uri).read_at(size, at)

    def size(self, uri: str) -> int:
        return self._file(uri).size()


class Captures:
    """Look-ups in the index; keeps the last directory and block, so sorted look-ups read each once."""

    def __init__(self, files: list[tuple[str, str]]):
        self.firsts, self.names = [f for f, _ in files], [n for _, n in files]
        self.io = _Files()
        self.directory: tuple = (None, [], [])
        self.block: tuple = (None, [], [])

    def _directory(self, uri: str):
        if self.directory[0] != uri:
            end = self.io.size(uri)
            size = int.from_bytes(self.io.read(uri, end - 8, 8), "little")
            rows = json.loads(gzip.decompress(self.io.read(uri, end - 8 - size, size)))
            self.directory = uri, [r[0] for r in rows], rows
        return self.directory

    def _lines(self, uri: str, at: int, size: int):
        if self.block[0] != (uri, at):
            lines = [x.split("\t") for x in gzip.decompress(self.io.read(uri, at, size)).decode().split("\n")]
            self.block = (uri, at), [x[0] for x in lines], lines
        return self.block

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, begin, size) of each record with this key."""
        i = bisect.bisect_right(self.firsts, key) - 1        # equal keys lie in one file
        if i < 0:
            return
        uri, firsts, rows = self._directory(self.names[i])
        b = max(0, bisect.bisect_left(firsts, key) - 1)
        while b < len(rows) and firsts[b] <= key:
            _, keys, lines = self._lines(uri, rows[b][1], rows[b][2])
            for k in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                yield lines[k][1], int(lines[k][2]), int(lines[k][3])
            b += 1

    def records(self, key: str) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
        for file, at, size in self.find(key):
            yield parse(zlib.decompress(self.io.read(file, at, size), 31))


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([capture_key(u, p) for p, u in zip(*(c.to_pylist() for c in batch.columns))], pa.string())],
            ["key"])


def _look_up(files: list[tuple[str, str]], with_payload: bool):
    names = [x.split(" ")[0] for x in FOUND.split(", ")]

    def run(batches):
        captures = Captures(files)
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for warc, http, payload in captures.records(key):
                    digest, revisit = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"] == "revisit"
                    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"the payload of {warc['warc-record-id']} does not have its digest")
                    rows.append((_page_id(warc["warc-record-id"]),
                                 int(http["content-length"]) if revisit else len(payload), digest, warc["warc-type"],
                                 _page_id(warc.get("warc-refers-to")), payload if with_payload else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
    return run


def look_up(pages: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The archived records of the pages (page_id, url), found through the index and read by range."""
    spark = pages.sparkSession
    setup(spark)
    index = spark.read.schema(INDEX).parquet(folder + "/index")
    files = sorted((r["first"], r["file"]) for r in index.collect())      # one row per partition of the index
    keys = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(_keys, "key string")
    keys = keys.distinct().repartitionByRange(wide(spark), "key").sortWithinPartitions("key")
    return keys.mapInArrow(_look_up(files, with_payload), FOUND)


def archive_folder(spark: SparkSession) -> str:
    return scratch_dir(spark, "archive")
