"""WARC archives with a two-level capture index.

Writing: every page is a gzip member in an archive file of its task; of pages with equal payloads the one with the smallest
id is a response, the others are revisit records that name it. Indexing: captures are sorted by reversed-host URL key,
cut into blocks of ``LINES`` lines that are compressed each by itself, and a sparse directory keeps the first and last key and
the place of each block. Reading: a binary search in the directory gives the block, one in the block the line, and two range reads
the block and the record. Only files that the index names count, so a repeated task leaves nothing wrong behind.

Null html is an empty payload; a null url has the empty key and no target; a page with a null id is a response of
its own. Rows that share the smallest id of a payload are all responses. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.chunks import small_batches
from strandloom.llm.text import flat
from strandloom.operators.shared import materialise, new_path, partitions

LINES, LEVEL = 500, 4
CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def filesystem(uri: str):
    """A file system for the folder's scheme, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def surt(url: str | None) -> str:
    """Reversed host, port unless usual, path and query: http://a.example.com/x?y -> com,example,a)/x?y."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    usual = {"http": 80, "https": 443}.get(parts.scheme)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port != usual else "") + ")" + tail


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gzip.compress(head.encode() + block + b"\r\n\r\n") + gzip.flush()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, first: int | None) -> bytes:
    """A response, or a revisit of page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if first is None:
        return _member(headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first}>")]
    return _member(headers, http)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; lengths are checked."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to archives in the folder; gives a capture line for each: key, page_id, file, offset, length."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("sha1", F.unhex(F.sha1("payload")))
    same = pages.filter("page_id is not null").filter(F.octet_length("payload") >= least).select("sha1", "page_id").groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    typed = pages.join(same, "sha1", "left").withColumn("first", F.when((F.col("page_id") > F.col("first")), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        name, at, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            data, offsets = flat(batch.column("payload"))
            rows = []
            for k, (page, url, first, sha1) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "first", "sha1")), strict=True)):
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page, url, data[offsets[k] : offsets[k + 1]].tobytes(), base64.b32encode(sha1).decode(), first)
                out.write(member)
                rows.append((surt(url), page, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return typed.select("page_id", "url", "payload", "sha1", "first").mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def build_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Sort captures into compressed blocks in the folder; gives the sparse directory, one row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        name, at, out, held = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx", 0, None, []
        for batch in (*batches, None):
            if batch is not None:
                held += zip(*(x.to_pylist() for x in batch.columns), strict=True)
            rows = []
            while held and (len(held) >= lines or batch is None):
                part, held = held[:lines], held[lines:]
                blob = zlib.compress(json.dumps(part).encode(), 6)
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                out.write(blob)
                rows.append((part[0][0], part[-1][0], name, at, len(blob)))
                at += len(blob)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["first_key", "last_key", "file", "offset", "length"])
        if out is not None:
            out.close()

    order = captures.repartitionByRange(partitions(captures.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return order.mapInArrow(run, "first_key string, last_key string, file string, offset long, length long")


class _Files:
    """Open files of a folder, few at a time."""

    def __init__(self, folder: str):
        self.system, self.path = filesystem(folder)
        self.open: dict[str, object] = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.system.open_input_file(f"{self.path}/{name}")
        file = self.open[name]
        file.seek(offset)
        return file.read(length)


def _page(headers: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
    number = lambda x: None if (n := re.fullmatch(r"<urn:page:(.*)>", x)[1]) == "None" else int(n)
    sha1 = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    first = headers.get("WARC-Refers-To")
    if first is None and (digest(payload) != sha1 or len(payload) != int(http["Content-Length"])):
        raise ValueError("payload differs from its digest")
    return number(headers["WARC-Record-ID"]), int(http["Content-Length"]), sha1, headers["WARC-Type"], None if first is None else number(first), headers.get("WARC-Target-URI"), payload if first is None else None


def page_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct URL keys of pages, as column key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(x) for x in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return pages.select(F.col(url_col).cast("string")).distinct().mapInArrow(run, "key string").distinct()


def _located(directory: DataFrame, keys: DataFrame, slice_blocks: int) -> DataFrame:
    """(file, offset, length, key): the blocks in which each key may be, by binary search in the sparse directory, which goes to the
    workers in slices of about ``slice_blocks`` blocks."""
    spark, out = directory.sparkSession, None
    slices = 1 + directory.count() // slice_blocks
    for part in range(slices):
        own = directory.filter(F.pmod(F.xxhash64("file", "offset"), F.lit(slices)) == part) if slices > 1 else directory
        shared = spark.sparkContext.broadcast(sorted((r["first_key"], r["last_key"], r["file"], r["offset"], r["length"]) for r in own.collect()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks = shared.value
            ends = [x[1] for x in blocks]  # blocks follow one another: their last keys are in order too
            for batch in batches:
                rows = []
                for key in batch.column(0).to_pylist():
                    at = bisect.bisect_left(ends, key)
                    while at < len(blocks) and blocks[at][0] <= key:
                        rows.append((*blocks[at][2:], key))
                        at += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "offset", "length", "key"])

        found = keys.select(F.col("key").cast("string")).dropna().distinct().mapInArrow(run, "file string, offset long, length long, key string")
        out = found if out is None else out.unionByName(found)
    return out


def read_captures(directory: DataFrame, index_folder: str, archive_folder: str, keys: DataFrame | Iterable[str] | None = None, payloads: bool = True, slice_blocks: int = 100_000) -> DataFrame:
    """The captures of the given keys (a table with column key, or some strings; all: None) as pages: blocks by binary search in the
    directory, lines by binary search in the block, records by range reads. A key that is not there gives no rows."""
    spark = directory.sparkSession
    if keys is None:
        asked = directory.select("file", "offset", "length", F.lit(None).cast("string").alias("key"))
    else:
        if not isinstance(keys, DataFrame):
            keys = spark.createDataFrame([(x,) for x in keys], "key string")
        asked = _located(directory, keys, slice_blocks)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, archives, block, lines, starts = _Files(index_folder), _Files(archive_folder), None, [], []
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            nonlocal held, size
            columns = list(zip(*held, strict=True))
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for *place, key in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "key")), strict=True):
                if place != block:
                    block, lines = place, json.loads(zlib.decompress(index.read(*place)))
                    starts = [x[0] for x in lines]
                own = lines if key is None else lines[bisect.bisect_left(starts, key) : bisect.bisect_right(starts, key)]
                for line in sorted(own, key=lambda x: (x[2], x[3])):
                    page = _page(*parse(archives.read(*line[2:])))
                    held.append(page if payloads else (*page[:6], None))
                    size += len(held[-1][6] or b"") + 200
                    if size > 4 << 20:
                        yield emit()
            if held:
                yield emit()

    return asked.repartition(partitions(spark), "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(run, CAPTURES)


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> tuple[DataFrame, str, str]:
    """Archives and index of all pages: the directory, the index folder and the archive folder."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    captures, _ = materialise(write_archives(pages, f"{folder}/archives", least), "captures")
    directory, _ = materialise(build_index(captures, f"{folder}/index"), "directory")
    return directory, f"{folder}/index", f"{folder}/archives"
