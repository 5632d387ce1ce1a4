"""WARC archives: one gzip member per record, read back by byte ranges.

A reading task owns the records that start inside its range. It looks for the gzip magic,
takes a candidate if what it inflates to begins with a WARC header, and then follows members
from one to the next. Bytes inside a record can look like a record themselves (an archive in
an archive); such a chain ends off the rails. So each range reports where its chain starts and
ends, and ranges that do not meet are read again from where the one before them ended. Where a
member is damaged, reading goes on at the next one that is whole, and the bytes between are told.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlparse

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ecolake.llm.common import scratch, written

# --- fixed values -----------------------------------------------------------------------
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
ANY_VERSION = b"WARC/1."
DAMAGED = "damaged"  # record type of bytes that were passed over
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ----------------------------------------------------------------------------------------
DATE = "2020-01-01T00:00:00Z"
READ = 1 << 20
PIECE = 1 << 13

_systems: dict[tuple[str, str], pafs.FileSystem] = {}


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; clients are kept per scheme and host in a process."""
    parts = urlparse(uri)
    key = (parts.scheme, parts.netloc)
    if parts.scheme in ("", "file"):
        return _systems.setdefault(("file", ""), pafs.LocalFileSystem()), parts.path
    if key not in _systems:
        _systems[key] = pafs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")[0]
    return _systems[key], parts.path if parts.scheme == "hdfs" else parts.netloc + parts.path


def record_bytes(page_id, url, kind: str, digest: str, size: int, payload: bytes, refers_to, refers_url) -> bytes:
    """One gzip member: WARC header, HTTP header and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + _plain(url))
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To-Page-ID: {refers_to}")
        if refers_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + _plain(refers_url))
    out = io.BytesIO()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out.write(z.compress(VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"))
    out.write(z.flush())
    return out.getvalue()


def _plain(url: str) -> str:
    return quote(url, safe="!#$&'()*+,/:;=?@[]~%{}|\\^`\"<>")


def with_record_types(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html and the digest, size and record type of each page. Of equal payloads
    of ``least`` bytes or more the smallest page_id is the response; a join on the digests that
    occur more than once decides, after a count that each task begins."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    marked = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    seen = marked.select("page_id", "url", "digest", "size").filter(F.col("size") >= least)
    first = seen.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("f")).filter("n > 1")
    first = written(first.select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url")), "payloads")
    joined = marked.join(first, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "html", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"),
    )


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html), one archive per task; returns
    (path, bytes, records) of the archives.

    A name holds the attempt, and only archives whose task was committed are in the returned
    table, so repeated and lost attempts leave nothing that is read. ``folder`` must be one all
    executors reach through Arrow's file systems. A null html is an empty payload, a null url or
    page_id leaves its header out, repeated rows get a record each, and other columns are not kept.
    """
    folder = folder or scratch(pages.sparkSession, "warc")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        size = records = 0
        stream = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for page_id, url, html, digest, n, kind, refers_to, refers_url in zip(*columns):
                if stream is None:
                    fs, path = open_store(name)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    stream = fs.open_output_stream(path, compression=None)
                record = record_bytes(page_id, url, kind, digest, n, html.encode(), refers_to, refers_url)
                stream.write(record)
                size, records = size + len(record), records + 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "bytes", "records"])

    return written(with_record_types(pages).mapInArrow(write, "path string, bytes long, records long"), "archives")


class _Window:
    """Random reads of a file that keep only the bytes around the place in use."""

    def __init__(self, uri: str) -> None:
        fs, path = open_store(uri)
        self.file, self.at, self.held = fs.open_input_file(path), 0, b""
        self.size = self.file.size()

    def piece(self, offset: int, n: int) -> bytes:
        """Up to ``n`` bytes, fewer only at the end of the file."""
        if not (self.at <= offset and min(offset + n, self.size) <= self.at + len(self.held)):
            self.at, self.held = offset, self.file.read_at(max(0, min(max(READ, n), self.size - offset)), offset)
        return self.held[offset - self.at : offset - self.at + n]

    def find(self, offset: int, end: int) -> int:
        """Place of the first gzip magic in [offset, end), or -1."""
        while offset < end:
            self.piece(offset, len(MAGIC))
            hit = self.held.find(MAGIC, offset - self.at)
            if hit >= 0:
                return self.at + hit if self.at + hit < end else -1
            offset = max(offset + 1, self.at + len(self.held) - len(MAGIC) + 1)
        return -1


def _begins(window: _Window, offset: int) -> bool:
    """Does a gzip member begin here that holds a WARC header?"""
    try:
        return zlib.decompressobj(31).decompress(window.piece(offset, PIECE), len(ANY_VERSION)) == ANY_VERSION
    except zlib.error:
        return False


def _member(window: _Window, offset: int) -> tuple[bytes, int] | None:
    """What the member at ``offset`` holds and where the next begins, or None if it is broken."""
    z, out, at = zlib.decompressobj(31), [], offset
    try:
        while not z.eof:
            data = window.piece(at, PIECE)
            if not data:
                return None
            out.append(z.decompress(data))
            at += len(data) - len(z.unused_data)
    except zlib.error:
        return None
    return b"".join(out), at


def _next_record(window: _Window, at: int) -> int:
    """Where the next whole record begins, or the end of the file."""
    while True:
        at = window.find(at, window.size)
        if at < 0:
            return window.size
        if _begins(window, at) and _member(window, at) is not None:
            return at
        at += 1


def chain(window: _Window, start: int, end: int, trusted: bool = False) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, next offset, content) of the records that start in [start, end). ``trusted``:
    ``start`` is known to be where a record should be; one that is damaged has null content, and the
    next whole one follows. Otherwise candidates are tried in turn, and a chain counts only if it
    reaches the end of the range or of the file."""
    at = start
    while trusted and at < min(end, window.size):
        got = _member(window, at) if _begins(window, at) else None
        content, after = got or (None, _next_record(window, at + 1))
        yield at, after, content
        at = after
    while not trusted and at < min(end, window.size):
        at = window.find(at, end)
        if at < 0:
            return
        if not _begins(window, at):
            at += 1
            continue
        held, here = [], at
        while here < min(end, window.size) and _begins(window, here):
            got = _member(window, here)
            if got is None:
                break
            held.append((here, got[1], b""))
            here = got[1]
        if here >= min(end, window.size):
            yield from held
            return
        at += 1


def ranges(archives: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """(path, start, end): byte ranges of the archives."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long")))
    return archives.select("path", "bytes", starts.alias("start")).select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))


def record_index(archives: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """(path, start, end, first, trusted): each range with the offset of the first record it
    owns, null where none starts inside.

    Ranges are scanned apart. A range whose first record is not where the range before it ended
    has mistaken the inside of a record for one; it and what follows are corrected by a walk
    from the last agreed place, and only archives with such a place are walked.
    """
    n = archives.sparkSession.sparkContext.defaultParallelism * 4
    cut = ranges(archives, split_bytes)

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.itertuples():
                window, first, last = _Window(r.path), None, None
                for offset, after, _ in chain(window, r.start, r.end, trusted=r.start == 0):
                    first, last = offset if first is None else first, after
                rows.append((r.path, r.start, r.end, first, last))
            yield pd.DataFrame(rows, columns=["path", "start", "end", "first", "last"]).astype({"first": "Int64", "last": "Int64"})

    scanned = written(cut.repartition(n).mapInPandas(scan, "path string, start long, end long, first long, last long"), "ranges")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    agreed = F.coalesce(F.max("last").over(before), F.lit(0).cast("long"))
    due = F.when(agreed < F.col("end"), agreed)
    checked = scanned.withColumn("due", due).withColumn("wrong", ~F.col("due").eqNullSafe(F.col("first")))
    bad = written(checked.filter("wrong").select("path").distinct(), "wrong")

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.itertuples():
                window = _Window(r.path)
                firsts: dict[int, int] = {}
                for offset, _, _ in chain(window, 0, window.size, trusted=True):
                    firsts.setdefault(offset // split_bytes, offset)
                rows = [(r.path, s, min(s + split_bytes, window.size), firsts.get(s // split_bytes)) for s in range(0, max(1, window.size), split_bytes)]
                yield pd.DataFrame(rows, columns=["path", "start", "end", "first"]).astype({"first": "Int64"})

    right = checked.join(bad, "path", "left_anti").select("path", "start", "end", "first")
    return right.union(bad.repartition(n).mapInPandas(walk, "path string, start long, end long, first long"))


def read_archives(archives: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of ``archives`` (path, bytes): page_id (as text), url, record_type,
    payload_bytes and payload_digest of the full payload, refers_to (as text), payload, path,
    offset. A response's digest and length are taken from its payload, a revisit's from its
    header; records of other types have neither. Any WARC 1 version is read. Bytes that hold no
    whole record are a row too, of type ``damaged``, with their number as payload_bytes. An empty
    table of archives gives no records."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for frame in batches:
            for path, start, end in zip(*(frame.column(k).to_pylist() for k in range(3))):
                rows, held = [], 0
                for offset, after, content in chain(_Window(path), start, end, trusted=True):
                    found = parse_record(content) if content is not None else (None, None, DAMAGED, after - offset, None, None, None)
                    rows.append((*found, path, offset))
                    held += len(content or b"")
                    if held > 16 << 20:
                        yield _record_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _record_batch(rows)

    starts = record_index(archives, split_bytes).filter("first is not null").select("path", "first", "end")
    return starts.repartition(archives.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(read, RECORD)


RECORD = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, path string, offset long"


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in RECORD.split(", ")])


def parse_record(content: bytes) -> tuple:
    """page_id, url, type, payload length and digest, refers_to, payload of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in re.findall(r"^([\w-]+):[ \t]*(.*?)\r?$", head.decode("utf-8", "replace"), re.M)}
    length, kind = fields.get("content-length", ""), fields.get("warc-type", "").lower()
    block = rest[: int(length)] if length.isdigit() else rest
    size = digest = payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    elif kind == "revisit":
        told = fields.get("warc-payload-length", "")
        size, digest = int(told) if told.isdigit() else None, fields.get("warc-payload-digest", "").partition(":")[2] or None
    return fields.get("warc-page-id"), fields.get("warc-target-uri"), kind or None, size, digest, fields.get("warc-refers-to-page-id"), payload


def archived_pages(spark: SparkSession, pages: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back by ranges: page_id,
    payload_bytes, payload_digest, record_type and refers_to of each record."""
    kind = pages.schema["page_id"].dataType
    return read_archives(write_archives(pages), split_bytes).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
