"""WARC archives with a two-level capture index.

Writing: pages are range-partitioned and sorted by reversed-host URL key, and each task writes WARC files in that order, one
gzip member per record. Next to each WARC goes its part of the index: lines (key, page, offset, length, digest, ...) in key
order, cut into compressed blocks of at most ``BLOCK_LINES``, or ``BLOCK_BYTES`` of records. A sparse directory holds one row per block: its first key and where the
block lies. Directory and archive together are in key order, so finding a URL is a binary search of the directory, one range
read of a block, a binary search in it, and one range read of the record; reading all is a walk over blocks whose records
follow each other on disk.

Repeats: of records with equal payloads of ``MIN_REVISIT`` bytes or more the one with the largest page_id is the response,
the others are revisits without payload that refer to it.

Files are written under names of their own for each attempt, and the directory, which Spark commits with the job, names only
those of attempts that succeeded; a lost executor's files are never read. Files are opened by pyarrow's file systems, so any
store that pyarrow knows will do. Null pages get an empty payload, null URLs an empty key; repeated rows each get a record, and a null
page_id is never what others refer to. An empty table gives an empty archive; other columns of pages, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import checked_join, materialise, small_arrow_batches

BLOCK_LINES = 1000
BLOCK_BYTES = 8 << 20
MIN_REVISIT = 1000
MAX_FILE = 512 << 20
_DIRECTORY = "first_key string, last_key string, warc string, index string, at long, size long, lines int"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAKS = {c: f"%{c:02X}" for c in (10, 13)}  # what would end a header
_DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """root holds WARC and index files; directory is the table of index blocks."""

    root: str
    directory: str


def url_key(url: Column) -> Column:
    """Reversed host, then the rest: https://www.a.example/x?y becomes example,a,www)/x?y."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"\A[^/?#]*", 0))
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), tail)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').translate(_BREAKS)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + press.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one compressed record."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


class _Writer:
    """One WARC file and its index file; block rows gather in rows."""

    def __init__(self, root: str):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        self.warc, self.index = f"{name}.warc.gz", f"{name}.idx.gz"
        self.out, self.idx = (self.fs.open_output_stream(f"{base}/{name}", compression=None) for name in (self.warc, self.index))
        self.at = self.idx_at = self.begun = 0
        self.lines: list[tuple[str, str]] = []
        self.rows: list[tuple] = []

    def add(self, key: str, raw: bytes) -> None:
        self.out.write(raw)
        self.lines.append((key, f"{self.at} {len(raw)}"))
        self.at += len(raw)
        if len(self.lines) == BLOCK_LINES or self.at - self.begun > BLOCK_BYTES:
            self.cut()

    def cut(self) -> None:
        if self.lines:
            block = gzip.compress("\n".join(f"{_escape(k)} {where}" for k, where in self.lines).encode(), 6, mtime=0)
            self.idx.write(block)
            self.rows.append((self.lines[0][0], self.lines[-1][0], self.warc, self.index, self.idx_at, len(block), len(self.lines)))
            self.idx_at += len(block)
            self.lines, self.begun = [], self.at

    def close(self) -> list[tuple]:
        self.cut()
        self.out.close()
        self.idx.close()
        return self.rows


def _escape(key: str) -> str:
    return key.replace("\\", "\\\\").replace(" ", "\\s").replace("\n", "\\n").replace("\r", "\\r")


def _unescape(key: str) -> str:
    out, i = [], 0
    while i < len(key):
        if key[i] == "\\":
            out.append({"s": " ", "n": "\n", "r": "\r"}.get(key[i + 1], key[i + 1]))
            i += 2
        else:
            out.append(key[i])
            i += 1
    return "".join(out)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.int32()]
    names = [c.split()[0] for c in _DIRECTORY.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)


def write_archive(pages: DataFrame, root: str) -> Archive:
    """Write pages (page_id, url, html) below root, with index and directory."""
    spark = pages.sparkSession
    small_arrow_batches(spark)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    repeated, repeated_path = materialise(
        keyed.filter(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "keeper"), "repeats"
    )
    ready = checked_join(keyed, repeated, repeated_path, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when((F.col("n") >= MIN_REVISIT) & (F.col("keeper") != F.col("page_id")), F.col("keeper")).alias("refers_to"), url_key(F.col("url")).alias("key")
    )
    files = f"{root}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for page_id, url, html, digest, refers_to, key in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "key"))):
                writer = writer or _Writer(files)
                writer.add(key, record(page_id, url, (html or "").encode(), digest, refers_to))
                if writer.at > MAX_FILE:
                    yield _arrow(writer.close())
                    writer = None
        if writer:
            yield _arrow(writer.close())

    ready.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, _DIRECTORY).write.parquet(f"{root}/directory")
    return Archive(files, f"{root}/directory")


def _block(fs: pafs.FileSystem, base: str, index: str, at: int, size: int) -> list[tuple[str, int, int]]:
    with fs.open_input_file(f"{base}/{index}") as f:
        lines = gzip.decompress(f.read_at(size, at)).decode().split("\n")
    out = []
    for line in lines:
        key, offset, length = line.rsplit(" ", 2)
        out.append((_unescape(key), int(offset), int(length)))
    return out


def _covering(ranges: list, key: str) -> list:
    """Of (first_key, last_key, ...) rows in key order those that may hold a key. Ranges meet at their ends only, so both ends are sorted."""
    begin = bisect.bisect_left(ranges, key, key=lambda r: r.last_key)
    return ranges[begin : bisect.bisect_right(ranges, key, key=lambda r: r.first_key)]


def lookup(spark: SparkSession, archive: Archive, key: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one URL key, one at a time: binary searches of the files' key ranges, of these files' part of the directory and of the blocks found.

    One row per WARC file comes to the driver, then one per block of the files that may hold the key, then one block at a time.
    """
    directory = spark.read.schema(_DIRECTORY).parquet(archive.directory)
    files = directory.groupBy("warc").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")).collect()
    fs, base = pafs.FileSystem.from_uri(archive.root)
    for file in _covering(sorted(files, key=lambda r: (r.first_key, r.last_key)), key):
        blocks = sorted(directory.filter(F.col("warc") == file.warc).collect(), key=lambda r: r.at)
        with fs.open_input_file(f"{base}/{file.warc}") as f:
            for b in _covering(blocks, key):
                entries = _block(fs, base, b["index"], b.at, b["size"])
                for _, at, size in entries[bisect.bisect_left(entries, (key,)) : bisect.bisect_right(entries, (key, 1 << 62))]:
                    yield parse(f.read_at(size, at))


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record, found through the index: what it says of its payload, checked against the payload where it has one."""
    root = archive.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for b in batch.to_pylist():
                rows = []
                entries = _block(fs, base, b["index"], b["at"], b["size"])
                with fs.open_input_file(f"{base}/{b['warc']}") as f:
                    begin, end = entries[0][1], entries[-1][1] + entries[-1][2]
                    held = f.read_at(end - begin, begin)  # a block's records follow each other
                for _, at, size in entries:
                    headers, payload = parse(held[at - begin : at - begin + size])
                    digest, n = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"])
                    kind = headers["WARC-Type"]
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n):
                        raise ValueError(f"damaged record at {at} of {b['warc']}")
                    rows.append((_page(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], n, digest, kind, _page(headers.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ)], schema=_READ)

    directory = spark.read.schema(_DIRECTORY).parquet(archive.directory)
    tasks = min(max(directory.count(), 1), 10_000)  # by number, or the small directory would end up in one task
    return directory.repartition(tasks, "warc", "at").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
