"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some records, and a last skippable frame: the seek table with
the sizes of all frames. The index maps a record's identifier to its bundle, frame and offset within the frame, so one
record costs one frame. Tasks write bundles of a bounded size into a folder that all executors share, under names of their
own attempt; only the index names bundles, so what lost or repeated attempts leave behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh, keep, small_batches

# Fixed values of the formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 64 << 20, 3
SALTS = 32
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(identifier: str | None) -> int | None:
    number = (identifier or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP head alone, which still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """A bundle being written: records gather in a frame, frames go to the file as they fill."""

    def __init__(self, folder: str, level: int):
        task = TaskContext.get()
        self.path = f"{folder}/bundle-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}.warc.zst"
        system, path = _open(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.records: list[bytes] = []
        self.held = self.written = 0

    def add(self, rec: bytes) -> tuple[str, int, int, int]:
        """(bundle, frame, offset within the frame, length) of the record."""
        if self.held and self.held + len(rec) > FRAME_BYTES:
            self.flush()
        place = (self.path, len(self.frames), self.held, len(rec))
        self.records.append(rec)
        self.held += len(rec)
        return place

    def flush(self) -> None:
        if self.records:
            packed = self.packer.compress(b"".join(self.records))
            self.out.write(packed)
            self.frames.append((len(packed), self.held))
            self.written += len(packed)
            self.records, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(start, packed size, size) of each frame, read from the bundle's end."""
    size = file.size()
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - 9 - 8 * n)
    frames, start = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * n)):
        frames.append((start, packed, plain))
        start += packed
    return frames


def _write(folder: str, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for page_id, url, payload, sha, refers_to, revisit in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "sha", "refers_to", "revisit")), strict=True):
                bundle = bundle or Bundle(folder, level)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                rows.append((page_id, record_id(page_id), *bundle.add(record(page_id, url, payload, digest, refers_to, revisit, date))))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "record_id", "bundle", "frame", "offset", "length"])
        if bundle:
            bundle.close()

    return run


def _parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _records(frame: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(frame):
        body = frame.index(b"\r\n\r\n", at) + 4
        length = int(frame[at:body].rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
        yield frame[at : body + length + 4]
        at = body + length + 4


def _row(rec: bytes) -> tuple:
    fields, block = _parse(rec)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return _page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], _page_of(fields.get("WARC-Refers-To")), None if revisit else payload


ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], [f.split()[0] for f in ROWS.split(", ")])


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for path in batch["bundle"].to_pylist():
            system, place = _open(path)
            with system.open_input_file(place) as file:
                for start, packed, plain in seek_table(file):
                    file.seek(start)
                    yield _rows([_row(r) for r in _records(unpack.decompress(file.read(packed), max_output_size=plain))])


def _read_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, last, frame = [], None, b""
        for path, number, offset, length in zip(*(batch[c].to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
            if (path, number) != last:
                system, place = _open(path)
                with system.open_input_file(place) as file:
                    start, packed, plain = seek_table(file)[number]
                    file.seek(start)
                    frame, last = unpack.decompress(file.read(packed), max_output_size=plain), (path, number)
            rows.append(_row(frame[offset : offset + length]))
        if rows:
            yield _rows(rows)


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, level: int = LEVEL, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html); returns the index (INDEX), itself kept in the shared folder.

    Payloads are the html in UTF-8, null ones empty. Of payloads of `min_bytes` and more that are equal, that of the smallest
    page_id is a response and the others revisit it; null ids come last. Rows that repeat a response's page_id and payload are
    responses as well; if all rows of a payload have null ids, all are responses. Null urls have no target. Other columns
    are not read. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    counted = F.octet_length("payload") >= min_bytes
    several = rows.where(counted).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("sha", "first")
    # a payload may be that of a third of all pages: its rows are dealt over SALTS keys
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left")
    revisit = counted & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = dealt.select("page_id", "url", "payload", "sha", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return keep(typed.mapInArrow(_write(folder, level, date), INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """All records of the index's bundles (ROWS), frame by frame; a response's payload is checked against its digest."""
    bundles = index.select("bundle").distinct()
    n = max(bundles.count(), 1)  # a task for each bundle: the rows are few, the files are not
    return bundles.repartitionByRange(n, "bundle").mapInArrow(_read_all, ROWS)


def fetch(index: DataFrame) -> DataFrame:
    """The records of the index rows given, each from its own frame."""
    return index.select("bundle", "frame", "offset", "length").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_read_some, ROWS)
