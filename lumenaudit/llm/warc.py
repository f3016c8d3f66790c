"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. A skippable frame at the end of the file
holds the seek table (compressed and plain size of each frame), and an index maps record ids to a
frame and an offset in it, so that one record is read by fetching its frame alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Sink, lean, open_input, save, work_dir

#: Of the seekable Zstandard format: the skippable frame that holds the table, and the last 4 bytes.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FRAME, FILE = 1 << 20, 256 << 20


def record_id(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(key: int | None, url: str | None, kind: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    block = HTTP + (b"" if kind == REVISIT else payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key)), ("WARC-Date", DATE), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", base32(digest)), ("X-Payload-Length", str(size))]
    if kind == REVISIT:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and the end of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(head["Content-Length"])
    block = data[start : start + size]
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    return head, block[block.index(b"\r\n\r\n") + 4 :], start + size + 4


def key_of(urn: str) -> int | None:
    text = urn[len("<urn:page:") : -1]
    return int(text) if text else None


class Bundle:
    """Writes one file."""

    def __init__(self, uri: str, level: int = 3):
        self.uri, self.sink, self.level = uri, Sink(uri), level
        self.frames: list[tuple[int, int]] = []
        self.held, self.size = [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The record's frame and its offset there."""
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, FOOTER)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.commit()


class Reader:
    """Reads frames of a bundle through its seek table."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)
        if len(data) != plain:
            raise ValueError("a frame does not have the size in the seek table")
        return data

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]

    def records(self) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        for i in range(len(self.frames)):
            data, at = self.frame(i), 0
            while at < len(data):
                head, payload, end = parse(data, at)
                yield i, at, head, payload
                at = end


def write_archives(pages: DataFrame, folder: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row and returns the index: page_id, file, frame, record_offset.

    Of rows with equal payloads of at least ``least`` bytes, the one with the largest page_id is the
    response and others revisit it; rows that repeat that page_id are responses too, and so are rows
    with a null id and smaller payloads. A null payload or url is empty. Payloads of equal SHA-256 and
    size are equal. A payload is held whole. An empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "same": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload").cast("long")})
    newest = rows.where(F.col("size") >= least).groupBy("same", "size").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = rows.join(newest, ["same", "size"], "left").select("page_id", "url", "payload", "digest", "size", F.when(F.col("page_id") < F.col("newest"), F.col("newest")).alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, n, attempt = None, 0, TaskContext.get().taskAttemptId()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                ids, files, frames, offsets = [], [], [], []
                batch = whole.slice(at, 512)
                for key, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if bundle is None:
                        bundle, n = Bundle(f"{folder}/pages-{attempt:08d}-{n:04d}.warc.zst"), n + 1
                    kind = RESPONSE if refers_to is None else REVISIT
                    frame, offset = bundle.add(record(key, url, kind, payload, digest, size, refers_to))
                    for column, value in zip((ids, files, frames, offsets), (key, bundle.uri, frame, offset)):
                        column.append(value)
                    if bundle.sink.size >= FILE:
                        bundle.close()
                        bundle = None
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64())], ["page_id", "file", "frame", "record_offset"])
        if bundle is not None:
            bundle.close()

    return save(told.mapInArrow(lean(work), "page_id long, file string, frame int, record_offset long"), f"{folder}/index")


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to of all records in the
    files of ``index``. Responses are held against their digest and length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for _, _, head, payload in Reader(file).records():
                    size, kind = int(head["X-Payload-Length"]), head["WARC-Type"]
                    digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                    if kind == RESPONSE and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"a payload in {file} does not match its digest")
                    rows.append((key_of(head["WARC-Record-ID"]), size, digest, kind, key_of(head["WARC-Refers-To"]) if kind == REVISIT else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = index.groupBy("file").agg(F.count("*").alias("n"))
    return files.select("file").mapInArrow(lean(work), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(index: DataFrame, key: int) -> bytes | None:
    """The payload of one record, through its frame alone; a revisit leads to its response."""
    row = index.where(F.col("page_id") == key).first()
    if row is None:
        return None
    head, payload = Reader(row.file).record(row.frame, row.record_offset)
    return lookup(index, key_of(head["WARC-Refers-To"])) if head["WARC-Type"] == REVISIT else payload


def archive(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the archives to the shared folder and reads them back; an empty table gives no rows."""
    return read_archives(write_archives(pages, work_dir(pages.sparkSession, "warc"), least))


def oracle(pages: str = "pages", least: int = 1000) -> str:
    """The same result in SQL, without archives."""
    older = f"payload_bytes >= {least} AND page_id < newest"
    return f"""WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM {pages}),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN {older} THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN {older} THEN newest END AS refers_to FROM m"""
