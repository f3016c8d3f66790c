"""Media columns: bytes stored losslessly as PNG images in a binary column, and perceptual hashes.

The PNG is written and read here: length, type, data and CRC-32 of each chunk, zlib data with its
own sum, and row filters undone with numpy. The hash is the sign pattern of the lowest frequencies
of a cosine transform of the image, averaged to a small square. Images and hashes are binary columns
of a Parquet table, and what is reported is read back from there.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, save, work_dir

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE, LOW, STEPS = 32, 8, 256
IDAT = 1 << 20


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Each row with the filter (none, sub or up) that leaves the smallest sum of magnitudes."""
    above = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    left = np.hstack([np.zeros_like(rows[:, :1]), rows[:, :-1]])
    tried = np.stack([rows, rows - left, rows - above])
    cost = np.minimum(tried, 256 - tried.astype(np.int16)).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    return np.hstack([best[:, None].astype(np.uint8), tried[best, np.arange(len(rows))]])


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """Grey 8-bit samples, ``width`` in a row; the payload must fill whole rows."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    data = zlib.compress(filtered(rows).tobytes(), level)
    parts = [chunk(b"IDAT", data[i : i + IDAT]) for i in range(0, len(data), IDAT)]
    return b"".join([SIGNATURE, chunk(b"IHDR", head), *parts, chunk(b"IEND", b"")])


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + size]
        if len(data) < size or struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} is cut off or its checksum is wrong")
        yield kind, data
        at += 12 + size


def paeth(left: int, up: int, corner: int) -> int:
    guess = left + up - corner
    near = [abs(guess - x) for x in (left, up, corner)]
    return (left, up, corner)[near.index(min(near))]


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters; ``step`` is the bytes of a pixel."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    sub = np.flatnonzero(kinds == 1)
    if len(sub):
        lanes = out[sub].reshape(len(sub), -1, step)
        out[sub] = np.cumsum(lanes, axis=1, dtype=np.uint8).reshape(len(sub), -1)
    for y in np.flatnonzero(kinds >= 2):
        above = out[y - 1] if y else np.zeros_like(out[0])
        if kinds[y] == 2:
            out[y] += above
            continue
        row, up = out[y].tolist(), above.tolist()
        for x in range(len(row)):
            left = row[x - step] if x >= step else 0
            if kinds[y] == 3:
                row[x] = (row[x] + (left + up[x]) // 2) & 255
            else:
                row[x] = (row[x] + paeth(left, up[x], up[x - step] if x >= step else 0)) & 255
        out[y] = row
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Samples (rows, bytes of a row) of an 8-bit image without interlacing; tests all checksums."""
    parts: dict[bytes, list[bytes]] = {}
    for kind, data in chunks(png):
        parts.setdefault(kind, []).append(data)
    if not {b"IHDR", b"IDAT", b"IEND"} <= parts.keys():
        raise ValueError("a chunk is missing")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if depth != 8 or interlaced or colour not in (0, 2, 4, 6):
        raise ValueError("only 8-bit images without palette and interlacing are read")
    step = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = zlib.decompress(b"".join(parts[b"IDAT"]))
    if len(raw) != height * (1 + width * step):
        raise ValueError("the image data does not fit its header")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), step)


def cosine(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


BASIS = cosine(SIDE, LOW)


def shrink(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Means over a grid of ``side`` by ``side`` cells; a small image repeats its samples."""

    def means(a: np.ndarray) -> np.ndarray:
        n = len(a)
        starts = np.arange(side) * n // side
        sizes = np.maximum(1, (np.arange(1, side + 1) * n // side) - starts)
        if n >= side:
            return np.add.reduceat(a, starts, axis=0) / sizes[:, None]
        return a[starts]

    return means(means(image.astype(np.float64)).T).T


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the lowest 8 by 8 frequencies lie above their median. The mean counts as 0.

    Terms are rounded to steps of a 256th of the largest, so that what is small beside it, rounding
    errors above all, is 0; a term equal to the median gives 0. A flat image has no terms: all bits are 0.
    """
    small = shrink(image)
    low = BASIS @ (small - small.mean()) @ BASIS.T
    low[0, 0] = 0
    most = np.abs(low).max()
    if most < 1e-6:
        return bytes(8)
    steps = np.rint(low * (STEPS / most))
    return np.packbits((steps > np.median(steps)).ravel()).tobytes()


def media_columns(docs: DataFrame, level: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (a PNG), hash (8 bytes): each text as UTF-8, padded with zero bytes to
    whole rows of 64 samples. One row for each row of ``docs``, repeated rows and null ids too; a
    null text is empty and becomes one row of zeros; equal texts give equal bytes. An image is held
    whole, in about three times the bytes of its text. An empty table gives no rows; other columns
    are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, sizes, media, hashes = whole.slice(at, 512), [], [], []
                for text in batch.column(1).to_pylist():
                    raw = (text or "").encode("utf-8", "replace")
                    payload = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
                    sizes.append(len(raw))
                    media.append(encode_png(payload, level=level))
                    hashes.append(cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(hashes, pa.binary())], ["doc_id", "n_bytes", "media", "hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(work), "doc_id long, n_bytes long, media binary, hash binary")


def read_media(media: DataFrame) -> DataFrame:
    """Digests of the samples read back from the stored images, and the hash as hex. An image that is
    damaged, or whose samples have another hash than the stored one, raises."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                rows = []
                for doc, n, png, stored in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns)):
                    image = decode_png(png)
                    raw, found = image.tobytes(), cosine_hash(image)
                    if found != stored:
                        raise ValueError("an image has another hash than the one beside it")
                    rows.append((doc, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(png), hashlib.sha256(png).hexdigest(), found.hex()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    return media.select("doc_id", "n_bytes", "media", "hash").mapInArrow(lean(work), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_table(docs: DataFrame, **options) -> DataFrame:
    """Writes the images as a Parquet table in the shared folder and returns what is read back of them."""
    return read_media(save(media_columns(docs, **options), f"{work_dir(docs.sparkSession, 'media')}/images"))
