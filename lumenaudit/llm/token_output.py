"""Token-id shards: concatenated ids in binary files with Elias-Fano encoded document boundaries.

A shard is: the ids (16 or 32 bits each, little-endian), the boundaries, the document ids, a footer.
Both monotone sequences are Elias-Fano encoded: the low bits of each value packed, the high bits as
unary gaps in a bit vector, with the place of every 256th set bit for select. Offsets come from
select on that vector; there is no table of 64-bit offsets.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Sink, lean, open_input, parts_for, save, work_dir
from .tokens import encoded

MAGIC = b"LMTS0001"
SAMPLE = 256


class EliasFano:
    """n ascending integers from 0 on. ``get`` selects one, ``span`` some that follow each other."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4" if n == 0 or places[-1] < 1 << 32 else "<u8"))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[a // 8 : (b + 7) // 8].tobytes(), "little")
        return (word >> (a % 8)) & ((1 << self.low_bits) - 1)

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, skip = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = start // 8
        byte = int(self.high[at]) >> (start % 8) << (start % 8)
        while (ones := byte.bit_count()) <= skip:
            skip -= ones
            at += 1
            byte = int(self.high[at])
        for _ in range(skip):
            byte &= byte - 1
        place = 8 * at + (byte & -byte).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def span(self, i: int, j: int) -> np.ndarray:
        """Those from the i-th to before the j-th; reads only their part of both vectors."""
        if not 0 <= i < j <= self.n:
            return np.zeros(0, np.int64)
        first = i // SAMPLE * SAMPLE
        at = int(self.samples[first // SAMPLE]) // 8
        after = (j - 1) // SAMPLE + 1
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[at:end], bitorder="little")
        bits[: int(self.samples[first // SAMPLE]) - 8 * at] = 0
        places = np.flatnonzero(bits)[i - first : j - first] + 8 * at
        high = (places - np.arange(i, j)) << self.low_bits
        if not self.low_bits:
            return high
        a = i * self.low_bits
        low = np.unpackbits(self.low[a // 8 : -(-j * self.low_bits // 8)], bitorder="little")[a % 8 :][: (j - i) * self.low_bits]
        return high | low.reshape(j - i, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def last_up_to(self, value: int, i: int) -> int:
        """The last place from ``i`` on that holds at most ``value``, by selects; ``i`` if there is none."""
        a, b = i, self.n
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if self.get(middle) <= value else (a, middle)
        return a

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    def about(self) -> dict:
        return {"n": self.n, "low_bits": self.low_bits, "wide": self.samples.itemsize, "sizes": [len(x) for x in self.parts()]}

    @classmethod
    def read(cls, about: dict, data: bytes) -> EliasFano:
        a, b, _ = about["sizes"]
        return cls(about["n"], about["low_bits"], np.frombuffer(data[:a], np.uint8), np.frombuffer(data[a : a + b], np.uint8), np.frombuffer(data[a + b :], f"<u{about['wide']}"))


class ShardWriter:
    def __init__(self, uri: str, wide: bool):
        self.sink, self.kind = Sink(uri), "<u4" if wide else "<u2"
        self.ends, self.docs, self.nulls, self.crc = [0], [], 0, 0

    def add(self, doc: int | None, raw: bytes) -> None:
        ids = np.frombuffer(raw, "<u4")
        if self.kind == "<u2" and len(ids) and ids.max() >= 1 << 16:
            raise ValueError("an id needs more than 16 bits")
        self.sink.write(data := ids.astype(self.kind).tobytes())
        self.crc = zlib.crc32(data, self.crc)
        self.ends.append(self.ends[-1] + len(ids))
        if doc is None:
            self.nulls += 1
        else:
            self.docs.append(doc)

    def close(self) -> None:
        first = self.docs[0] if self.docs else 0
        both = [EliasFano.of(np.array(self.ends)), EliasFano.of(np.array(self.docs, np.int64) - first)]
        for x in both:
            for part in x.parts():
                self.sink.write(part)
        foot = json.dumps({"kind": self.kind, "ids": self.ends[-1], "nulls": self.nulls, "first": first, "crc32": self.crc, "ends": both[0].about(), "docs": both[1].about()}).encode()
        self.sink.write(foot + struct.pack("<I", len(foot)) + MAGIC)
        self.sink.commit()


class Shard:
    """A shard read back; ids are fetched by document."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        size = self.file.size()
        n, magic = struct.unpack("<I8s", self.file.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.about = json.loads(self.file.read_at(n, size - 12 - n))
        self.width = np.dtype(self.about["kind"]).itemsize
        at = self.about["ids"] * self.width
        a, b = (sum(self.about[k]["sizes"]) for k in ("ends", "docs"))
        self.ends = EliasFano.read(self.about["ends"], self.file.read_at(a, at))
        self.docs = EliasFano.read(self.about["docs"], self.file.read_at(b, at + a))

    def __len__(self) -> int:
        return self.ends.n - 1

    def ids(self, i: int) -> np.ndarray:
        """Of the i-th document, found by select alone."""
        a, b = self.ends.get(i), self.ends.get(i + 1)
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), self.about["kind"])

    def rows(self, step: int = 4 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start, ids) in order, reading about ``step`` ids at a time; checks the sum."""
        nulls, crc, i = self.about["nulls"], 0, 0
        while i < len(self):
            j = min(len(self), max(i + 1, self.ends.last_up_to(self.ends.get(i) + step, i)))
            ends = self.ends.span(i, j + 1)
            docs = [None] * (min(j, nulls) - i) + (self.docs.span(max(0, i - nulls), max(0, j - nulls)) + self.about["first"]).tolist()
            data = self.file.read_at(int(ends[-1] - ends[0]) * self.width, int(ends[0]) * self.width)
            crc = zlib.crc32(data, crc)
            ids = np.frombuffer(data, self.about["kind"])
            for doc, a, b in zip(docs, ends, ends[1:]):
                yield doc, int(a), ids[a - ends[0] : b - ends[0]]
            i = j
        if crc != self.about["crc32"]:
            raise ValueError("a token shard's checksum does not match")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents in ascending id order (null ids first; equal ids by text hash).

    Returns the manifest, a table beside the shards: number, file, start (ids in the shards before
    it) and ids, one row for each file. Repeated rows are documents of their own, and may lie in
    several shards; a null text is empty; a text is encoded whole. Ids are those that the library
    gives by default: a special token's string in a text is that token.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "turn": F.monotonically_increasing_id()})  # a turn parts equal rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = ShardWriter(name := f"{folder}/shard-{number:07d}-{TaskContext.get().taskAttemptId()}.ids", wide)
            for doc, raw in zip(batch.column(0).to_pylist(), encoded(tokenizer, batch.column(1), end_id)):
                writer.add(doc, raw)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"number": [number], "file": [name], "ids": [writer.ends[-1]]}, pa.schema([("number", pa.int64()), ("file", pa.string()), ("ids", pa.int64())]))

    order = ("doc_id", "tie", "turn")
    parts = rows.repartitionByRange(parts_for(docs), *order).sortWithinPartitions(*order)
    written = save(parts.mapInArrow(lean(work), "number long, file string, ids long"), f"{folder}/written")
    before = F.expr("coalesce(sum(ids) over (order by number rows between unbounded preceding and 1 preceding), 0)")
    return save(written.select("number", "file", before.alias("start"), "ids"), f"{folder}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document in all shards), n_tokens, ids_crc32, read from the
    shards of a manifest. Offsets come from selects on the boundaries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc, at, ids in Shard(file).rows():
                    rows.append((doc, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 1 << 16:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    shards = max(1, manifest.count())
    return manifest.select("file", "start").repartitionByRange(shards, "start").mapInArrow(lean(work), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards to the shared folder and returns what is read back from them.

    An empty table gives no shard and no row. Columns other than the two named are not read.
    """
    return read_shards(write_shards(docs, tokenizer, end_id, work_dir(docs.sparkSession, "shards"), wide, id_col, text_col))
