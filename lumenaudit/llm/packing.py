"""Packs documents into token sequences of a fixed capacity.

Method: bounded-space online best-fit. A packing task places pieces as they arrive and keeps a fixed
number of open bins. A bitset with one bit for each amount of free space says which amounts are on hand, so the bin that a piece
fills best is the lowest set bit at or above its length. When all bins are open and none fits, the
fullest closes and a new one opens.

Texts are encoded where they are read; only the small rows of pieces are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, save, work_dir
from .tokens import encoded

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one packing task takes: bins left open at its end are then few beside those it filled.
TASK_PIECES = 200_000


class Bins:
    """Open bins by free space. Bounded: never more than ``most`` are open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: dict[int, list[list[int]]] = {}  # free space -> bins, each [number, used]
        self.bits = 0
        self.open = self.made = 0

    def _take(self, free: int) -> list[int]:
        stack = self.free[free]
        bin_ = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the offset in it."""
        fits = self.bits >> length
        if fits:
            bin_ = self._take(length + (fits & -fits).bit_length() - 1)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            bin_ = [self.made, 0]
            self.made += 1
            self.open += 1
        number, offset = bin_
        bin_[1] += length
        free = self.capacity - bin_[1]
        if free:
            self.free.setdefault(free, []).append(bin_)
            self.bits |= 1 << free
        else:
            self.open -= 1
        return number, offset


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, raw in zip(batch.column(0).to_pylist(), encoded(tokenizer, batch.column(1), end_id)):
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(rows, kinds)][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(work), PIECE + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, open_bins: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence.

    Every row of ``docs`` is a document: its token ids, then ``end_id``. A null or empty text has
    the end id alone; repeated rows and repeated or null ids are documents of their own. Longer
    ones than ``capacity`` are cut. No sequence is longer than ``capacity`` and its pieces leave no
    gap. with_ids: also the ids, as little-endian unsigned 32-bit numbers. Ids are those that the
    library gives by default: a special token's string in a text is that token. An empty table gives
    no rows; columns other than the two named are not read.
    """
    spark = docs.sparkSession
    pieces = save(cut_documents(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), f"{work_dir(spark, 'pack')}/pieces")
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    parts = pieces.where(F.col("length") < capacity)
    tasks = max(1, -(-parts.count() // TASK_PIECES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            sequence = pa.array([base + n for n, _ in places], pa.int64())
            offset = pa.array([at for _, at in places], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sequence, offset], [*batch.schema.names, "sequence_id", "offset"])

    order = [F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "length", "ids_crc32"]
    placed = parts.repartition(tasks).sortWithinPartitions(*order).mapInArrow(lean(place), f"{PIECE}{', ids binary' if with_ids else ''}, sequence_id long, offset long")
    return whole.unionByName(placed)
