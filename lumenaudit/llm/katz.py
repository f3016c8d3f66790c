"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised.

Documents are kept as blocks of token numbers in the shared folder. For each order, every block
sends its distinct n-grams, with their counts in training documents, to the partition of their
context; the partition adds counts up, stores them as its part of the model, and returns, to the
blocks that asked, the total of each n-gram and what the backoff weight of each context needs. A
block then evaluates P(w | h) = d c(hw) / c(h), or alpha(h) P(w | shorter h), for each of its tokens.
A context that is frequent is split over several partitions and its parts are added.

The model is a folder of tables: ``level-n`` has a row for each partition, with its contexts, their
followers, total counts and what their lower-order probabilities follow from; ``weights-n`` has a row for each context with
its backoff weight; ``about`` has the order and the number of partitions. New texts are scored from
them alone.

Words are told apart by a 64-bit hash, followers of one context by 48 bits of it. Vocabulary, counts
and counts of counts cover all training documents; unseen words are one outcome, ``unk``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import MB, estimated_bytes, get, lean, put, release, save, work_dir

#: Counts above this are not discounted.
LAST = 5
END_HASH = xxhash.xxh64_intdigest(b"\xff end")
START_HASH = xxhash.xxh64_intdigest(b"\xff start")
LOW48, GHOST = (1 << 48) - 1, (1 << 48) - 1
BLOCK_CHARS = 8 << 20
ASK = "part int, block string, data binary"
REPLY = "level int, part int, block string, data binary, nums array<bigint>, model binary"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def packed(*arrays: np.ndarray) -> bytes:
    """Each array byte by byte of its numbers, so that leading zeros lie together, then compressed."""
    raw = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(raw)}Q", *map(len, raw)) + b"".join(raw))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    at, out = 8 * len(kinds), []
    for n, kind in zip(struct.unpack_from(f"<{len(kinds)}Q", raw), map(np.dtype, kinds)):
        planes = np.frombuffer(raw, np.uint8, n, at).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n
    return out


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all texts, each ended by one end, and the hash of each number's word."""
    raw = b"\xff".join((t or "").encode("utf-8", "replace") for t in texts) + b"\xff"
    buf = LOWER[np.frombuffer(raw, np.uint8)]
    space, end = SPACE[buf], buf == 0xFF
    word = ~(space | end)
    first = word.copy()
    first[1:] &= ~word[:-1]
    keep = ~space
    starts = np.flatnonzero((first | end)[keep])
    kept = buf[keep]
    offsets = np.append(starts, len(kept)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    hashes = np.fromiter((END_HASH if w == b"\xff" else xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return coded.indices.to_numpy().astype(np.int64), hashes


class Block:
    """Token numbers of some documents; what levels need is derived from them, alike each time."""

    KINDS = ("<i8", "?", "<i8", "?", "<u4", "<u8")

    def __init__(self, ids, has_id, ends, held, tokens, hashes):
        self.ids, self.has_id, self.ends, self.held = ids, has_id, ends, held
        self.tokens, self.hashes = tokens.astype(np.int64), hashes
        sizes = np.diff(ends, prepend=0)
        self.train = np.repeat(~held, sizes)
        self.first = np.zeros(len(tokens), bool)
        self.first[(ends - sizes)[sizes > 0]] = True

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None], held: list[bool]) -> Block:
        tokens, hashes = tokens_of(texts)
        ends = np.flatnonzero(hashes[tokens] == np.uint64(END_HASH)) + 1
        return cls(np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids]), ends, np.array(held, bool), tokens, hashes)

    def dump(self) -> bytes:
        return packed(self.ids, self.has_id, self.ends.astype("<i8"), self.held, self.tokens.astype("<u4"), self.hashes)

    @classmethod
    def load(cls, uri: str) -> Block:
        return cls(*unpacked(get(uri), *cls.KINDS))


class Level:
    """The distinct n-grams of a block, numbered, and the number at each token.

    Level 1 has the words. A higher one pairs the number of the n-1 tokens before (or a number of
    its own at the start of a document) with the word.
    """

    def __init__(self, block: Block, below: Level | None, parts: int):
        self.block, self.below, self.parts = block, below, parts
        if below is None:
            self.n, self.at, self.keys = 1, block.tokens, block.hashes
            self.counts = np.bincount(block.tokens[block.train], minlength=len(block.hashes))
            self.part = (self.keys % np.uint64(parts)).astype(np.int64)
            self.order = np.argsort(self.part, kind="stable")
            return
        self.n = below.n + 1
        start = len(below.keys)  # the number of the context at the start of a document
        context = np.empty_like(block.tokens)
        context[0], context[1:] = start, below.at[:-1]
        context[block.first] = start
        wide = len(block.hashes)
        pairs, self.at = np.unique(context * wide + block.tokens, return_inverse=True)
        self.context, self.word = pairs // wide, pairs % wide
        self.counts = np.bincount(self.at[block.train], minlength=len(pairs))
        self.context_keys = np.append(below.keys, np.uint64(START_HASH) + np.uint64(self.n))
        self.keys = mixed(self.context_keys[self.context], block.hashes[self.word])

    def route(self, frequency: np.ndarray, total: int) -> None:
        """Partition of each n-gram. frequency: of each context, known from the level below; a context
        with over a quarter of a partition's share is split, and each of its parts gets a ghost row."""
        split = np.clip(-(-frequency * 4 * self.parts // max(1, total)), 1, self.parts).astype(np.int64)
        seen = np.unique(self.context)
        hot = seen[split[seen] > 1]
        ghosts = np.repeat(hot, split[hot])
        turn = np.arange(len(ghosts)) - np.repeat(np.cumsum(split[hot]) - split[hot], split[hot])
        sub = (self.block.hashes[self.word] >> np.uint64(32)).astype(np.int64) % split[self.context]
        self.rows_context = np.concatenate((self.context, ghosts))
        #: Numbers of words; a ghost's is one above all.
        self.rows_word = np.concatenate((self.word, np.full(len(ghosts), len(self.block.hashes))))
        part = (self.context_keys[self.rows_context] % np.uint64(self.parts)).astype(np.int64) + np.concatenate((sub, turn))
        self.part = part % self.parts
        self.order = np.lexsort((self.rows_context, self.part))

    def segments(self) -> Iterator[tuple[int, np.ndarray]]:
        """(partition, rows in it), in the order in which asks and replies list them."""
        part = self.part[self.order]
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(part[a]), self.order[a:b]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (b >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def runs_of(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal neighbours."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def turing(of: list[float]) -> list[float] | None:
    """Katz's factors of counts 1 .. LAST from counts of counts ``of``, if all lie within (0, 1)."""
    if not all(of[1 : LAST + 1]) or (ratio := (LAST + 1) * of[LAST + 1] / of[1]) >= 1:
        return None
    factors = [((r + 1) * of[r + 1] / of[r] / r - ratio) / (1 - ratio) for r in range(1, LAST + 1)]
    return factors if all(0 < d < 1 for d in factors) else None


def smoothed(of: list[int]) -> list[float]:
    """Counts of counts on the line through log n_r by log r, up to scale, as in Simple Good-Turing.

    Where it falls faster than 1/r, all factors from it lie within (0, 1).
    """
    seen = [r for r in range(1, LAST + 2) if of[r]]
    slope = np.polyfit(np.log(seen), np.log([of[r] for r in seen]), 1)[0] if len(seen) > 1 else 0.0
    return [0.0, *(float(r) ** slope for r in range(1, LAST + 2))]


class Discount:
    """Good-Turing factors of one order from its counts of counts n_1 .. n_(LAST+1).

    Where the raw ratios give a factor outside (0, 1), all are taken from smoothed counts of counts.
    """

    def __init__(self, nums: list[int]):
        of, self.total, self.kinds = [0, *nums[: LAST + 1]], nums[LAST + 1], nums[LAST + 2]
        self.factor = np.ones(LAST + 1)
        factors = turing(of) or turing(smoothed(of))
        if factors:
            self.factor[1:] = factors
        else:  # counts of counts that do not fall faster than 1/r: take a fixed part of each count
            part = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
            self.factor[1:] = [(r - min(part, 0.9)) / r for r in range(1, LAST + 1)]
        #: Where nothing was discounted, half a count of each kind is set free.
        self.of = of

    def kept(self, counts: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Discounted counts; half: where half a count of each is taken off instead."""
        factor = self.factor[np.where(counts <= LAST, counts, 0)]
        return np.where(half, np.maximum(counts - 0.5, 0), counts * factor)

    def words(self, counts: np.ndarray) -> np.ndarray:
        """Level 1: P(w), at count 0 that of ``unk``."""
        small = sum(self.of[1 : LAST + 1])
        if not self.total:
            return np.ones(len(counts))
        half = small == 0
        freed = 0.5 * self.kinds if half else sum(self.of[r] * r * (1 - self.factor[r]) for r in range(1, LAST + 1))
        return np.where(counts == 0, freed, self.kept(counts, np.full(len(counts), half))) / self.total


#: Of a context: followers with count 1 .. LAST, with higher ones, sum of those, sum of lower P.
STATS = LAST + 3


class Model:
    """P at each token of a block, level by level, from replies."""

    def __init__(self, block: Block, parts: int, discounts: list[Discount]):
        self.block, self.parts, self.discounts = block, parts, discounts
        self.level = Level(block, None, parts)

    def words(self, replies: dict[int, bytes]) -> None:
        totals = np.zeros(len(self.level.keys), np.int64)
        for part, rows in self.level.segments():
            totals[rows] = unpacked(replies[part], "<i8")[0]
        self.totals = self.word_totals = totals
        self.p = self.discounts[0].words(totals)  # of each n-gram of the level

    def next_level(self) -> None:
        below = self.level
        self.level = Level(self.block, below, self.parts)
        end = self.word_totals[self.block.hashes == np.uint64(END_HASH)]
        self.level.route(np.append(self.totals, end.sum()), self.discounts[0].total)
        if below.n == 1:
            self.lower = self.p[self.level.word]
        else:  # the same word after one token less; it is at the same place in the text
            lower = np.zeros(len(self.level.keys))
            lower[self.level.at] = self.p[below.at]
            self.lower = lower

    def asks(self) -> Iterator[tuple[int, bytes]]:
        """N-grams name their word by its place in a list of the segment's words. Level 2 sends counts
        of those words in place of their P, which follows from them."""
        level = self.level
        if level.n == 1:
            for part, rows in level.segments():
                yield part, packed(level.keys[rows], level.counts[rows])
            return
        ghosts = len(level.rows_context) - len(level.keys)
        counts = np.append(level.counts, np.zeros(ghosts, np.int64))
        keys = np.append(self.block.hashes & np.uint64(LOW48), np.uint64(GHOST))
        lower = np.append(self.word_totals, 0) if level.n == 2 else np.append(self.lower, np.zeros(ghosts))
        for part, rows in level.segments():
            context = level.rows_context[rows]
            starts = runs_of(context)
            words, place = np.unique(level.rows_word[rows], return_inverse=True)
            sent = level.context_keys[context[starts]], np.diff(starts, append=len(rows)), keys[words], place.astype("<u4"), counts[rows]
            yield part, packed(*sent, lower[words if level.n == 2 else rows])

    def take(self, replies: dict[int, bytes], discount: Discount) -> None:
        """Totals and statistics of contexts, then P of each n-gram.

        Where all followers of a context that were seen are in the block, it adds up their lower P
        itself; the others' sums are in the reply.
        """
        level = self.level
        ghosts = len(level.rows_context) - len(level.keys)
        lower = np.append(self.lower, np.zeros(ghosts))
        totals = np.zeros(len(level.rows_context), np.int64)
        stats = np.zeros((len(level.context_keys), STATS))
        for part, rows in level.segments():
            got, kinds, sums = unpacked(replies[part], "<i8", "<i8", "<f8")
            totals[rows] = got
            context = level.rows_context[rows]
            starts = runs_of(context)
            of = np.zeros((STATS, len(starts)))
            of[: STATS - 1] = kinds.reshape(STATS - 1, -1)
            of[-1] = np.add.reduceat(np.where(got > 0, lower[rows], 0.0), starts)
            of[-1, lacking(got, starts, of)] = sums
            np.add.at(stats, context[starts], of.T)
        totals = totals[: len(level.keys)]
        self.totals, self.p = totals, katz(totals, stats, level.context, self.lower, discount)


def lacking(totals: np.ndarray, starts: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Contexts with followers other than those listed."""
    return np.add.reduceat((totals > 0).astype(np.int64), starts) < stats[: LAST + 1].sum(0)


def backoff(stats: np.ndarray, discount: Discount) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts with these statistics: the total count, the backoff weight, and whether half a count
    of each follower is set free because none is discounted."""
    small, kinds, above = stats[:, :LAST], stats[:, LAST], stats[:, LAST + 1]
    rank = np.arange(1, LAST + 1)
    of = small @ rank + above
    half = small.sum(1) == 0
    kept = np.where(half, above - 0.5 * kinds, small @ (rank * discount.factor[1:]) + above)
    return of, np.where(of > 0, (1 - kept / np.maximum(of, 1)) / (1 - stats[:, -1]), 1.0), half


def katz(totals: np.ndarray, stats: np.ndarray, context: np.ndarray, lower: np.ndarray, discount: Discount) -> np.ndarray:
    """P of n-grams; stats: of each context."""
    of, alpha, half = backoff(stats, discount)
    return np.where(totals > 0, discount.kept(totals, half[context]) / np.maximum(of, 1)[context], alpha[context] * lower)


def context_stats(starts: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """STATS rows for each context: n-grams from each start on, with total counts and lower P."""
    rows = [*(counts == r for r in range(1, LAST + 1)), counts > LAST, np.where(counts > LAST, counts, 0), np.where(counts > 0, lower, 0.0)]
    return np.array([np.add.reduceat(r.astype(np.float64), starts) for r in rows])


def summary(totals: np.ndarray) -> list[int]:
    return [*(int((totals == r).sum()) for r in range(1, LAST + 2)), int(totals.sum()), int((totals > 0).sum())]


#: A partition's row of the model: contexts, followers of each, words, total counts, and at level 2 the
#: total counts of the words alone, above it their probability after the shorter context. A context
#: that is split over partitions has a ghost, of count 0, among its followers in each. Asks are alike.
Stored = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
NONE = np.zeros(0, np.int64)
SCHEMA = pa.schema([("level", pa.int32()), ("part", pa.int32()), ("block", pa.string()), ("data", pa.binary()), ("nums", pa.list_(pa.int64())), ("model", pa.binary())])


def reply_rows(level: int, part: int, rows: list[tuple[str, bytes]], nums: list[int] | None = None, kept: Stored | None = None) -> pa.Table:
    """One row for each block, and unless the model is there already its row, without a block."""
    blocks, data, told, model = [b for b, _ in rows], [d for _, d in rows], [None] * len(rows), [None] * len(rows)
    if kept is not None:
        blocks, data, told, model = [*blocks, ""], [*data, b""], [*told, nums], [*model, packed(*(listed(level, kept) if level > 1 else kept))]
    return pa.table([[level] * len(blocks), [part] * len(blocks), blocks, data, told, model], schema=SCHEMA)


def listed(level: int, kept: Stored) -> tuple[np.ndarray, ...]:
    """With each word, and at level 2 what goes with it, once, and its place in that list instead."""
    context, followers, word, totals, low = kept
    with_word = low if level == 2 else np.zeros(len(word), np.int64)
    order = np.lexsort((with_word, word))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(word[order]) != 0) | (np.diff(with_word[order]) != 0)
    place = np.empty(len(order), "<u4")
    place[order] = np.cumsum(new) - 1
    first = order[new]
    return context, followers, word[first], place, totals, low[first] if level == 2 else low


def unlisted(level: int, data: bytes) -> Stored:
    context, followers, words, place, counts, lower = unpacked(data, "<u8", "<i8", "<u8", "<u4", "<i8", "<i8" if level == 2 else "<f8")
    return context, followers, words[place], counts, lower[place] if level == 2 else lower


def stored_row(level: int, data: bytes) -> Stored:
    return unlisted(level, data) if level > 1 else tuple(unpacked(data, "<u8", "<i8", "<u8", "<i8", "<i8"))


def merge_words(key, table, stored=None):
    """Adds up the counts that blocks sent for the words of one partition, and what is stored of them."""
    blocks = table.column("block").to_pylist()
    sent = [unpacked(d, "<u8", "<i8") for d in table.column("data").to_pylist()]
    known = [] if stored is None else [stored[2:4]]
    words, place = np.unique(np.concatenate([k for k, _ in sent + known]), return_inverse=True)
    totals = np.bincount(place, np.concatenate([c for _, c in sent + known])).astype(np.int64)
    cuts = np.cumsum([len(k) for k, _ in sent])
    rows = [(b, packed(totals[p])) for b, p in zip(blocks, np.split(place, cuts))]
    if stored is not None:
        return reply_rows(1, key[0].as_py(), rows)
    seen = totals > 0
    return reply_rows(1, key[0].as_py(), rows, summary(totals), (NONE.view(np.uint64), NONE, words[seen], totals[seen], NONE))


def merge_grams(level: int, words: Discount):
    def merge(key, table, stored=None):
        blocks = table.column("block").to_pylist()
        contexts, grams, counts, lowers, sizes, heads = [], [], [], [], [], []

        def take(context, run, word, count, lower) -> None:
            for held, x in zip((contexts, grams, counts, lowers, sizes, heads), (np.repeat(context, run), word, count, lower, len(count), np.cumsum(run) - run)):
                held.append(x)

        for data in table.column("data").to_pylist():
            take(*unlisted(level, data))
        if stored is not None:
            take(*stored)
        context, word, count, lower = map(np.concatenate, (contexts, grams, counts, lowers))
        del contexts, grams, counts, lowers
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new = np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        totals = np.bincount(place, count).astype(np.int64)
        low = np.zeros(len(totals), lower.dtype)
        low[place] = lower
        context, word = context[new], word[new]
        starts = runs_of(context)
        stats = context_stats(starts, totals, words.words(low) if level == 2 else low)
        owner = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(totals)))
        rows, at = [], 0
        for b, n, head in zip(blocks, sizes, heads):
            own = place[at : at + n]
            of = stats[:, owner[own[head]]]
            rows.append((b, packed(totals[own], of[:-1].astype(np.int64).ravel(), of[-1, lacking(totals[own], head, of)])))
            at += n
        if stored is not None:
            return reply_rows(level, key[0].as_py(), rows)
        seen = (totals > 0) | (word == np.uint64(GHOST))  # the rest are n-grams of held-out texts
        heads = runs_of(context[seen])
        kept = context[seen][heads], np.diff(heads, append=int(seen.sum())), word[seen], totals[seen], low[seen]
        return reply_rows(level, key[0].as_py(), rows, summary(totals), kept)

    return merge


def from_asks(merge):
    """For a partition's asks alone: its row of the model is made of them."""

    def work(key, asks):
        out = merge(key, asks)
        release()
        return out

    return work


def beside_stored(level: int, merge):
    """For a partition's asks and its row of the model."""

    def work(key, asks, model):
        if not asks.num_rows:
            return SCHEMA.empty_table()
        none = NONE.view(np.uint64), NONE, NONE.view(np.uint64), NONE, NONE
        return merge(key, asks, stored_row(level, model.column("model")[0].as_py()) if model.num_rows else none)

    return work


def write_blocks(docs: DataFrame, folder: str, parts: int) -> DataFrame:
    """Writes blocks and yields what they ask for at level 1. Input: doc_id, text, held.

    A block is named by its partition, its number there and its content, so that a task that is run
    again gives the same names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = Block.of(*rows)
            put(uri := f"{folder}/blocks/{part:07d}-{n:05d}-{xxhash.xxh3_128_hexdigest(data := block.dump())}-{len(block.tokens)}", data)
            asks = list(Model(block, parts, []).asks())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in asks], pa.int32()), pa.array([uri] * len(asks)), pa.array([d for _, d in asks], pa.binary())], ["part", "block", "data"])

        rows, size = ([], [], []), 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for column, value in zip(rows, row):
                    column.append(value)
                size += len(row[1] or "")
                if size >= BLOCK_CHARS:
                    yield from flush()
                    rows, size, n = ([], [], []), 0, n + 1
        if rows[0]:
            yield from flush()

    return docs.mapInArrow(lean(work), ASK)


def replies_of(table: pa.Table) -> tuple[str, dict[int, dict[int, bytes]]]:
    out: dict[int, dict[int, bytes]] = {}
    for level, part, data in zip(*(table.column(c).to_pylist() for c in ("level", "part", "data"))):
        out.setdefault(level, {})[part] = data
    return table.column("block")[0].as_py(), out


def answers(replies: list[DataFrame], parts: int):
    """Replies by block. Dealt by number, not by size: the work is in the blocks they are for."""
    told = [r.select("level", "part", "block", "data") for r in replies]
    return reduce(DataFrame.unionAll, told).where("block != ''").repartition(parts, "block").groupBy("block")


def up_to(uri: str, replies: dict[int, dict[int, bytes]], parts: int, discounts: list[Discount]) -> Model:
    model = Model(Block.load(uri), parts, discounts)
    model.words(replies[1])
    for n in range(2, len(discounts) + 1):
        model.next_level()
        model.take(replies[n], discounts[n - 1])
    return model


def asks_after(replies: list[DataFrame], parts: int, discounts: list[Discount]) -> DataFrame:
    """What blocks ask for at the next level."""

    def ask(table):
        uri, got = replies_of(table)
        model = up_to(uri, got, parts, discounts)
        model.next_level()
        sent = list(model.asks())
        del model, got
        release()
        return pa.table([pa.array([p for p, _ in sent], pa.int32()), pa.array([uri] * len(sent)), pa.array([d for _, d in sent], pa.binary())], ["part", "block", "data"])

    return answers(replies, parts).applyInArrow(ask, ASK)


def scores(replies: list[DataFrame], parts: int, discounts: list[Discount]) -> DataFrame:
    def evaluate(table):
        uri, got = replies_of(table)
        model = up_to(uri, got, parts, discounts)
        block, first = model.block, discounts[0]
        starts = np.concatenate(([0], block.ends[:-1]))
        counts = model.word_totals[block.tokens]
        base = np.log10((counts + 1) / (first.total + first.kinds + 1))
        columns = [pa.array(block.ids, mask=~block.has_id), pa.array(block.held), pa.array(np.diff(block.ends, prepend=0)), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)), pa.array(np.full(len(starts), first.total, np.int64))]
        columns += [pa.array(np.add.reduceat(x, starts)) for x in (base, np.log10(model.p)[model.level.at])]
        del model, got, block, counts, base
        release()
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return answers(replies, parts).applyInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def discount_of(level: DataFrame) -> Discount:
    """From the counts of counts that all partitions of a level have stored."""
    nums = dict(level.where("block = ''").select(F.posexplode("nums")).groupBy("pos").agg(F.sum("col")).collect())
    return Discount([nums.get(i, 0) for i in range(LAST + 3)])


def weights_of(level: DataFrame, n: int, discounts: list[Discount]) -> DataFrame:
    """context, total, alpha: the exactly normalised backoff weight of each context of level ``n``. Only
    statistics of split contexts are moved, to be added up."""
    words, discount = discounts[0], discounts[n - 1]
    names = [f"s{i}" for i in range(STATS)]

    def of_contexts(split: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    context, followers, word, total, lower = stored_row(n, data)
                    if not len(context):
                        continue
                    starts = np.cumsum(followers) - followers
                    stats = context_stats(starts, total, words.words(lower) if n == 2 else lower)
                    own = np.logical_or.reduceat(word == np.uint64(GHOST), starts) == split
                    yield pa.RecordBatch.from_arrays([pa.array(context[own].view(np.int64)), *(pa.array(s[own]) for s in stats)], ["context", *names])

        return work

    def alpha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, alpha, _ = backoff(np.array([c.to_numpy() for c in batch.columns[1:]]).T, discount)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of.astype(np.int64)), pa.array(alpha)], ["context", "total", "alpha"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return alpha(of_contexts(False)(batches))

    rows, kind = level.where("block = ''").select("model"), "context long, total long, alpha double"
    parts = rows.mapInArrow(of_contexts(True), "context long, " + ", ".join(f"{name} double" for name in names))
    added = parts.groupBy("context").agg(*[F.sum(name).alias(name) for name in names]).mapInArrow(alpha, kind)
    return rows.mapInArrow(whole, kind).unionByName(added)


def source_rows(docs: DataFrame, held: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))


def score_documents(docs: DataFrame, held: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Learns from rows where ``held`` is false; scores are log10 of the text's probability, ends
    included. base_score: add-one unigrams over the vocabulary and one unseen outcome. Null texts
    are empty, which leaves the end; a null ``held`` is false; repeated rows count each. An empty
    table gives no rows, and without training rows every token has probability 1. Texts are scored
    whole, a block of them at a time. model: the folder of the model's tables, by default one that
    goes with the driver; see ``score_texts``.
    """
    spark = docs.sparkSession
    folder = model or work_dir(spark, "katz")
    parts = parts or max(1, -(-estimated_bytes(docs) // (8 * MB)))
    asks = write_blocks(source_rows(docs, held, id_col, text_col), folder, parts)
    replies, discounts = [], []
    for n in range(1, order + 1):
        if n > 1:
            asks = asks_after(replies, parts, list(discounts))
        merge = from_asks(merge_words if n == 1 else merge_grams(n, discounts[0]))
        reply = asks.groupBy("part").applyInArrow(merge, REPLY)
        replies.append(save(reply, f"{folder}/level-{n}"))
        discounts.append(discount_of(replies[-1]))
        if n > 1:
            save(weights_of(replies[-1], n, discounts), f"{folder}/weights-{n}")
    save(spark.createDataFrame([(order, parts)], "max_order int, parts int"), f"{folder}/about")
    return scores(replies, parts, discounts)


def score_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns for texts that nothing is learned from, by the tables of a stored model."""
    spark = docs.sparkSession
    order, parts = spark.read.parquet(f"{model}/about").first()
    folder = work_dir(spark, "katz-texts")
    stored = [spark.read.parquet(f"{model}/level-{n}") for n in range(1, order + 1)]
    asks, replies, discounts = write_blocks(source_rows(docs, F.lit(True), id_col, text_col), folder, parts), [], []
    for n, level in enumerate(stored, 1):
        if n > 1:
            asks = asks_after(replies, parts, list(discounts))
        merge = beside_stored(n, merge_words if n == 1 else merge_grams(n, discounts[0]))
        rows = level.where("block = ''").select("part", "model")
        replies.append(save(asks.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(merge, REPLY), f"{folder}/level-{n}"))
        discounts.append(discount_of(level))
    return scores(replies, parts, discounts)
