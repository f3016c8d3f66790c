"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance.

Distinct fingerprints are dealt to shards by what any linked pair must share: of four 16-bit
blocks at least one is equal when three bits or fewer differ, and of the other 48 bits at least one
of four 12-bit parts. Each shard is a BK-tree (children keyed by their Hamming distance to the
parent); a search follows only edges within the radius, and passes over subtrees that already lie
wholly in the component of the fingerprint searched for, so a dense group costs no square of its
size. A task returns a spanning forest of its links. Forests are joined by alternating large-star
and small-star steps on tables.

A shard of up to CELL fingerprints is searched where its tree is built. A larger one is cut into
chunks, each with a tree; trees are then broadcast, as files in the shared folder, to the tasks that
search them for the fingerprints of another chunk. So a tree is bounded in size, however dense a
shard, and no fingerprint passes through the driver.

Three bits are strict. ``near_sets`` finds what a similarity of 0.8 asks for: sets of shingles have
fingerprints of 48 words, each of whose 192 blocks of 16 bits is a shard, and the trees of shards
link what differs in up to 53 of 168 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, get, lean, put, save, small, work_dir

SEED = 42
BLOCKS, PARTS = 4, 4
#: Fingerprints of a tree at most; shingles hashed at once.
CELL, PART = 8192, 1 << 16
#: Words of a wide fingerprint, and the radius of trees that compare 168 bits of it: at a Jaccard
#: similarity of 0.8 a bit is equal with probability 0.8485, so that a pair shares no shard, or is
#: beyond the radius, in less than one case in a million. One in SAMPLE sets tells which shards are dense.
WORDS, NEAR, SAMPLE = 48, 53, 16
#: Sets of up to SHORT shingles have MORE words, as their bits tie more often (0.8359 for four of five).
SHORT, MORE = 32, 64
_rng = np.random.default_rng(SEED)
#: A bit of a shingle's vote is worth 1 (first row) or 2: with four levels, small sets seldom tie.
TIMES = _rng.integers(0, 1 << 63, (2, MORE), np.uint64) * np.uint64(2) + np.uint64(1)
MIX, HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes of all shingles, repeats included.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words than a shingle has are
    one shingle; without words the fingerprint is 0. A long text is hashed in parts.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    size = min(shingle, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n, counts = len(words) - size + 1, np.zeros(64, np.int64)
    for i in range(0, n, PART):
        part = np.fromiter((h(joined[a : b - 1], SEED) for a, b in zip(starts[i : i + PART], starts[i + size :])), "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long); one row for each row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(work), "doc_id long, fp long")


class Links:
    """Union-find over the fingerprints that have links."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = self.parent.setdefault(min(a, b), min(a, b))


class BKTree:
    """Inserting a value links it to all values within the radius.

    mixed: whether the subtree of a node may hold several components; where it does not, the
    node's own component stands for all. The marks are set anew each time the tree has doubled.
    """

    def __init__(self, radius: int, links: Links):
        self.radius, self.links = radius, links
        self.values: list[int] = []
        self.parents: list[int] = []
        self.children: list[dict[int, int]] = []
        self.mixed: list[bool] = []
        self.refresh = 64

    def search(self, x: int) -> None:
        if not self.values:
            return
        values, children, mixed, r = self.values, self.children, self.mixed, self.radius
        find, own = self.links.find, self.links.find(x)
        stack = [0]
        while stack:
            node = stack.pop()
            v = values[node]
            if not mixed[node] and find(v) == own:
                continue
            d = (v ^ x).bit_count()
            if d <= r and find(v) != own:
                self.links.join(v, x)
                own = find(x)
            for edge, child in children[node].items():
                if d - r <= edge <= d + r:
                    stack.append(child)

    def insert(self, x: int) -> None:
        self.search(x)
        find = self.links.find
        own, node, new = find(x), 0, len(self.values)
        while new:
            v = self.values[node]
            if not self.mixed[node] and find(v) != own:
                self.mixed[node] = True
            d = (v ^ x).bit_count()
            if d not in self.children[node]:
                break
            node = self.children[node][d]
        self.hang(x, node)
        if len(self.values) == self.refresh:
            self.refresh *= 2
            self.mark()

    def hang(self, x: int, parent: int) -> None:
        new = len(self.values)
        if new:
            self.children[parent][(self.values[parent] ^ x).bit_count()] = new
        self.values.append(x)
        self.parents.append(parent)
        self.children.append({})
        self.mixed.append(False)

    def mark(self) -> None:
        find = self.links.find
        for i in range(len(self.values) - 1, -1, -1):  # children come after their parent
            own = find(self.values[i])
            self.mixed[i] = any(self.mixed[c] or find(self.values[c]) != own for c in self.children[i].values())

    def dump(self) -> bytes:
        """Values, their parents' places and the roots of their components."""
        roots = [self.links.find(v) for v in self.values]
        return np.array([self.values, self.parents, roots], "<u8").tobytes()

    @classmethod
    def load(cls, data: bytes, radius: int, links: Links) -> BKTree:
        tree = cls(radius, links)
        for x, parent, root in np.frombuffer(data, "<u8").reshape(3, -1).T.tolist():
            tree.hang(x, parent)
            links.join(x, root)
        tree.mark()
        return tree


def shard_keys(fp: Column) -> Column:
    """For each choice of a block and a part of the rest: which choice, and their bits."""
    keys = []
    for i in range(BLOCKS):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        above = F.shiftleft(F.shiftrightunsigned(fp, 16 * (i + 1)), 16 * i) if i + 1 < BLOCKS else F.lit(0).cast("long")
        rest = above.bitwiseOR(fp.bitwiseAND(F.lit((1 << 16 * i) - 1)))
        for j in range(PARTS):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((i * PARTS + j) << 28) + F.shiftleft(block, 12) + part)
    return F.array(*keys)


def forest(links: Links) -> Iterator[pa.RecordBatch]:
    linked = list(links.parent)
    for i in range(0, len(linked), 1 << 16):
        part = linked[i : i + (1 << 16)]
        roots = [links.find(x) for x in part]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in (part, roots)], ["u", "v"])


def build_trees(shards: DataFrame, radius: int, folder: str) -> DataFrame:
    """Links within each chunk of a shard (u, v), and where the tree of one of several chunks is (key,
    chunk, file). Input: key, chunk, chunks, fp."""
    kinds = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("file", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, last = Links(), None
        held: list[int] = []
        files: list[tuple[int, int, str]] = []

        def close() -> None:
            if len(held) > 1 or (held and last[2] > 1):
                tree = BKTree(radius, links)
                for x in held:
                    tree.insert(x)
                if last[2] > 1:
                    data = tree.dump()
                    put(uri := f"{folder}/trees/{last[0]}-{last[1]}-{xxhash.xxh3_64_hexdigest(data)}", data)
                    files.append((last[0], last[1], uri))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            key, chunk, chunks, fp = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if last is None or (key[a], chunk[a]) != last[:2]:
                    close()
                    last = int(key[a]), int(chunk[a]), int(chunks[a])
                held.extend(fp[a:b].view(np.uint64).tolist())
        close()
        for part in forest(links):
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.nulls(part.num_rows, kind) for kind in kinds.types[2:])], schema=kinds)
        if files:
            where = [pa.array(c, kind) for c, kind in zip(zip(*files), kinds.types[2:])]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(files), pa.int64()), pa.nulls(len(files), pa.int64()), *where], schema=kinds)

    dealt = shards.select("key", "chunk", "chunks", "fp").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "fp")
    return dealt.mapInArrow(lean(work), "u long, v long, key long, chunk int, file string")


def search_trees(pairs: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between the trees in two files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree_file, other_file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                links = Links()
                tree = BKTree.load(get(tree_file), radius, links)
                values, _, roots = np.frombuffer(get(other_file), "<u8").reshape(3, -1).tolist()
                for x, root in zip(values, roots):
                    links.join(x, root)
                for x in values:
                    tree.search(x)
                yield from forest(links)

    return pairs.select("tree", "other").mapInArrow(lean(work), "u long, v long")


def link_shards(fps: DataFrame, radius: int, folder: str | None = None) -> DataFrame:
    """(u, v): spanning forests of the links within shards. radius: at most three."""
    if radius >= BLOCKS:
        raise ValueError("the shards find links of up to three bits")
    folder = folder or work_dir(fps.sparkSession, "shards")
    keyed = fps.select(F.explode(shard_keys(F.col("fp"))).alias("key"), "fp")
    dense = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    dense = save(dense.select("key", F.ceil(F.col("n") / CELL).cast("int").alias("chunks")), f"{folder}/dense")
    shards = keyed.join(small(dense), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    found = save(build_trees(shards.withColumn("chunk", F.expr("cast(pmod(xxhash64(fp), chunks) as int)")), radius, folder), f"{folder}/found")
    links, trees = found.where("u != v").select("u", "v"), found.where("file is not null").select("key", "chunk", "file")
    if dense.isEmpty():
        return links
    a, b = trees.select("key", F.col("chunk").alias("a"), F.col("file").alias("tree")), trees.select("key", F.col("chunk").alias("b"), F.col("file").alias("other"))
    pairs = save(a.join(b, "key").where("a < b").select("tree", "other"), f"{folder}/pairs")  # of chunks, each of up to about CELL
    return links.unionByName(search_trees(pairs.repartition(max(1, pairs.count())), radius).where("u != v"))


def add_bits(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of the bits at each place, in binary: the words of worth 1, 2, 4, .. ``rows[j]`` has rows of
    words worth 2**j. Full adders take three rows at a time."""
    sums, j = [], 0
    while j < len(rows):
        left, carries = rows[j], []
        while len(left) > 1:
            n = max(1, len(left) // 3)
            a, b = left[:n], left[n : 2 * n]
            c = left[2 * n : 3 * n] if len(left) > 2 else np.zeros_like(a)
            x = a ^ b
            carries.append((a & b) | (x & c))
            left = np.concatenate((x ^ c, left[3 * n :]))
        if carries:
            if j + 1 == len(rows):
                rows = [*rows, left[:0]]
            rows[j + 1] = np.concatenate((rows[j + 1], *carries))
        sums.append(left)
        j += 1
    return sums


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """WORDS (or MORE) words for a set of hashes of shingles; a bit is 1 if its votes are over half of all.
    0 for an empty set. A long set is added up in parts."""
    size = MORE if len(found) <= SHORT else WORDS
    times = TIMES[:, :size].ravel()
    sums: list[np.ndarray] = []
    for i in range(0, len(found), 1024):
        votes = found[i : i + 1024, None] * times
        votes ^= votes >> HALF
        votes *= MIX
        votes ^= votes >> HALF
        new = [votes[:, :size], votes[:, size:]]
        sums = add_bits([np.concatenate(new[j : j + 1] + sums[j : j + 1]) for j in range(max(2, len(sums)))])
    most = 3 * len(found) // 2
    over, level = np.zeros(size, np.uint64), np.full(size, ~np.uint64(0))
    for j in range(max(len(sums), most.bit_length()) - 1, -1, -1):
        bits = sums[j][0] if j < len(sums) and len(sums[j]) else np.zeros(size, np.uint64)
        if most >> j & 1:
            level &= bits
        else:
            over |= level & bits
            level &= ~bits
    return over


def shard_rows(sets: DataFrame) -> DataFrame:
    """head, a, b for each block of the words of each row: 24 bits that name the shard (which block, and
    its bits), then the 168 that are compared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            sizes, flat = np.diff(words.offsets.to_numpy()), words.flatten().to_numpy().view(np.uint64)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                at = starts[sizes == size]
                blocks = np.arange(4 * size, dtype=np.uint64) << np.uint64(16)
                for i in range(0, len(at), 256):
                    part = flat[at[i : i + 256, None] + np.arange(size)]
                    head = (blocks | part.view("<u2").astype(np.uint64)) << np.uint64(40) | (part[:, 2:3] & np.uint64((1 << 40) - 1))
                    ends = [np.repeat(part[:, k], 4 * size) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (head.ravel(), *ends)], ["head", "a", "b"])

    return sets.select("words").mapInArrow(lean(work), "head long, a long, b long")


def search_shards(dealt: DataFrame) -> DataFrame:
    """(ua, ub, va, vb): links within each shard and chunk, as two words of each end. Input: head, a, b,
    chunk, sorted; the top 24 bits of head are the shard, the others are compared, as a and b are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, held, last = Links(), [], None

        def close() -> None:
            if len(held) > 1:
                tree = BKTree(NEAR, links)
                for x in dict.fromkeys(held):
                    tree.insert(x)

        def found() -> Iterator[pa.RecordBatch]:
            ends = list(links.parent)
            for i in range(0, len(ends), 1 << 16):
                part = ends[i : i + (1 << 16)]
                roots = [links.find(x) for x in part]
                words = [[x >> s & (1 << 64) - 1 for x in side] for side in (part, roots) for s in (64, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(w, np.uint64).view(np.int64)) for w in words], ["ua", "ub", "va", "vb"])
            links.parent.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            head, a, b = (batch.column(k).to_numpy().view(np.uint64) for k in range(3))
            shard = (head >> np.uint64(40)) << np.uint64(32) | batch.column(3).to_numpy().astype(np.uint64)
            prints = [x << 128 | y << 64 | z for x, y, z in zip((head & np.uint64((1 << 40) - 1)).tolist(), a.tolist(), b.tolist())]
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for i, j in zip(cuts, cuts[1:]):
                if shard[i] != last:
                    close()
                    held, last = [], shard[i]
                held += prints[i:j]
            if len(links.parent) > 1 << 14:
                yield from found()
        close()
        yield from found()

    return dealt.select("head", "a", "b", "chunk").mapInArrow(lean(work), "ua long, ub long, va long, vb long")


def print_id(a: Column, b: Column) -> Column:
    """Names a wide fingerprint by its first two words."""
    return F.xxhash64(a, b)


def near_sets(sets: DataFrame, folder: str) -> DataFrame:
    """(u, v), by ``print_id``: spanning forests of the links of wide fingerprints within shards. Input:
    words. A shard beyond CELL is dealt as pairs of its chunks."""
    keyed, shard = shard_rows(sets), F.shiftrightunsigned("head", 40)
    dense = shard_rows(sets.where(F.pmod(print_id(F.col("words")[0], F.col("words")[1]), F.lit(SAMPLE)) == 0))
    dense = dense.groupBy(shard.alias("shard")).agg((F.count("*") * SAMPLE).alias("n")).where(F.col("n") > CELL)
    dense = save(dense.select("shard", F.ceil(F.col("n") / CELL).cast("int").alias("chunks")), f"{folder}/dense")
    if dense.isEmpty():
        dealt = keyed.withColumn("chunk", F.lit(0))
    else:
        told = keyed.join(small(dense), shard == F.col("shard"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        told = told.withColumn("own", F.expr("cast(pmod(xxhash64(a, b), chunks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        dealt = told.withColumn("chunk", F.least("own", "other") * 65536 + F.greatest("own", "other"))
    dealt = dealt.select("head", "a", "b", "chunk").repartition(shard, "chunk").sortWithinPartitions(shard, "chunk")
    return search_shards(dealt).select(print_id(F.col("ua"), F.col("ub")).alias("u"), print_id(F.col("va"), F.col("vb")).alias("v")).where("u != v")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(u, v): each node but the smallest of its component, and that smallest.

    Alternates large-star and small-star steps, each a min over neighbours and a join, until a
    round changes nothing. Every round is a written table.
    """
    edges, seen, n = save(edges.distinct(), f"{folder}/edges-0"), None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges
        seen, n = now, n + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = save(large, f"{folder}/large-{n}")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        stars = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = save(stars.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/edges-{n}")
        for old in (f"large-{n}", f"edges-{n - 1}"):
            drop(edges.sparkSession, f"{folder}/{old}")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of up to ``radius`` bits reach.

    One row for each row of ``docs``, in any order. Null, empty and blank texts share fingerprint 0.
    Rows with a null id take part; a component of null ids alone has a null component_id. Rows with
    equal texts have equal components; a text is hashed whole, one at a time. An empty table gives
    no rows; other columns are not read.
    """
    folder = work_dir(docs.sparkSession, "simhash")
    of_docs = save(fingerprints(docs, shingle, id_col, text_col), f"{folder}/fingerprints")
    fps = save(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/distinct")
    roots = components(link_shards(fps, radius, folder), folder)
    rooted = fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    rooted = save(rooted, f"{folder}/rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = save(rooted.join(least, "root").select("fp", "component_id"), f"{folder}/labels")
    for done in ("distinct", "dense", "found", "trees", "pairs", "rooted"):
        drop(docs.sparkSession, f"{folder}/{done}")
    return of_docs.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_fp(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
