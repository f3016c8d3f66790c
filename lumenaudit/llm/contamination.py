"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A document is first projected on the shingles of the benchmark, which leaves every containment as
it is and most documents empty. Projected sets and items are both partitioned by size, in powers of
two. For each pair of partitions the containment threshold becomes a Jaccard threshold, and items
are found by as many single-row MinHash bands as miss an item over it with a chance under one in a
million; where no signature is long enough for that, items are found by any shingle shared.
Candidates are verified by exact containment of shingles.

A benchmark of a proven small size is broadcast as one index. For any larger one, texts are held
against a bitmap of its shingles, of a fixed size, and projected sets that are not empty are joined
with the items' bands on tables; each text is cut into shingles once, whatever the benchmark's size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, free_name, lean, release, save, small, work_dir

WORD = re.compile(r"[^\W_]+")
HASHES, MISSED = 128, 1e-6
PRIME = (1 << 61) - 1
#: A benchmark of so many items and characters at most is broadcast as one index.
ITEMS, ITEM_CHARS = 5_000, 8 << 20
#: Size of the bitmap that stands for a larger benchmark: 2 ** BITS bits, 32 MB.
BITS = 28
HITS = "array<struct<item_id:bigint,shared:int,n_item:int>>"


def shingles(text: str | None, size: int) -> list[tuple[str, ...]]:
    """Of lower-cased runs of letters and digits; fewer words than ``size`` are one shingle."""
    words = WORD.findall((text or "").lower())
    if len(words) < size:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(size))))


def size_class(n: int) -> int:
    """Sizes over 2 ** (c - 1) up to 2 ** c are class c."""
    return (n - 1).bit_length()


def bands(threshold: float, largest: int, item: int) -> int:
    """Single-row bands for sets of up to ``largest`` shingles and items of ``item`` or more; 0: none
    is enough."""
    jaccard = threshold * item / (largest + item * (1 - threshold))
    if jaccard >= 1:
        return 1
    n = math.ceil(math.log(MISSED) / math.log(1 - jaccard))
    return n if n <= HASHES else 0


class Searcher:
    """Index over items: (item_id, text)."""

    def __init__(self, items: list[tuple[int, str | None]], size: int, threshold: float, seed: int = 1):
        self.size, self.threshold = size, threshold
        sets = [(item, set(shingles(text, size))) for item, text in items]
        self.items = [item for item, s in sets if s]
        self.universe: dict[tuple[str, ...], int] = {}
        self.sets = [frozenset(self.universe.setdefault(g, len(self.universe)) for g in sorted(s)) for _, s in sets if s]
        self.vocabulary = {w for g in self.universe for w in g}
        self.short = sorted({len(g) for g in self.universe if len(g) < size})
        rng = np.random.default_rng(seed)
        a, b = (rng.integers(1, PRIME, (HASHES, 1)).astype(object) for _ in range(2))
        n = len(self.universe)
        mixed = (a * np.arange(1, n + 1).astype(object) + b) % PRIME if n else np.zeros((HASHES, 0))
        self.hashes = mixed.astype(np.uint64)  # of each shingle of the benchmark
        #: Of each class of items: the least size, a table for each band, and who holds a shingle.
        self.classes: dict[int, tuple[int, list[dict[int, list[int]]], dict[int, list[int]]]] = {}
        for i, s in enumerate(self.sets):
            least, tables, holders = self.classes.get(size_class(len(s))) or (len(s), [{} for _ in range(HASHES)], {})
            self.classes[size_class(len(s))] = min(least, len(s)), tables, holders
            for band, h in enumerate(self.signature(s).tolist()):
                tables[band].setdefault(h, []).append(i)
            for g in s:
                holders.setdefault(g, []).append(i)

    def signature(self, s) -> np.ndarray:
        return self.hashes[:, list(s)].min(1)

    def project(self, text: str | None) -> set[int]:
        """The shingles of the benchmark that the whole text holds."""
        words = WORD.findall((text or "").lower())
        known = self.vocabulary
        found: set[int] = set()
        run: list[str] = []
        for w in [*words, None]:
            if w in known:
                run.append(w)
                continue
            for k in [self.size, *self.short]:
                if len(run) >= k:
                    found.update(g for i in range(len(run) - k + 1) if (g := self.universe.get(tuple(run[i : i + k]))) is not None)
            run = []
        return found

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shingles shared, shingles of the item) of items contained in the text, by item."""
        held = self.project(text)
        if not held:
            return []
        largest, signature = 1 << size_class(len(held)), None
        close: set[int] = set()
        for least, tables, holders in self.classes.values():
            if len(held) < self.threshold * least:
                continue
            n = bands(self.threshold, largest, least)
            if n and signature is None:
                signature = self.signature(held).tolist()
            for band in range(n):
                close.update(tables[band].get(signature[band], ()))
            if not n:
                close.update(i for g in held for i in holders.get(g, ()))
        out = []
        for i in close:
            shared = len(self.sets[i] & held)
            if shared >= self.threshold * len(self.sets[i]):
                out.append((self.items[i], shared, len(self.sets[i])))
        return sorted(out)


def found_items(spark, text: Column, items: list[tuple[int, str | None]], size: int = 5, threshold: float = 0.8) -> Column:
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(Searcher(items, size, threshold))  # ITEMS and ITEM_CHARS at most

    @F.arrow_udf(HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher = shared.value
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int32()), ("n_item", pa.int32())]))
        for texts in batches:
            yield pa.array([searcher.search(t.as_py()) for t in texts], kind)
        release()

    return find(text.cast("string"))


def gram_hashes(words: list[str], size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    parts = [w.encode("utf-8", "replace") for w in words]
    joined, h = b" ".join(parts), xxhash.xxh3_64_intdigest
    starts = [0, *accumulate(len(w) + 1 for w in parts)]
    return np.fromiter((h(joined[a : b - 1]) for a, b in zip(starts, starts[size:])), np.uint64, len(words) - size + 1)


_rng = np.random.default_rng(1)
TIMES = _rng.integers(0, 1 << 63, (HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _rng.integers(0, 1 << 63, (HASHES, 1), np.uint64)


def signature_of(grams: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 1024):
        x = grams[i : i + 1024] * TIMES + PLUS
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(1))
    return least


def as_longs(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.view(np.int64) for v in values], pa.list_(pa.int64()))


def item_sets(items: DataFrame, size: int) -> DataFrame:
    """item_id, words (of a shingle), grams: the distinct shingles of each item that has any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall((text or "").lower())
                if words:
                    rows.append((item, min(size, len(words)), np.unique(gram_hashes(words, min(size, len(words))))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), as_longs([r[2] for r in rows])], ["item_id", "words", "grams"])

    return items.mapInArrow(lean(work), "item_id long, words int, grams array<long>")


def bitmap_of(grams: DataFrame) -> np.ndarray:
    """One bit for each shingle, by the high bits of its hash. Its size is fixed."""
    place = F.shiftrightunsigned("gram", 64 - BITS)
    cells = grams.groupBy(F.shiftright(place, 6).cast("int").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return bitmap


def projected(texts: DataFrame, bitmap, lengths: list[int], size: int) -> DataFrame:
    """key, node (a hash of the set), grams: shingles of each text that are in the bitmap, if any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, keys, nodes, sets = whole.slice(at, 512), [], [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = WORD.findall((text or "").lower())
                    grams = np.concatenate([gram_hashes(words, k) for k in {size, *lengths}])
                    place = grams >> np.uint64(64 - BITS)
                    grams = np.unique(grams[(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)])
                    if len(grams):
                        keys.append(key)
                        nodes.append(xxhash.xxh3_64_intdigest(grams.tobytes()))
                        sets.append(grams)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.array(nodes, np.uint64).view(np.int64)), as_longs(sets)], ["key", "node", "grams"])

    return texts.mapInArrow(lean(work), "key binary, node long, grams array<long>")


ASK = "who long, class int, band int, value long"


def band_rows(sets: DataFrame, threshold: float, classes: dict[int, int] | None) -> DataFrame:
    """Where a set (who, grams) meets others: (class of items, band, value), band -1 for a shingle.

    classes: of a document the least size of items in each class; None: the sets are items, which
    are in all bands of their class.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asks(grams: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
            """(class, first band, values); -1 where all values are shingles."""
            signature = signature_of(grams)
            if classes is None:
                yield size_class(len(grams)), 0, signature
                yield size_class(len(grams)), -1, grams
                return
            for kind, least in classes.items():
                if len(grams) >= threshold * least:
                    n = bands(threshold, 1 << size_class(len(grams)), least)
                    yield kind, 0 if n else -1, signature[:n] if n else grams

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(at, 256), []
                for who, grams in zip(batch.column(0).to_pylist(), batch.column(1)):
                    rows += [(who, kind, first, values) for kind, first, values in asks(grams.values.to_numpy().view(np.uint64))]
                if not rows:
                    continue
                sizes = [len(values) for *_, values in rows]
                band = np.concatenate([np.full(n, -1) if first < 0 else np.arange(n) for (_, _, first, _), n in zip(rows, sizes)])
                who, kind = (np.repeat([r[i] for r in rows], sizes) for i in (0, 1))
                values = np.concatenate([values for *_, values in rows])
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(kind, pa.int32()), pa.array(band, pa.int32()), pa.array(values.view(np.int64))], ["who", "class", "band", "value"])

    return sets.mapInArrow(lean(work), ASK)


def routed_hits(texts: DataFrame, items: DataFrame, size: int, threshold: float, folder: str) -> DataFrame:
    """key, hits of each text (key, text) that contains an item; on tables, for any size of benchmark.

    Texts with equal projected sets are searched for once. Shingles are told apart by 64-bit hashes.
    """
    spark = texts.sparkSession
    sets = save(item_sets(items, size), f"{folder}/items")
    classes: dict[int, int] = {}
    for n, _ in sets.groupBy(F.size("grams").alias("n")).count().collect():  # distinct sizes of items
        classes[size_class(n)] = min(n, classes.get(size_class(n), n))
    lengths = [r.words for r in sets.select("words").distinct().collect()]  # size at most
    bitmap = spark.sparkContext.broadcast(bitmap_of(sets.select(F.explode("grams").alias("gram"))))
    found = save(projected(texts, bitmap, lengths, size), f"{folder}/projected")
    nodes = save(found.groupBy("node").agg(F.first("grams").alias("held")), f"{folder}/nodes")
    asked = band_rows(nodes.select("node", "held"), threshold, classes).withColumnRenamed("who", "node")
    there = save(band_rows(sets.select("item_id", "grams"), threshold, None).withColumnRenamed("who", "item_id"), f"{folder}/bands")
    close = asked.join(small(there), ["class", "band", "value"]).select("node", "item_id").distinct()
    both = close.join(nodes, "node").join(small(sets.select("item_id", "grams")), "item_id")
    shared = F.size(F.array_intersect("held", "grams"))
    hit = F.struct("item_id", shared.alias("shared"), F.size("grams").alias("n_item"))
    of_node = both.where(shared >= threshold * F.size("grams")).groupBy("node").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return save(found.select("key", "node").distinct().join(of_node, "node").select("key", "hits"), f"{folder}/hits")


def with_hits(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, block: int = ITEMS, text_col: str = "text", out: str = "benchmark_hits", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with an array of the items that each text contains, empty where there are none.

    Null and empty texts contain nothing, and items without a word are contained nowhere. Texts are
    searched whole, in memory of the words of one text. Every row of ``docs``, repeated ones too, and
    all its columns stay; a column named ``out`` is replaced. Repeated items count once; an item_id
    with several texts is found by each. Empty tables give empty arrays or no rows. block: the most
    items that are broadcast; beyond it or ITEM_CHARS characters, hits are found on tables.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n <= block and chars <= ITEM_CHARS:
        return docs.withColumn(out, found_items(spark, F.col(text_col), [tuple(r) for r in items.collect()], size, threshold))
    key = free_name(docs, "text_key")
    of_text = F.unhex(F.md5(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")))
    keyed = docs.withColumn(key, of_text)
    texts = keyed.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    hits = routed_hits(texts, items, size, threshold, work_dir(spark, "contamination"))
    hits = small(hits).select(F.col("key").alias(key), F.col("hits").alias(out))
    return keyed.drop(out).join(hits, key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(HITS))).drop(key)


def contained(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, shared, n_item, containment): a row for each item of which the text holds at
    least ``threshold`` of the distinct shingles. Repeated rows give repeated results; see ``with_hits``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = with_hits(rows, benchmark, size, threshold, block).select("doc_id", F.explode("benchmark_hits").alias("hit"))
    return hits.select("doc_id", "hit.item_id", "hit.shared", "hit.n_item", (F.col("hit.shared") / F.col("hit.n_item")).alias("containment"))


def oracle(documents: str = "documents", benchmark: str = "benchmark", size: int = 5, threshold: float = 0.8) -> str:
    """The exact result in SQL, without MinHash."""

    def sets(table: str, key: str) -> str:
        words = f"SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}"
        gram = f"unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END)"
        return f"SELECT DISTINCT {key}, {gram} AS g FROM ({words})"

    return f"""WITH i AS ({sets(benchmark, "item_id")}), d AS ({sets(documents, "doc_id")}), n AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_item FROM i GROUP BY item_id),
s AS (SELECT d.doc_id, i.item_id, CAST(count(*) AS INTEGER) AS shared FROM d JOIN i ON d.g = i.g GROUP BY d.doc_id, i.item_id)
SELECT s.doc_id, s.item_id, s.shared, n.n_item, s.shared / n.n_item AS containment FROM s JOIN n ON s.item_id = n.item_id WHERE s.shared >= {threshold} * n.n_item"""
