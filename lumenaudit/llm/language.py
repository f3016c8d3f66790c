"""Language ID by word-first backoff.

A word that was seen in training scores its log frequency in each language. Any other word falls
back to character n-grams, the longest known ones first, down to single letters. The model is a
sorted array of hashes for words and one for n-grams of each length, with a row of logs for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, release

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
NONE = "und"
#: Characters of texts whose words are looked up at once.
CHUNK_CHARS = 1 << 20


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word with a space at both ends; single letters without them."""
    padded = word if n == 1 else f" {word} "
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


def hashed(texts: list[str]) -> np.ndarray:
    """As Spark's ``xxhash64`` gives it."""
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), 42) for t in texts), np.uint64, len(texts))


class Keys:
    """Distinct words or n-grams, by their hash; each has a row."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __len__(self) -> int:
        return len(self.keys)

    def rows(self, texts: list[str]) -> np.ndarray:
        """The row of each text, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(texts), -1)
        wanted = hashed(texts)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def __contains__(self, text: str) -> bool:
        return bool(self.rows([text])[0] >= 0)

    def __getitem__(self, text: str) -> int:
        return int(self.rows([text])[0])


class WordFirst:
    """Keys and logs of each language, for words (level 0) and n-grams of lengths 1 to LONGEST."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        """counts: (language, word, count)."""
        self.langs = sorted({c[0] for c in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        sums: list[dict[str, list[int]]] = [{} for _ in range(LONGEST + 1)]
        for lang, word, n in counts:
            for size, level in enumerate(sums):
                for g in [word] if size == 0 else grams(word, size):
                    level.setdefault(g, [0] * len(self.langs))[at[lang]] += n
        self.set_levels([(hashed(list(x)), np.array(list(x.values()), np.float64)) for x in sums])

    @classmethod
    def of(cls, langs: list[str], level: np.ndarray, key: np.ndarray, lang: np.ndarray, n: np.ndarray) -> WordFirst:
        """From one row for each key of a level and each language that has it."""
        model = cls([])
        model.langs = langs
        levels = []
        for size in range(LONGEST + 1):
            own = level == size
            keys, row = np.unique(key[own].view(np.uint64), return_inverse=True)
            sums = np.zeros((len(keys), len(langs)))
            np.add.at(sums, (row, lang[own]), n[own])
            levels.append((keys, sums))
        model.set_levels(levels)
        return model

    def set_levels(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.levels, self.logs = [], []
        for keys, sums in levels:
            order = np.argsort(keys)
            smooth = sums.reshape(len(keys), len(self.langs))[order] + 0.5
            self.levels.append(Keys(keys[order]))
            self.logs.append(np.log(smooth / smooth.sum(0)).astype(np.float32) if len(keys) else smooth.astype(np.float32))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log frequency of each word in each language, and whether the word or one of its longest
        n-grams was seen. Letters that were never seen have zeros."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        rows = self.levels[0].rows(words)
        out[rows >= 0] = self.logs[0][rows[rows >= 0]]
        known, left = rows >= 0, np.flatnonzero(rows < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            parts = [grams(words[i], n) for i in left]
            sizes = np.array(list(map(len, parts)))
            rows = self.levels[n].rows([g for p in parts for g in p])
            starts = np.cumsum(sizes) - sizes
            seen = np.add.reduceat((rows >= 0).astype(np.int64), starts)
            found = seen > 0
            if found.any():
                logs = np.where(rows[:, None] >= 0, self.logs[n][np.maximum(rows, 0)], 0).astype(np.float64)
                out[left[found]] = (np.add.reduceat(logs, starts, axis=0)[found] / seen[found, None]).astype(np.float32)
            if n == LONGEST:
                known[left[found]] = True
            left = left[~found]
        return out, known

    def word(self, word: str) -> np.ndarray:
        """Log frequency in each language."""
        return self.words([word])[0][0]


class Scorer:
    """Keeps the scores of words met before; the cache starts anew when full."""

    def __init__(self, model: WordFirst, most: int = 150_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, max(1, len(self.model.langs))), np.float32)
        self.known = np.zeros(1024, bool)

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the likelihood of all words."""
        return self.judge([text])[0][:2]

    def learn(self, words: list[str]) -> None:
        first, last = len(self.at), len(self.at) + len(words)
        while last > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.known = np.concatenate((self.known, np.zeros_like(self.known)))
        self.table[first:last], self.known[first:last] = self.model.words(words)
        self.at.update(zip(words, range(first, last)))

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Of each text the language, its share of the likelihood, and the share of words that the
        model knows. Of languages with equal likelihood the first by name is taken."""
        if len(self.at) > self.most:
            self.clear()
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self.at}
        if new and self.model.langs:
            self.learn(sorted(new))
        return [self.judge_words(words) for words in split]

    def judge_words(self, words: list[str]) -> tuple[str, float, float]:
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return NONE, 0.0, 0.0
        places = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        total = self.table[places].sum(0, dtype=np.float64)
        share = np.exp(total - total.max())
        best = int(np.argmax(share))
        return self.model.langs[best], float(share[best] / share.sum()), float(self.known[places].mean())


def chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in order, about CHUNK_CHARS at once."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def sample(labelled: DataFrame, max_docs: int, text_col: str, lang_col: str) -> tuple[list[str], DataFrame]:
    """Languages, and (lang, text): of each language all distinct texts, or about ``max_docs`` by hash."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count_distinct("hash").alias("n")).collect()}
    below = F.lit(False)
    for lang, n in sizes.items():
        limit = (1 << 64) * max_docs // n - (1 << 63) if n > max_docs else (1 << 63) - 1
        below = below | ((F.col("lang") == lang) & (F.col("hash") <= F.lit(limit)))
    return sorted(sizes), rows.where(below).groupBy("lang", "hash").agg(F.first("text").alias("text"))


def train(labelled: DataFrame, max_docs: int = 2_000, text_col: str = "text", lang_col: str = "lang") -> WordFirst:
    """Learns from labelled rows: all words, and all their n-grams, of at most about ``max_docs``
    distinct texts of each language, chosen by a hash of the text.

    Rows without a text or a language are passed over, a text that a language repeats is learned
    once, and texts without a letter teach nothing. Without labelled rows the model has no language.
    What reaches the driver is bounded by the sample. Counts are of whole texts.
    """
    langs, rows = sample(labelled, max_docs, text_col, lang_col)
    if not langs:
        return WordFirst([])
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    words = rows.select(number.alias("lang"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))

    def of_size(n: int) -> Column:
        text = F.col("word") if n == 1 else padded
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("level"), F.xxhash64(F.substring(text, i, F.lit(n))).alias("key")))

    own = F.array(F.struct(F.lit(0).alias("level"), F.xxhash64("word").alias("key")))
    all_grams = counts.select("lang", "n", F.explode(F.concat(own, *map(of_size, range(1, LONGEST + 1)))).alias("g"))
    sums = all_grams.groupBy("g.level", "g.key", "lang").agg(F.sum("n").alias("n")).toArrow()
    return WordFirst.of(langs, *(sums.column(c).to_numpy() for c in ("level", "key", "lang", "n")))


def predict(spark, model: WordFirst, text: Column) -> Column:
    """struct(lang, score, known): a learned language, or ``und``, 0 and 0 where the text is null or
    has no letter, or no language was learned. A text whose letters are all unknown gets the first
    language and an even share, and so does one for which all languages are as likely. Whole texts
    are judged, in memory of the words of one text. known: the share of words of which the model
    knows the whole or a longest n-gram."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample that was learned from

    @F.arrow_udf("lang string, score double, known double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = Scorer(shared.value)
        for texts in batches:
            found = [row for part in chunks(texts) for row in score.judge(part)]
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 3, kinds)], ["lang", "score", "known"])
        release()

    return judge(text.cast("string"))


def held_out(id_col: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether the CRC-32 of the id as text falls in the fold; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def least_known(labelled: DataFrame, model: WordFirst, max_docs: int = 1_000, text_col: str = "text", lang_col: str = "lang") -> float:
    """Share of known words below which a text is in no learned language: half of what 99 in 100
    labelled texts reach. ``labelled``: rows not learned from, of which about ``max_docs`` distinct
    texts of each language are taken by a hash. 0 without such rows."""
    _, rows = sample(labelled.where(F.col(text_col).rlike(r"\p{L}")), max_docs, text_col, lang_col)
    known = predict(labelled.sparkSession, model, F.col("text"))["known"]
    return (rows.select(known.alias("known")).agg(F.percentile_approx("known", 0.01)).first()[0] or 0.0) / 2


def language_id(docs: DataFrame, model: WordFirst, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``; repeated rows and null ids included. See
    ``predict`` for nulls, texts without letters and ties. An empty table gives no rows; other
    columns are not read."""
    found = docs.select(F.col(id_col).alias("doc_id"), predict(docs.sparkSession, model, F.col(text_col)).alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
