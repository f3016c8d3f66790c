"""Katz scores against a plain version that holds all counts in dictionaries."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenaudit.llm import katz

SCHEMA = "doc_id long, text string"
LAST = katz.LAST


def words_of(text):
    out = []
    for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" "):
        if w:
            out.append(w)
    return [*out, "</s>"]


def plain_factors(values):
    """Factors of counts 1 .. LAST, from the counts alone: Katz's formula on raw counts of counts, else
    on their log-linear fit, else a fixed part of each count."""
    n = [sum(v == r for v in values) for r in range(1, LAST + 2)]

    def by_formula(n):
        if 0 in n[:LAST] or (mu := (LAST + 1) * n[LAST] / n[0]) >= 1:
            return None
        d = [((r + 1) * n[r] / (r * n[r - 1]) - mu) / (1 - mu) for r in range(1, LAST + 1)]
        return d if all(0 < x < 1 for x in d) else None

    points = [(math.log(r), math.log(v)) for r, v in enumerate(n, 1) if v]
    slope = 0.0
    if len(points) > 1:
        mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
        slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    found = by_formula(n) or by_formula([r**slope for r in range(1, LAST + 2)])
    if found:
        return dict(enumerate(found, 1))
    part = min(n[0] / (n[0] + 2 * n[1]), 0.9) if n[0] else 0.5
    return {r: (r - part) / r for r in range(1, LAST + 1)}


class Plain:
    def __init__(self, docs, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for text in docs:
            ws = words_of(text)
            for n in range(1, order + 1):
                padded = ["<s>"] * (n - 1) + ws
                for i in range(len(ws)):
                    self.counts[n][tuple(padded[i : i + n])] += 1
        self.factors = [plain_factors(list(self.counts[n].values())) for n in range(1, order + 1)]
        self.followers = {}
        for n in range(2, order + 1):
            for g, c in self.counts[n].items():
                self.followers.setdefault(g[:-1], {})[g[-1]] = c

    def p(self, w, h):
        if not h:
            d, n = self.factors[0], sum(self.counts[1].values())
            known = self.counts[1]
            if not n:
                return 1.0
            half = not any(c <= LAST for c in known.values())
            kept = lambda c: c - 0.5 if half else c * d.get(c, 1)
            return kept(known[(w,)]) / n if (w,) in known else 1 - sum(map(kept, known.values())) / n
        seen = self.followers.get(tuple(h))
        if not seen:
            return self.p(w, h[1:])
        d, n = self.factors[len(h)], sum(seen.values())
        half = not any(c <= LAST for c in seen.values())
        kept = lambda c: c - 0.5 if half else c * d.get(c, 1)
        if w in seen:
            return kept(seen[w]) / n
        alpha = (1 - sum(map(kept, seen.values())) / n) / (1 - sum(self.p(x, h[1:]) for x in seen))
        return alpha * self.p(w, h[1:])

    def score(self, text):
        ws, out = words_of(text), 0.0
        for i, w in enumerate(ws):
            h = (["<s>"] * (self.order - 1) + ws)[i : i + self.order - 1]
            out += math.log10(self.p(w, h))
        return out


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    texts = [" ".join(f"W{min(int(rng.expovariate(0.12)), 60)}" for _ in range(rng.randint(1, 40))) for _ in range(n)]
    texts[5], texts[6], texts[7] = None, "", " \t\n "
    texts[8] = texts[9]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("order,parts", [(2, 1), (2, 7), (3, 5)])
def test_against_plain(spark, order, parts):
    rows = corpus()
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in katz.score_documents(df, held, order=order, parts=parts).collect()}
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    model = Plain([t for i, t in rows if i not in out], order)
    total, kinds = sum(model.counts[1].values()), len(model.counts[1])
    assert len(got) == len(rows) and out
    for i, text in rows:
        ws, r = words_of(text), got[i]
        assert r.held_out == (i in out)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum((w,) in model.counts[1] for w in ws), total)
        base = sum(math.log10((model.counts[1][(w,)] + 1) / (total + kinds + 1)) for w in ws)
        assert r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(model.score(text), rel=1e-9)


@pytest.mark.parametrize("order,parts", [(2, 4), (3, 5)])
def test_new_texts_from_the_stored_model(spark, tmp_path, order, parts):
    rows, folder = corpus(), f"file://{tmp_path}/model"
    katz.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), F.lit(False), order=order, parts=parts, model=folder)
    model = Plain([t for _, t in rows], order)
    new = [(1, "w0 w1 never w1 w1"), (2, None), (3, "all of it new"), (4, rows[20][1]), (4, rows[20][1]), (None, "w59 w0 w0 W0"), (6, rows[30][1] + " w1 new w2")]
    got = katz.score_texts(spark.createDataFrame(new, SCHEMA).withColumn("held", F.lit("clash")).repartition(2), folder).collect()
    want = sorted((str(i), len(words_of(t)), sum((w,) in model.counts[1] for w in words_of(t)), round(model.score(t), 9)) for i, t in new)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 9)) for r in got) == want
    assert katz.score_texts(spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_stored_weights_are_normalised(spark, tmp_path):
    """One weight for each context, parts of a split one added up; each is that of the plain model."""
    rows, folder = corpus(), f"file://{tmp_path}/model"
    katz.score_documents(spark.createDataFrame(rows, SCHEMA), F.lit(False), order=2, parts=6, model=folder)
    model = Plain([t for _, t in rows], 2)
    stored = {r.context % (1 << 64): r for r in spark.read.parquet(f"{folder}/weights-2").collect()}
    parts = [r for r in spark.read.parquet(f"{folder}/level-2").where("block = ''").collect()]
    contexts = [c for r in parts for c in katz.stored_row(2, r.model)[0].tolist()]
    assert len(set(contexts)) == len(stored) < len(contexts)  # some are split
    contexts = {g[:-1] for g in model.counts[2]}
    assert len(contexts) == len(stored)
    for (w,) in contexts:
        key = katz.START_HASH + 2 if w == "<s>" else katz.END_HASH if w == "</s>" else katz.xxhash.xxh64_intdigest(w)
        seen = model.followers[(w,)]
        alpha = (1 - sum(model.p(x, [w]) for x in seen)) / (1 - sum(model.p(x, []) for x in seen))
        assert stored[key].total == sum(seen.values()) and stored[key].alpha == pytest.approx(alpha)


def test_a_task_that_runs_again_gives_the_same_blocks(spark, tmp_path):
    """As when an executor is lost after its blocks were asked for; equal blocks stay apart."""
    df = spark.createDataFrame(corpus() * 2, SCHEMA).withColumn("held", F.lit(False)).coalesce(1).repartition(4, "doc_id")
    first, again = (sorted(r.block for r in katz.write_blocks(df, f"file://{tmp_path}/b", 3).select("block").distinct().collect()) for _ in range(2))
    assert first == again and len(first) >= 3
    same = spark.range(2, numPartitions=2).selectExpr("cast(null as long) as doc_id", "'same text' as text", "false as held")
    assert katz.write_blocks(same, f"file://{tmp_path}/c", 1).select("block").distinct().count() == 2


def test_normalised():
    model = Plain([t for _, t in corpus()], 3)
    vocabulary = [g[0] for g in model.counts[1]] + ["unseen word"]
    for h in [[], ["w1"], ["w0", "w0"], ["w3", "nowhere"], ["<s>", "<s>"]]:
        assert sum(model.p(w, h) for w in vocabulary) == pytest.approx(1)


def test_edges(spark):
    no = F.lit(None).cast("boolean")
    assert katz.score_documents(spark.createDataFrame([], SCHEMA), no).count() == 0
    rows = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], SCHEMA)
    assert katz.score_documents(rows, no).count() == 3
    none = katz.score_documents(rows, F.lit(True)).collect()
    assert {(r.train_tokens, r.score, r.base_score) for r in none} == {(0, 0.0, 0.0)}


def independent_factors(n):
    """From n_1 .. n_6: slope by the normal equations, then Katz's formula with r* = (r + 1) S(r + 1) / S(r)."""
    x, y = [math.log(r) for r in range(1, 7)], [math.log(v) for v in n]
    mx, my = sum(x) / 6, sum(y) / 6
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    mu = 6 ** (slope + 1)
    return [((1 + 1 / r) ** (slope + 1) - mu) / (1 - mu) for r in range(1, 6)]


@pytest.mark.parametrize("nums", [[207344, 59772, 25017, 14274, 13493, 7080, 3435607, 373692], [1579638, 246704, 51653, 21705, 18939, 7580, 3435607, 1962018]])
def test_good_turing_where_raw_ratios_fail(nums):
    """Counts of counts of sf0.1, for which the raw d_4 is above 1."""
    got = katz.Discount(nums).factor[1:]
    assert 5 * nums[4] / nums[3] / 4 > 1
    assert got == pytest.approx(independent_factors(nums[:6])) and all(0 < d < 1 for d in got)


def test_raw_good_turing_where_it_holds():
    nums = [684867, 182229, 76869, 44215, 34199, 23469, 23209938, 1247806]
    mu = 6 * nums[5] / nums[0]
    assert katz.Discount(nums).factor[1:] == pytest.approx([((r + 1) * nums[r] / nums[r - 1] / r - mu) / (1 - mu) for r in range(1, 6)])


def test_gaps_in_counts_of_counts():
    assert all(0 < d < 1 for d in katz.Discount([40, 9, 0, 2, 0, 0, 90, 51]).factor[1:])
    assert katz.Discount([3, 9, 20, 2, 0, 0, 90, 40]).factor[1] == pytest.approx(1 - 3 / 21)
