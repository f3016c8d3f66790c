import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenaudit.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É b É c D", "x" * 5000] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    long = "a b c d e " * 40_000
    assert simhash.fingerprint(long) == plain_fingerprint(long)


def flip(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("cell", [simhash.CELL, 7])
def test_links_are_those_of_brute_force(spark, monkeypatch, cell):
    """Chains, dense groups and lone fingerprints; also far below and above a refreshed tree. With small
    cells dense shards are cut, and their trees broadcast and searched for other chunks."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(7)
    fps = []
    for _ in range(25):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.append(fp)
            fp = flip(rng, fp, rng.randint(1, 5))
    center = rng.getrandbits(64)
    fps += [flip(rng, center, rng.randint(0, 4)) for _ in range(300)]
    fps += [0, 1, 7, 15, (1 << 64) - 1]
    fps = sorted(set(fps))
    rng.shuffle(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    folder = simhash.work_dir(spark, "t")
    links = simhash.link_shards(df, 3, folder)
    trees = spark.read.parquet(f"{folder}/found").where("file is not null")
    assert trees.isEmpty() == (cell > 7) and (cell > 7 or spark.read.parquet(f"{folder}/pairs").count() > trees.count())
    roots = {r.u: r.v for r in simhash.components(links, folder).collect()}
    got, groups = {}, plain_components(fps)
    for s, g in zip(signed, groups):
        got.setdefault(g, set()).add(roots.get(s, s))
    assert all(len(v) == 1 for v in got.values()) and len({next(iter(v)) for v in got.values()}) == len(set(groups))


def test_a_tree_read_back_finds_what_it_found():
    rng = random.Random(11)
    center = rng.getrandbits(64)
    values = [flip(rng, center, rng.randint(0, 9)) for _ in range(200)] + [rng.getrandbits(64) for _ in range(200)]
    tree = simhash.BKTree(3, simhash.Links())
    for v in dict.fromkeys(values):
        tree.insert(v)
    links = simhash.Links()
    back = simhash.BKTree.load(tree.dump(), 3, links)
    assert back.values == tree.values and back.children == tree.children
    asked = [flip(rng, v, rng.randint(0, 6)) for v in values]
    for x in asked:
        back.search(x)
    label = plain_components(all_ := list(dict.fromkeys([*tree.values])))
    for x in asked:
        near = {label[i] for i, v in enumerate(all_) if (v ^ x).bit_count() <= 3}
        assert len({links.find(v) for i, v in enumerate(all_) if label[i] in near} | ({links.find(x)} if near else set())) <= 1 and (near or links.find(x) == x)


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    rows = []
    for k, text in enumerate(base):
        for c in range(4):
            ws = text.split()
            if c:
                ws[rng.randrange(80)] = "new"
            rows.append((100 - 4 * k - c, " ".join(ws)))
    rows += [(200, None), (201, ""), (202, " "), (7000, base[0]), (7000, base[0]), (None, base[1]), (None, "lonely text without id")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit("clash"), "component_id": F.lit(-1)}).repartition(3)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(fps)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted(((i if i is not None else -1), f, least.get(g, -1)) for (i, _), f, g in zip(rows, fps, groups))
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.fp % (1 << 64), r.component_id if r.component_id is not None else -1) for r in got) == want


def plain_wide(found):
    """Counted vote by vote."""
    mask, words = (1 << 64) - 1, []
    for w in range(64 if len(found) <= 32 else 48):
        total = [0] * 64
        for worth, times in zip((1, 2), simhash.TIMES[:, w].tolist()):
            for h in found:
                x = h * times & mask
                x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 & mask
                x ^= x >> 32
                total = [t + worth * (x >> b & 1) for b, t in enumerate(total)]
        words.append(sum(1 << b for b, t in enumerate(total) if 2 * t > 3 * len(found)))
    return words


def test_wide_fingerprints():
    rng = random.Random(2)
    for n in (0, 1, 2, 4, 5, 32, 33, 1025):
        found = [rng.getrandbits(64) for _ in range(n)]
        assert simhash.wide_fingerprint(np.array(found, np.uint64)).tolist() == plain_wide(found)


@pytest.mark.parametrize("cell", [simhash.CELL, 7])
def test_near_sets_connect_all_of_similarity_four_fifths(spark, monkeypatch, cell):
    """Pairs at exactly 0.8, of four shingles and more, and a dense group; unrelated sets stay alone."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    rng = random.Random(4)
    sets = []
    for both, a, b in [(4, 0, 1), (8, 1, 1), (8, 0, 2), (40, 5, 5), (400, 0, 100), (4000, 500, 500)] * 6:
        h = [rng.getrandbits(64) for _ in range(both + a + b)]
        sets.append([h[: both + a], h[:both] + h[both + a :]])
    core = [rng.getrandbits(64) for _ in range(90)]
    sets.append([core + [rng.getrandbits(64) for _ in range(5)] for _ in range(40)])
    words = [[simhash.wide_fingerprint(np.array(s, np.uint64)).view(np.int64).tolist() for s in group] for group in sets]
    rows = [(k, w) for k, group in enumerate(words) for w in group]
    df = spark.createDataFrame(rows, "k int, words array<long>").withColumn("u", simhash.print_id(F.col("words")[0], F.col("words")[1])).localCheckpoint()
    folder = simhash.work_dir(spark, "t")
    links = simhash.save(simhash.near_sets(df, folder), f"{folder}/links")
    assert spark.read.parquet(f"{folder}/dense").isEmpty() == (cell > 7)
    roots = {r.u: r.v for r in simhash.components(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), folder).collect()}
    found = {}
    for r in df.collect():
        found.setdefault(r.k, set()).add(roots.get(r.u, r.u))
    assert all(len(v) == 1 for v in found.values()) and len({next(iter(v)) for v in found.values()}) == len(sets)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hex(spark):
    rows = spark.createDataFrame([(-1,), (0,), (255,)], "fp long").select(simhash.hex_fp(F.col("fp")).alias("h")).collect()
    assert [r.h for r in rows] == ["f" * 16, "0" * 16, "0" * 14 + "ff"]
