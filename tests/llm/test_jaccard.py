"""Near-duplicates by exact Jaccard similarity against all pairs."""

import random

import corpus_pipeline
from lumenaudit.llm import jaccard

SCHEMA = "doc_id long, text string"


def plain_set(text):
    ws = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split()]
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_components(texts):
    sets = [plain_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def corpus(seed=5):
    rng = random.Random(seed)
    texts = [None, "", " \t ", "one two", "One  TWO", "one two three four five"]
    for _ in range(25):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    return texts


def check(spark, texts):
    found = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == list(enumerate(plain_components(texts)))


def test_against_all_pairs(spark):
    check(spark, corpus())


def test_large_buckets_are_dealt_in_cells(spark, monkeypatch):
    """Connected nodes beyond a cell go by bucket, and a bucket beyond it by pairs of chunks."""
    for cell in (1000, 200):
        monkeypatch.setattr(jaccard, "CELL", cell)
        check(spark, corpus(6)[:60])


def test_stage_drops_edited_copies(spark, tmp_path):
    """Similarity above 0.8, though the fingerprints differ in more than three bits."""
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words), *(" ".join([*words[:k], "edited", *words[k + 1 :]]) for k in (20, 60, 100)), " ".join(words[60:] + [f"v{i}" for i in range(60)])]
    from lumenaudit.llm import simhash

    prints = [simhash.fingerprint(t) for t in texts]
    assert any((prints[0] ^ p).bit_count() > 3 for p in prints[1:4]) and similar(plain_set(texts[1]), plain_set(texts[2])) >= 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == [0, 4]


def test_stage_gets_its_candidates_from_simhash(spark, tmp_path, monkeypatch):
    """Edited copies are dropped by what near_sets connects, and by nothing else."""
    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join([*words[:60], "edited", *words[61:]])), (2, " ".join(words))], SCHEMA)
    left = lambda: sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert left() == [0]
    monkeypatch.setattr(jaccard, "near_sets", lambda sets, folder: spark.createDataFrame([], "u long, v long"))
    assert left() == [0, 1]
