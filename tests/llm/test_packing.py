import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenaudit.llm import packing, token_output, tokens

WORD, BYTE = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))
SCHEMA = "doc_id long, text string"
HARD = ["", " ", "  a  b ", "don't stop\tnow\n\n x", "é́ ﬁ İstanbul ß", "a\u00a0  b\u2003 c", "<|endoftext|> hi <|startoftext|>", "日本語, 123 45.6 ½ ²", "x\x1cy \x1f z\x00", "a  \n b\r\n\r\nc   ", "ΑΣ ΣΑΣ", "😀 hi😀\u200dx", "'s 't 'S it'S", "µm ªº × ÷ À×É", "a\u0085b", " 's"]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_library_s(path, plain):
    whole = Tokenizer.from_file(path)
    if plain:
        whole.encode_special_tokens = True
    rng = random.Random(1)
    texts = HARD + ["a <|endoftext|> b", "<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> x", "x<|endoftext|>y " * 50, "<|endof text|>", "<|endoftext|", "é<|endoftext|>  \n"] + ["".join(rng.choice("ab'sS \n\t .,é 日1½́<|> É×2\x00\x1c\u00a0") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    encoder = tokens.ChunkEncoder(path, pieces=500, plain=plain)  # the cache starts anew many times
    for i in range(0, len(texts), 300):
        part = texts[i : i + 300]
        want = [np.array([*e.ids, 7], "<u4").tobytes() for e in whole.encode_batch(part, add_special_tokens=False)]
        assert encoder.encode(part, 7) == want


library = cache(Tokenizer.from_file)


def plain_ids(path, text, end):
    return [*library(path).encode(text or "", add_special_tokens=False).ids, end]


def rows_of(seed=2, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "x"]) for _ in range(int(rng.expovariate(0.05))))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1003, "a <|endoftext|> b"), (1002, "long word " * 300), (1002, "long word " * 300), (None, "no id"), (None, None)]


def test_packing(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "body").selectExpr("*", "1 as piece", "'x' as text").repartition(3)
    got = packing.pack(df, WORD, capacity=64, open_bins=8, text_col="body", with_ids=True).collect()
    want = sorted((i if i is not None else -1, k, at, zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for i, t in rows for ids in [plain_ids(WORD, t, 1)] for k, at in enumerate(range(0, len(ids), 64)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(r.length for r in got) // 64)
    assert len(bins) <= 1.08 * least


def test_bins_are_bounded_and_best_fit():
    bins = packing.Bins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # fits exactly where least is free
    assert bins.open == 1 and bins.place(9) == (2, 0)
    assert bins.place(5) == (3, 0) and bins.open == 2  # the fullest, with one free, closes
    assert bins.place(4) == (0, 6)
    rng = random.Random(5)
    bins, sums = packing.Bins(100, 16), {}
    for _ in range(5000):
        n = rng.randint(1, 99)
        number, offset = bins.place(n)
        assert sums.get(number, 0) == offset and bins.open <= 16
        sums[number] = offset + n
    assert max(sums.values()) <= 100 and sum(sums.values()) / (100 * len(sums)) > 0.95


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none, WORD).count() == 0
    assert token_output.token_output(none, BYTE, 2).count() == 0


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [0, 1, 2, 3], [0, 10**6, 10**6, 10**9], sorted(random.Random(4).randrange(10**7) for _ in range(3000))])
def test_elias_fano(values):
    ef = token_output.EliasFano.of(np.array(values, np.int64))
    back = token_output.EliasFano.read(ef.about(), b"".join(ef.parts()))
    assert back.span(0, len(values)).tolist() == values and [back.get(i) for i in range(len(values))] == values
    rng = random.Random(1)
    for _ in range(50 if values else 0):
        i, j = sorted((rng.randint(0, len(values)), rng.randint(0, len(values))))
        assert back.span(i, j).tolist() == values[i:j]
        if i < len(values):
            assert back.last_up_to(values[i] + j, i) == max(k for k in range(i, len(values)) if values[k] <= values[i] + j)
    if len(values) > 1000:
        assert sum(ef.about()["sizes"]) * 8 < len(values) * (2.5 + np.log2(values[-1] / len(values)))
    with pytest.raises(IndexError):
        back.get(len(values))


def test_token_output(spark, tmp_path):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("start", token_output.F.lit("clash")).repartition(5)
    token_output.write_shards(df, BYTE, 2, f"file://{tmp_path}/shards")
    manifest = spark.read.parquet(f"{tmp_path}/shards/manifest")  # all that a reader needs to know
    got = token_output.read_shards(manifest).collect()
    shards = [r.file for r in manifest.orderBy("start").collect()]
    want = sorted((i if i is not None else -1, plain_ids(BYTE, t, 2)) for i, t in rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in want]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i if i != 0 else -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    shard = token_output.Shard(shards[0])
    for i, (_, start, ids) in enumerate(shard.rows(step=50)):
        assert shard.ids(i).tolist() == ids.tolist() and start == shard.ends.get(i)
    assert [shard.ends.get(i + 1) - shard.ends.get(i) for i in range(len(shard))] == [len(ids) for _, _, ids in shard.rows()]
    damaged = bytearray(token_output.open_input(shards[0]).read())
    damaged[3] ^= 1
    (tmp_path / "bad").write_bytes(damaged)
    with pytest.raises(ValueError, match="checksum"):
        list(token_output.Shard(f"file://{tmp_path}/bad").rows())
