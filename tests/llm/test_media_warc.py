import glob
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenaudit.llm import media, queries, store, warc

TEXTS = [(0, "hello"), (1, "hello"), (2, None), (3, ""), (4, "é" * 500), (5, "x" * 64), (6, "long text " * 50_000), (None, "no id"), (6, "long text " * 50_000)]


def test_media_round_trip(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("media", F.lit("clash"))
    rows = media.read_media(media.media_columns(df)).collect()
    assert len(rows) == len(TEXTS)
    for (i, text), r in zip(sorted(TEXTS, key=str), sorted(rows, key=lambda r: str((r.doc_id, dict(zip([None if k is None else k for k, _ in TEXTS], [t for _, t in TEXTS]))[r.doc_id])))):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = {r.doc_id: (r.media_sha256, r.feature, r.media_bytes) for r in rows}
    assert same[0] == same[1] and same[2] == same[3]
    assert media.read_media(media.media_columns(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def png_with(rows, kinds, step, colour):
    """A PNG whose rows use the given filters, by the definition of each."""
    height, width = rows.shape
    out = b""
    for y in range(height):
        up, line = (rows[y - 1] if y else np.zeros(width, np.uint8)), bytearray([kinds[y]])
        for x in range(width):
            a, b, c = (int(rows[y][x - step]) if x >= step else 0), int(up[x]), (int(up[x - step]) if x >= step else 0)
            guess = [0, a, b, (a + b) // 2, media.paeth(a, b, c)][kinds[y]]
            line.append((int(rows[y][x]) - guess) & 255)
        out += bytes(line)
    head = struct.pack(">IIBBBBB", width // step, height, 8, colour, 0, 0, 0)
    return media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"tEXt", b"k\0v") + media.chunk(b"IDAT", zlib.compress(out)) + media.chunk(b"IEND", b"")


@pytest.mark.parametrize("step,colour", [(1, 0), (3, 2), (4, 6)])
def test_all_filters(step, colour):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (23, 12 * step), dtype=np.uint8)
    kinds = [int(k) for k in rng.integers(0, 5, 23)]
    assert (media.decode_png(png_with(rows, kinds, step, colour)) == rows).all()


def test_damage_is_found():
    png = media.encode_png(bytes(range(64)) * 4)
    for i in (0, 20, len(png) // 2, len(png) - 2):
        bad = bytearray(png)
        bad[i] ^= 1
        with pytest.raises((ValueError, zlib.error, struct.error)):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.encode_png(b"abc")


def test_feature_is_stable():
    rng = np.random.default_rng(2)
    image = np.add.outer(np.arange(96), np.arange(64)).astype(np.uint8)
    noisy = np.clip(image.astype(int) + rng.integers(-2, 3, image.shape), 0, 255).astype(np.uint8)
    far = rng.integers(0, 256, image.shape, dtype=np.uint8)
    bits = lambda a, b: (int.from_bytes(media.cosine_hash(a)) ^ int.from_bytes(media.cosine_hash(b))).bit_count()
    assert bits(image, noisy) < bits(image, far)


def plain_hash(image):
    """By the definition of the cosine transform, cell by cell."""
    rows, columns = image.shape

    def cell(i, n):
        return range(i * n // 32, max(i * n // 32 + 1, (i + 1) * n // 32))

    grid = [[sum(int(image[y][x]) for y in cell(i, rows) for x in cell(j, columns)) / (len(cell(i, rows)) * len(cell(j, columns))) for j in range(32)] for i in range(32)]
    terms = []
    for u in range(8):
        for v in range(8):
            wave = [[math.cos(math.pi * u * (2 * i + 1) / 64) * math.cos(math.pi * v * (2 * j + 1) / 64) for j in range(32)] for i in range(32)]
            terms.append(0.0 if u == v == 0 else sum(grid[i][j] * wave[i][j] for i in range(32) for j in range(32)))
    most = max(map(abs, terms))
    steps = [round(t * 256 / most) if most > 1e-6 else 0 for t in terms]
    middle = sorted(steps)
    bits = "".join(str(int(s > (middle[31] + middle[32]) / 2)) for s in steps)
    return int(bits, 2).to_bytes(8)


def test_hash_by_its_definition():
    rng = np.random.default_rng(3)
    for rows, columns in ((1, 64), (7, 64), (40, 64), (200, 64)):
        for _ in range(2):
            image = rng.integers(0, 256, (rows, columns), dtype=np.uint8)
            assert media.cosine_hash(image) == plain_hash(image)


def test_flat_images_have_no_terms():
    for value in (0, 120, 121, 255):
        assert media.cosine_hash(np.full((5, 64), value, np.uint8)) == bytes(8)


def test_query_reads_the_stored_table(spark, tmp_path):
    """What the query returns is read from the images in a Parquet table, with binary columns."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("media", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(tables(spark))
    rows = queries.op9_media_columns(spark, str(tmp_path)).collect()
    (folder,) = set(tables(spark)) - before
    stored = spark.read.parquet(folder)
    assert dict(stored.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "media": "binary", "hash": "binary"}
    assert sorted((str(r.doc_id), r.media_sha256, r.feature) for r in rows) == sorted((str(r.doc_id), hashlib.sha256(r.media).hexdigest(), bytes(r.hash).hex()) for r in stored.collect())
    damaged = stored.withColumn("hash", F.lit(b"12345678"))
    with pytest.raises(Exception, match="another hash"):
        media.read_media(damaged).collect()


def tables(spark):
    return glob.glob(f"{store.base_dir(spark).removeprefix('file://')}/lumenaudit/media-*/images")


def pages():
    rng = random.Random(1)
    big = "<p>%s</p>" % ("copy " * 400)
    rows = [(i, f"http://a.b/{i}", f"<p>{i} {'x' * rng.randint(0, 3000)}</p>") for i in range(60)]
    rows += [(100 + i, "http://copy", big) for i in range(20)] + [(200, None, "small"), (201, "u\r\nv", "small"), (202, "u", None), (203, "u", "é" * 600), (204, "u", "é" * 600)]
    return rows + [(119, "http://copy", big), (None, "u", big), (300, "u", "z" * 3_000_000)]


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 5000)
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    index = warc.write_archives(df, warc.work_dir(spark, "t"))
    got = warc.read_archives(index).collect()
    newest, want = {}, []
    for i, _, h in rows:
        raw = (h or "").encode()
        if i is not None:
            newest[raw] = max(newest.get(raw, i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        old = len(raw) >= 1000 and i is not None and i < newest[raw]
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if old else "response", newest[raw] if old else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.lookup(index, 7) == rows[7][2].encode() and warc.lookup(index, 100) == rows[60][2].encode() and warc.lookup(index, 999) is None
    place = index.where("page_id = 203").first()
    head, payload = warc.Reader(place.file).record(place.frame, place.record_offset)
    assert head["WARC-Record-ID"] == "<urn:page:203>" and head["WARC-Type"] == "revisit" and payload == b""
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_bundle_is_plain_zstandard(spark, tmp_path):
    import zstandard

    uri = f"file://{tmp_path}/a.warc.zst"
    bundle = warc.Bundle(uri)
    places = [bundle.add(warc.record(i, "u", "response", b"p%d" % i, "00" * 20, 2, None)) for i in range(5)]
    bundle.close()
    raw = (tmp_path / "a.warc.zst").read_bytes()
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw).count(b"WARC/1.1") == 5
    assert [warc.Reader(uri).record(*p)[1] for p in places] == [b"p%d" % i for i in range(5)]
