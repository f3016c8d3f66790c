"""What many files cost: shuffles, Python workers and what they hold; the short ways against the long ones."""

import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenaudit import lineage
from lumenaudit.operators import headings
from lumenaudit.plans import api, queries
from lumenaudit.sources import builders, files, ooxml

from ..oracle import SF_DIR, connection


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_headings_need_no_shuffle(spark):
    rng = random.Random(2)
    styles = ["Heading1", "heading 2", "HEADING3", "Heading0", "HeadingX", "Normal", None]
    rows = [(f"f{n}", [(rng.choice(styles), rng.choice(["a", " ", " ", "", "b ", None])) for _ in range(rng.randint(0, 12))]) for n in range(300)]
    df = spark.createDataFrame(rows, "path string, p array<struct<style:string,text:string>>").repartition(3)
    found = api.audit(builders.build(df, "path", "word", builders.word, paragraphs=F.col("p")))
    want = {}
    for r in headings.check_headings(headings.docx_headings(found.tables["paragraphs"])).collect():
        want.setdefault(r.path, []).append((f"heading {r.pos}", str(r.code), str(r.level) if r.level is not None else None))
    got = {}
    for r in found.issues.where("rule_id = 'word-heading'").collect():
        got.setdefault(r.path, []).append((r.location, r.detail["code"], r.detail["level"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()} and 50 < len(got) < 300
    assert {r.path: r.report_passed for r in found.results.collect()} == {path: path not in want for path, _ in rows}
    assert {r.status for r in found.results.collect()} == {"Accessible"}
    of_words = found.issues.where("rule_id = 'word-heading'")
    assert "Window" not in plan(of_words) and "collect_list" not in plan(of_words) and "explode(paragraphs" not in plan(found.results)
    found.free()


def test_lines_are_moved_once_and_read_where_files_are_made(spark, monkeypatch):
    connection()  # skips where there are no tables
    seen = []
    real = api.audit_parsed
    monkeypatch.setattr(api, "audit_parsed", lambda parsed, *a: seen.append(parsed._jdf.queryExecution().executedPlan().toString()) or real(parsed, *a))
    assert queries.word_heading_audit(spark, SF_DIR).count() > 0
    assert seen[0].count("Exchange hashpartitioning") == 1 and seen[0].count("MapInArrow") == 1


def usual() -> bytes:
    return builders.word({"paragraphs": [{"style": "Heading1", "text": "a & b"}, {"style": None, "text": "é"}]})


def odd_zips() -> dict[str, bytes]:
    """Zips that are read by ``zipfile``, or that it refuses."""

    def made(change=None, name="word/document.xml", **how):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", **how) as z:
            info = zipfile.ZipInfo(name)
            info.compress_type = how.get("compression", zipfile.ZIP_STORED)
            z.writestr(info, b"<a>text</a>" * 9) if change is None else change(z, info)
        return out.getvalue()

    def extra(z, info):
        info.extra = b"\x34\x12\x02\x00ab"
        z.writestr(info, b"x")

    def comment(z, info):
        z.comment = b"a comment"
        z.writestr(info, b"x")

    damaged = bytearray(made())
    damaged[damaged.index(b"text")] ^= 1
    locked = bytearray(usual())
    locked[locked.index(b"PK\1\2") + 8] |= 1
    renamed = bytearray(made())
    renamed[renamed.index(b"word/")] ^= 1
    short = usual()
    return {
        "extra": made(extra), "comment": made(comment), "prefix": b"#!/bin/sh\n" + made(), "bzip2": made(compression=zipfile.ZIP_BZIP2), "cp437": made().replace(b"word/", b"w\x82rd/"),
        "damaged": bytes(damaged), "locked": bytes(locked), "renamed": bytes(renamed), "cut": short[:-30], "no zip": b"no file", "nothing": b"",
    }


def by_zipfile(data: bytes):
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    except Exception as e:
        return f"{type(e).__name__}: {e}"


def test_members_are_those_of_zipfile():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("word")
        for name, data in (("a.xml", b""), ("word/b.xml", b"b" * 70000), ("é.xml", b"c"), ("a.xml", b"again")):
            z.writestr(name, data)
    for data in (usual(), out.getvalue()):
        assert ooxml.plain_members(data) == by_zipfile(data) == ooxml.members(data)
    with zipfile.ZipFile(io.BytesIO(usual())) as z:
        assert z.testzip() is None and z.namelist() == ["[Content_Types].xml", "word/document.xml"]
    for name, data in odd_zips().items():
        try:
            got = ooxml.members(data)
        except Exception as e:
            got = f"{type(e).__name__}: {e}"
        assert ooxml.plain_members(data) is None and got == by_zipfile(data), name


def test_any_damage_is_told_as_by_zipfile():
    rng = random.Random(3)
    whole = usual()
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 3)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        found = ooxml.plain_members(bytes(data))
        assert found is None or found == by_zipfile(bytes(data))


def test_values_are_as_to_pylist():
    kinds = pa.list_(pa.struct([("a", pa.string()), ("n", pa.int32())]))
    rows = [[{"a": "x", "n": 1}, {"a": None, "n": None}], None, [], [None, {"a": "y", "n": 2}], [{"a": "", "n": 0}]]
    array = pa.array(rows, kinds)
    for part in (array, array.slice(1, 3), array.slice(3), array.slice(0, 0), pa.array(["a", None]), pa.array([1, None]), pa.array([None, None], pa.string())):
        assert builders.values(part) == part.to_pylist()


@pytest.mark.parametrize("second", [True, False])
def test_style_of_properties(second):
    props = '<w:pPr/><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>' if second else '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'
    xml = f'<w:document xmlns:w="{ooxml.W[1:-1]}"><w:body><w:p>{props}<w:r><w:t>a</w:t><w:t/><w:t>b</w:t></w:r></w:p></w:body></w:document>'
    got = ooxml.parse_word({ooxml.DOCUMENT: xml.encode()})
    assert got["paragraphs"] == [{"para_ord": 1, "style_id": "Heading2", "text": "ab"}] and [r["text"] for r in got["runs"]] == ["a", "", "b"]


def test_python_holds_little(spark):
    """Contents that unfold to many times their size, and rows before they are files."""
    big = builders.word({"paragraphs": [{"style": None, "text": "word " * 20000}] * 4})
    assert len(big) < 10000
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{n}" for n in range(100)]), pa.array(["word"] * 100), pa.array([big] * 100, pa.binary())], ["path", "kind", "content"])
    groups = list(files.parse_batches(iter([batch]), files.parsed_schema()))
    assert sum(g.num_rows for g in groups) == 100 and all(g.nbytes < 2 * files.GROUP_BYTES for g in groups)
    many = builders.word({"paragraphs": [{"style": None, "text": ""}] * 20000})
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array(["word"] * 3), pa.array([many] * 3, pa.binary())], ["path", "kind", "content"])
    assert [g.num_rows for g in files.parse_batches(iter([batch]), files.parsed_schema())] == [1, 1, 1]


@pytest.mark.parametrize("made", [True, False])
def test_batches_are_bounded(spark, made):
    before = spark.conf.get(lineage.BATCH_KEY)
    spark.conf.set(lineage.BATCH_KEY, "64m")
    try:
        df = spark.createDataFrame([("a", None, None)], "path string, kind string, content binary")
        builders.build(df, "path", "word", builders.word) if made else files.parse_files(df)
        assert int(spark.conf.get(lineage.BATCH_KEY)) <= 4 << 20
    finally:
        spark.conf.set(lineage.BATCH_KEY, before)
