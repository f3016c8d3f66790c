"""Parsers, rules and entry points on generated files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenaudit.operators import pdf_rules, report, status
from lumenaudit.plans import api
from lumenaudit.sources import files as sources
from lumenaudit.sources import ooxml, pdf, remote, writers
from lumenaudit.streaming.watch import watch

from . import fixtures as X

LINK = "<< /Type /Annot /Subtype /Link /Rect [100 100 200 120] /A << /S /URI /URI (%s) >> >>"
FIELD = "<< /Type /Annot /Subtype /Widget /FT /Tx /T (name) /Rect [0 0 9 9]%s >>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    clean_deck = {1: [X.shape("Title", ph="title"), X.picture("a cat")]}
    made = {
        "good.docx": X.docx([X.para("One", "Heading1"), X.para("Two", "heading2"), X.link("r1", "Annual report"), X.image("chart"), X.table(True)], props=[("isAccessible", "0"), ("isAccessible", "1")], rels=[("r1", "http://a.b")]),
        "bad.docx": X.docx([X.para("One", "Heading1"), X.para("Deep", "Heading3"), X.link("r1", "http://a.b"), X.image(), X.table()], props=[("isAccessible", "true")], rels=[("r1", "http://a.b")]),
        "headings.docx": X.docx([X.para(str(n), f"Heading{n}") for n in (1, 3, 2, 4, 6, 3)]),
        "broken.docx": b"no zip at all",
        "UPPER.DOCX": X.docx([X.para("x")]),
        "sub/clean.pptx": X.pptx(clean_deck, props=[("isAccessible", "1")]),
        "sub/deck.pptx": X.pptx(
            {1: [X.shape("t", ph="ctrTitle", color="777777"), X.picture(" "), X.frame("0"), X.frame("1")], 10: [X.frame()], 2: [X.shape("http://x.y", ph="title", color="767676", link_id="r1"), X.shape("see", link_id="r1")]},
            rels={2: [("r1", "http://old"), ("r1", "http://x.y")]}, order=[1, 10, 2],
        ),
        "sub/plain.pdf": X.pdf(title="T", lang="en", content=b"BT 1 0 0 1 102 105 Tm (Annual report) Tj ET", annots=[LINK % "http://a.b"], figure_alt="a chart", image=True, keywords='{"isAccessible": "Manual Testing Required"}'),
        "sub/form.pdf": X.pdf(title="", content=b"BT 1 0 0 1 94 100 Tm (far) Tj 1 0 0 1 95 100 Tm [(c) -20 (l)] TJ ET", annots=[LINK % "http://a.b/long", FIELD % " /TU (Your name)", FIELD % " /Ff 1", FIELD % " /Ff 2"], image=True, packed=True, keywords="not json"),
        "sub/locked.pdf": X.pdf(title="T", lang="en", encrypt=True),
        "sub/notes.txt": b"x",
    }
    for name, data in made.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    return root


def names(rows, column="path"):
    return {r[column].rsplit("/", 1)[-1]: r for r in rows}


@pytest.fixture(scope="module")
def audited(spark, folder):
    return api.audit_folder(spark, str(folder))


def test_results(audited):
    rows = names(audited.results.collect())
    assert set(rows) == {"good.docx", "bad.docx", "headings.docx", "broken.docx", "clean.pptx", "deck.pptx", "plain.pdf", "form.pdf", "locked.pdf"}
    assert {k: r.status for k, r in rows.items()} == {
        "good.docx": "Accessible", "bad.docx": "Not Accessible", "headings.docx": "Accessible", "broken.docx": "Untested", "clean.pptx": "Accessible", "deck.pptx": "Not Accessible",
        "plain.pdf": "Manual Testing Required", "form.pdf": "Not Accessible", "locked.pdf": "Untested",
    }
    assert {k for k, r in rows.items() if not r.success} == {"broken.docx", "locked.pdf"}
    assert {k for k, r in rows.items() if r.report_passed} == {"good.docx", "clean.pptx", "plain.pdf"}  # heading errors fail a report alone


def test_issues(audited):
    found = {}
    for r in audited.issues.collect():
        found.setdefault(r.path.rsplit("/", 1)[-1], set()).add((r.rule_id, r.location))
    assert found["deck.pptx"] == {
        ("pptx-image-alt", "slide 1 ord 1"), ("pptx-slide-title", "slide 1"), ("pptx-slide-title", "slide 2"), ("pptx-contrast", "slide 1 shape_ord 1"), ("pptx-table-header", "slide 1 ord 1"),
        ("pptx-table-header", "slide 2 ord 1"), ("pptx-raw-link", "slide 3 shape_ord 1 para_ord 1 run_ord 1"), ("pptx-empty-slide", "slide 2"),
    }
    assert found["bad.docx"] == {("word-image-alt", "picture 1"), ("word-link-text", "link 1"), ("word-table-header", "table 1"), ("word-heading", "heading 2")}
    assert {x for x in found["headings.docx"]} == {("word-heading", "heading 2"), ("word-heading", "heading 4"), ("word-heading", "heading 5")}
    assert {x for x, _ in found["form.pdf"]} == {"pdf-title", "pdf-language", "pdf-link-purpose", "pdf-image-alt", "pdf-field-label", "pdf-focus-visible"}
    assert "plain.pdf" not in found and found["locked.pdf"] == {("parse-error", "file")}


def test_issue_details(audited):
    rows = {r.rule_id: r.detail for r in audited.issues.where("path like '%form.pdf'").collect()}
    assert rows["pdf-link-purpose"] == {"n": "1", "examples": "cl"}  # 5 units away counts, 6 do not
    assert rows["pdf-field-label"] == {"n": "2", "of": "3"} and rows["pdf-focus-visible"] == {"n": "1", "of": "3"}
    assert rows["pdf-image-alt"] == {"n": "1", "pages": "1"}


def test_document_type(spark, audited):
    t = audited.tables
    rows = names(pdf_rules.document_type(t["pdf_meta"].select("path"), t["annotations"]).collect())
    assert (rows["form.pdf"].is_form, rows["form.pdf"].first_page, rows["form.pdf"].n_fields) == (True, 1, 3)
    assert not rows["plain.pdf"].is_form


def test_listing(spark, folder):
    store = spark.createDataFrame([(f"file:{folder}/sub/locked.pdf", "Accessible")], "path string, status string")
    rows = names(api.list_folder(spark, str(folder), store).collect(), "name")
    assert rows["sub"].entry_type == "folder"
    assert {k: r.status for k, r in rows.items() if r.entry_type == "file"} == {"good.docx": "Accessible", "bad.docx": "Not Accessible", "headings.docx": "Untested", "broken.docx": "Not Applicable", "UPPER.DOCX": "Untested"}
    sub = names(api.list_folder(spark, str(folder / "sub"), store).collect(), "name")
    assert {k: r.status for k, r in sub.items()} == {"clean.pptx": "Accessible", "deck.pptx": "Untested", "plain.pdf": "Manual Testing Required", "form.pdf": "Untested", "locked.pdf": "Accessible", "notes.txt": "Not Applicable"}
    gone = sources.list_entries(spark, str(folder / "nowhere")).collect()
    assert len(gone) == 1 and "does not exist" in gone[0].warning


def test_folder_report(spark, folder):
    r = api.folder_report(spark, str(folder)).first()
    assert (r.num_files, r.num_accessible, r.num_untested, r.num_manual, r.num_inaccessible, r.rate) == (7, 1, 4, 1, 1, 14.3)
    assert api.folder_report(spark, str(folder), include_slides=True).first().num_files == 9
    assert sources.walk_files(spark, str(folder), "word").count() == 4 and sources.walk_files(spark, str(folder), "word", case_sensitive=False).count() == 5


def test_selection(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="select"):
        api.audit_folder(spark, str(folder), ())
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="no documents"):
        api.audit_folder(spark, str(tmp_path))
    assert {r.kind for r in api.audit_folder(spark, str(folder), ("pdf",)).results.collect()} == {"pdf"}


def test_reports(spark, audited, tmp_path):
    reports = writers.html_reports(audited.results, audited.issues, "reports")
    rows = names(reports.collect())
    assert rows["deck.pptx"].report_path == "reports/powerpoint/deck.pptx.html" and rows["deck.pptx"].html.count("<tr>") == 9
    assert "No issues" in rows["plain.pdf"].html
    writers.write_reports(reports, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 9


def test_status_store(spark, tmp_path):
    store = str(tmp_path / "store")
    assert api.set_status(spark, store, "a.pdf", "Accessible", "me").count() == 1
    assert api.set_status(spark, store, "b.docx", "Untested").where("updated_by is not null").count() == 2
    rows = {r.path: r.status for r in api.set_status(spark, store, "a.pdf", "Not Accessible", "you").collect()}
    assert rows == {"a.pdf": "Not Accessible", "b.docx": "Untested"}
    with pytest.raises(ValueError):
        api.set_status(spark, store, "a.pdf", "Fine", "you")


def test_office_property():
    for data in (X.docx([X.para("x")]), X.docx([X.para("x")], props=[("other", "5"), ("isAccessible", "0")])):
        for value in (True, False):
            data = writers.set_property(data, value)
            got = [p["value"] for p in ooxml.parse("word", data)["custom_props"] if p["name"] == "isAccessible"]
            assert got == ["1" if value else "0"]
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None


def test_keywords():
    assert json.loads(writers.merged_keywords(None, "Untested", "u")) == {"isAccessible": "Untested", "accessibilityStatusUpdatedBy": "u"}
    assert json.loads(writers.merged_keywords("a, b", "Untested", "u"))["keywords"] == "a, b"
    assert json.loads(writers.merged_keywords('{"x": 1}', "Untested", "u"))["x"] == 1


@pytest.mark.parametrize("target,tier", [("exact words", 0), ("act wor", 1), ("split words", 2), ("", 1)])
def test_comments(target, tier):
    body = [X.para("first"), X.para("exact words"), X.para("a split words b", split=5)]
    data = X.docx(body, comments=[(0, "old"), (7, "older")], rels=[("rId1", "http://a"), ("rId9", "http://b")])
    out = writers.add_comment(data, target, "fix it", when="2020-01-01T00:00:00Z")
    comments = ooxml.parse("word", out)["comments"]
    assert [c["id"] for c in comments] == [0, 7, 8] and comments[-1]["text"] == "fix it"
    parts = dict(ooxml.members(out))
    assert b'Id="rId10"' in parts["word/_rels/document.xml.rels"] and b"/word/comments.xml" in parts["[Content_Types].xml"]
    assert parts["word/document.xml"].count(b"commentRangeStart") == 1
    again = dict(ooxml.members(writers.add_comment(out, "first", "more")))
    assert again["word/_rels/document.xml.rels"].count(b"/comments") == 1


def test_comment_not_found():
    with pytest.raises(LookupError):
        writers.add_comment(X.docx([X.para("x")]), "nowhere", "c")
    assert ooxml.parse("word", X.docx([X.para("x")]))["comments"] == []


def test_pdf_values():
    lexer = pdf.Lexer(rb"<< /A#20b (x\(\)\101\
y) /B <4142 4> /C [1 -2.5 3 0 R true null] % note" + b"\n/D << /E /F >> >>")
    assert lexer.value() == {"A b": b"x()Ay", "B": b"AB@", "C": [1, -2.5, pdf.Ref(3), True, None], "D": {"E": "F"}}
    with pytest.raises(ValueError):
        pdf.parse(b"hello")


def test_remote(spark, tmp_path):
    rows = [(2, 1, 0, "sub"), (3, 1, 144, "a.PDF"), (4, 2, 144, "b.docx"), (5, 2, 144, "c.txt"), (6, 9, 144, "other.pdf")]
    path = tmp_path / "nodes.json"
    path.write_text("\n".join(json.dumps(dict(zip(("id", "parent_id", "type", "name"), r))) for r in rows))
    nodes = remote.nodes(spark, snapshot=str(path))
    assert {r.path for r in remote.files_of(nodes, 1).collect()} == {"3/a.PDF"}
    assert {r.name for r in remote.folders_of(nodes, 1).collect()} == {"sub"}
    assert {r.id for r in remote.walk_remote(nodes, 1, ("word", "pdf")).collect()} == {3, 4}


def test_watch(spark, folder, tmp_path):
    query = watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"), glob="*.docx")
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == 4


def test_reduce_and_decode_edges(spark):
    files = spark.createDataFrame([("a", "pdf"), ("b", "word"), ("c", "other")], "path string, kind string")
    none = sources.empty_tables(spark)
    assert {r.status for r in status.decode(files, none["custom_props"], none["pdf_meta"], spark.createDataFrame([], "path string, status string")).collect()} == {"Untested", "Not Applicable"}
    assert report.folder_report(files.where("false").withColumn("status", F.lit("x"))).first().rate == 0.0
