"""Actions on tables of files, and the remote store against a server of our own."""

import json
import re
import threading
from email import message_from_bytes
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenaudit.plans import api
from lumenaudit.sources import actions, ooxml, pdf, remote, writers
from lumenaudit.sources.pdf_update import with_keywords

from . import fixtures as X

FILES = "path string, kind string, content binary"


def referenced(data, stream=False):
    """A PDF with a cross-reference, as a table or as a stream."""
    body = data[: data.index(b"trailer")]
    at = len(body)
    if stream:
        return body + b"70 0 obj\n<< /Type /XRef /Size 71 /W [1 2 1] /Length 0 /Root 1 0 R /Info 3 0 R >>\nstream\n\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at
    return body + b"xref\n0 0\ntrailer\n<< /Size 61 /Root 1 0 R /Info 3 0 R /ID [<01> <02>] >>\nstartxref\n%d\n%%%%EOF" % at


@pytest.mark.parametrize("stream", [False, True])
def test_keywords_are_written(stream):
    old = referenced(X.pdf(title="T (x)", keywords="a", lang="en"), stream)
    new = with_keywords(old, '{"a": "é"}')
    assert new.startswith(old)
    doc = pdf.Document(new)
    info = doc.dict(doc.trailer["Info"])
    assert pdf.decoded(info["Keywords"]) == '{"a": "é"}' and info["Title"] == b"T (x)"
    at = int(re.findall(rb"startxref\s+(\d+)", new)[-1])
    assert f"/Prev {len(old[: old.index(b'70 0 obj' if stream else b'xref')])}".encode() in new[at:]
    if stream:
        assert new[at:].startswith(b"71 0 obj") is False and new[at : at + 8] == b"72 0 obj"
    else:
        place = int(re.search(rb"(\d{10}) 00000 n", new[at:])[1])
        assert new[at : at + 4] == b"xref" and new[place:].startswith(b"61 0 obj") and b"/Size 62" in new[at:] and b"/ID [<01> <02>]" in new[at:]
    again = pdf.parse(with_keywords(new, "b"))[0]["pdf_meta"][0]
    assert (again["keywords"], again["title"], again["language"]) == ("b", "T (x)", "en")


def test_keywords_cannot_be_written():
    with pytest.raises(ValueError, match="encrypted"):
        with_keywords(X.pdf(encrypt=True), "a")
    with pytest.raises(ValueError, match="cross-reference"):
        with_keywords(X.pdf(), "a")


def test_statuses_are_written(spark, tmp_path):
    rows = [
        ("a/x.docx", "word", bytearray(X.docx([X.para("x")]))), ("b/x.docx", "word", bytearray(X.docx([X.para("y")]))), ("d.pptx", "powerpoint", bytearray(X.pptx({1: []}))),
        ("e.pdf", "pdf", bytearray(referenced(X.pdf(keywords="old")))), ("l.pdf", "pdf", bytearray(X.pdf(encrypt=True))), ("t.txt", "other", None), ("u.docx", "word", None), (None, "word", None),
    ]
    files = spark.createDataFrame(rows, FILES)
    told = [(r[0], "Accessible") for r in rows if r[0] != "b/x.docx"] + [("b/x.docx", "Not Accessible"), ("nowhere", "Accessible")]
    done = {r.path: r for r in actions.write_statuses(files, spark.createDataFrame(told, "path string, status string"), str(tmp_path / "out"), "me").collect()}
    assert set(done) == {"a/x.docx", "b/x.docx", "d.pptx", "e.pdf", "l.pdf", "t.txt", "u.docx"}
    assert {p for p, r in done.items() if r.error} == {"l.pdf", "t.txt", "u.docx"} and all((r.written is None) == bool(r.error) for r in done.values())

    def value(path, kind):
        found = ooxml.parse(kind, Path(done[path].written).read_bytes())["custom_props"]
        return [p["value"] for p in found if p["name"] == "isAccessible"]

    assert value("a/x.docx", "word") == ["1"] and value("b/x.docx", "word") == ["0"] and value("d.pptx", "powerpoint") == ["1"]
    meta = pdf.parse(Path(done["e.pdf"].written).read_bytes())[0]["pdf_meta"][0]
    assert json.loads(meta["keywords"]) == {"keywords": "old", "isAccessible": "Accessible", "accessibilityStatusUpdatedBy": "me"}
    assert len(list((tmp_path / "out").rglob("*.*"))) == 4
    none = files.where("false")
    assert actions.write_statuses(none, spark.createDataFrame(told, "path string, status string"), str(tmp_path / "none"), "me").count() == 0


def test_comments_are_written(spark, tmp_path):
    files = spark.createDataFrame([("a.docx", "word", bytearray(X.docx([X.para("one"), X.para("two")]))), ("b.docx", "word", bytearray(X.docx([X.para("x")])))], FILES)
    notes = spark.createDataFrame([("a.docx", "two", "second"), ("a.docx", "one", "first"), ("b.docx", "nowhere", "c")], "path string, target string, comment string")
    done = {r.path: r for r in actions.write_comments(files, notes, str(tmp_path)).collect()}
    assert [c["text"] for c in ooxml.parse("word", Path(done["a.docx"].written).read_bytes())["comments"]] == ["first", "second"]
    assert "LookupError" in done["b.docx"].error


def test_report_files(spark, tmp_path):
    rows = [("a/x.pdf", "pdf", "Not Accessible", False), ("b/x.pdf", "pdf", "Accessible", True), ("c/y.pdf", "pdf", "Accessible", True)]
    results = spark.createDataFrame(rows, "path string, kind string, status string, report_passed boolean")
    issues = spark.createDataFrame([("a/x.pdf", "pdf-title", "2.4.2", "Serious", "file", {})], "path string, rule_id string, criterion string, impact string, location string, detail map<string,string>")
    reports = writers.html_reports(results, issues, str(tmp_path))
    done = {r.path: Path(r.written) for r in actions.write_report_files(reports).collect()}
    assert done["c/y.pdf"] == tmp_path / "pdf/y.pdf.html" and len(set(done.values())) == 3
    assert "Set a title" in done["a/x.pdf"].read_text() and "No issues" in done["b/x.pdf"].read_text()


@pytest.fixture
def store():
    """Folder 1 has a good file, a missing one and folder 2; that has a page more, and folder 1 again."""
    good, bad = X.docx([X.para("x")]), X.docx([X.image()])
    names = {10: "good.docx", 11: "gone.docx", 20: "bad.docx", 21: "notes.txt"}
    children = {1: [[10, 11, 2]], 2: [[20, 21], [1]]}
    sent = []

    class Handler(BaseHTTPRequestHandler):
        def give(self, body, code=200, **headers):
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            if self.headers["OTCSTicket"] != "secret":
                return self.give(b"", 401)
            if m := re.fullmatch(r"/api/v1/nodes/(\d+)/nodes(?:\?page=(\d+))?", self.path):
                pages, page = children[int(m[1])], int(m[2] or 1)
                rows = [{"id": n, "type": 144 if n in names else 0, "name": names.get(n, "folder"), "mime_type": None, "size": 1} for n in pages[page - 1]]
                return self.give(json.dumps({"data": rows, "page_total": len(pages)}).encode())
            node = int(self.path.split("/")[4])
            if node == 11:
                return self.give(b"", 404)
            self.give({10: good, 20: bad}[node], Content_Disposition=f'attachment; filename="{names[node]}"')

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if self.path == "/api/v1/auth":
                return self.give(b'{"ticket": "secret"}')
            sent.append((self.path, message_from_bytes(b"Content-Type: " + self.headers["Content-Type"].encode() + b"\r\n\r\n" + body)))
            self.give(b"{}", 500 if "/11/" in self.path else 200)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", sent, good
    server.shutdown()


def test_remote_store(spark, tmp_path, store):
    url, sent, good = store
    who = {"url": url, "user": "u", "password": "p"}
    assert {r.id for r in remote.nodes(spark, nodes="2", **who).collect()} == {20, 21, 1}
    assert {r.id for r in remote.files_of(remote.descend(spark, 1, **who)).collect()} == {10, 11, 20, 21}
    found = api.audit_remote(spark, 1, **who)
    assert {r.path: r.status for r in found.results.collect()} == {"10/good.docx": "Accessible", "11/gone.docx": "Untested", "20/bad.docx": "Not Accessible"}
    assert {r.path for r in api.audit_remote(spark, 1, ("word",), deep=False, **who).results.collect()} == {"10/good.docx", "11/gone.docx"}
    kept = api.record(found, str(tmp_path / "store"), "me").collect()
    assert {(r.path, r.status, r.updated_by) for r in kept} == {("10/good.docx", "Accessible", "me"), ("20/bad.docx", "Not Accessible", "me")}
    files = spark.createDataFrame([(10, 'a "b".docx', bytearray(good)), (11, "c", None)], "id long, name string, content binary").coalesce(1)
    done = {r.id: r for r in remote.upload(files, **who).orderBy(F.col("id")).collect()}
    assert done[10].uploaded and not done[11].uploaded and "500" in done[11].error
    assert [p for p, _ in sent] == ["/api/v1/nodes/10/versions", "/api/v1/nodes/11/versions"]
    parts = {p.get_param("name", header="content-disposition"): p for p in sent[0][1].get_payload()}
    assert parts["file"].get_payload(decode=True) == good and parts["file"].get_filename() == 'a "b".docx'
