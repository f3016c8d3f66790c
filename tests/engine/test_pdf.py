"""The PDF reader: filters, predictors, fonts and forms."""

import base64
import zlib

import pytest

from lumenaudit.sources import pdf
from lumenaudit.sources.pdf_streams import lzw, unfiltered


def build(objects, streams):
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, t) for n, t in objects.items())
    out += b"".join(b"%d 0 obj\n<< /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (n, len(d), k, d) for n, (k, d) in streams.items())
    return out + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


def page(resources, content, streams, kind=b""):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << %s >> >>" % resources}
    return pdf.parse(build(objects, {4: (kind, content)} | streams))


def texts(parsed):
    out, error = parsed
    assert error is None
    return [(t["text"], t["x"], t["y"]) for t in out["text_items"]]


CMAP = b"""1 begincodespacerange <0000> <ffff> endcodespacerange
2 beginbfchar <0001> <0048> <0002> <00660069> endbfchar
2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <D83DDE00>] endbfrange"""


def test_fonts():
    fonts = b"/Font << /F1 << /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R >> /F2 << /Subtype /TrueType /Encoding /WinAnsiEncoding >> /F3 << /Subtype /Type0 >> >>"
    content = b"BT 1 0 0 1 5 6 Tm /F1 9 Tf <00010002001000120021> Tj [<0001> -20 <0099>] TJ q /F2 9 Tf (\x93a\x94) Tj Q <0001> Tj /F3 9 Tf <00010002> Tj /None 9 Tf (b) Tj ET"
    got = [t for t, _, _ in texts(page(fonts, content, {5: (b"", CMAP)}))]
    assert got == ["Hfiac\U0001f600", "H�", "“a”", "H", "��", "b"]


def test_forms():
    form = b"BT 1 0 0 1 1 2 Tm (in) Tj ET /Im Do"
    objects = b"/XObject << /Fm 5 0 R /Im 6 0 R >>"
    streams = {5: (b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 10 20]", form), 6: (b"/Subtype /Image", b"\0")}
    parsed = page(objects, b"q 2 0 0 2 0 0 cm /Fm Do Q BT (out) Tj ET", streams)
    assert texts(parsed) == [("in", 22.0, 44.0), ("out", 0.0, 0.0)]
    assert [i["image_id"] for i in parsed[0]["images"]] == ["Im"]
    endless = page(b"/XObject << /Fm 5 0 R >>", b"/Fm Do", {5: (b"/Subtype /Form", b"/Fm Do")})
    assert "too deep" in endless[1]


def encoded(data):
    """LZW with a clear code before each 200 bytes, so that codes keep nine bits."""
    bits = ""
    for i, byte in enumerate(data):
        bits += ("100000000" if i % 200 == 0 else "") + f"{byte:09b}"
    bits += "100000001"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8)


@pytest.mark.parametrize(
    "name,data",
    [
        (b"/LZWDecode", encoded),
        (b"/ASCIIHexDecode", lambda d: d.hex().encode() + b">"),
        (b"[/ASCII85Decode /FlateDecode]", lambda d: base64.a85encode(zlib.compress(d)) + b"~>"),
        (b"/RunLengthDecode", lambda d: b"".join(bytes([len(d[i : i + 128]) - 1]) + d[i : i + 128] for i in range(0, len(d), 128)) + b"\x80"),
    ],
)
def test_filters(name, data):
    content = b"BT (" + b"a long text " * 40 + b") Tj ET"
    assert texts(page(b"", data(content), {}, b"/Filter " + name)) == [("a long text " * 40, 0.0, 0.0)]


def test_lzw_grows():
    # the example of the format's specification
    assert lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    with pytest.raises(ValueError):
        lzw(bytes.fromhex("FFFFFF"))


def png_rows(rows, step):
    """Each row by another filter."""
    out, above = b"", bytes(len(rows[0]))
    for n, row in enumerate(rows):
        how, coded = n % 5, bytearray()
        for i, x in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded.append((x - (0, a, b, (a + b) // 2, near)[how]) % 256)
        out += bytes([how]) + coded
        above = row
    return out


def test_predictors():
    rows = [bytes((i * 37 + n * n * 11) % 256 for i in range(12)) for n in range(9)]
    info = {"Filter": "FlateDecode", "DecodeParms": {"Predictor": 15, "Columns": 4, "Colors": 3}}
    assert unfiltered(zlib.compress(png_rows(rows, 3)), info) == b"".join(rows)
    tiff = b"".join(bytes((x - (r[i - 3] if i >= 3 else 0)) % 256 for i, x in enumerate(r)) for r in rows)
    assert unfiltered(zlib.compress(tiff), {"Filter": ["FlateDecode"], "DecodeParms": [{"Predictor": 2, "Columns": 4, "Colors": 3}]}) == b"".join(rows)
    with pytest.raises(ValueError):
        unfiltered(zlib.compress(b"\x09abc"), info)
    with pytest.raises(ValueError):
        unfiltered(b"", {"Filter": "JBIG2Decode"})
