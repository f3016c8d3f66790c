"""Changes to a PDF as an incremental update: what was there stays, a new part follows it."""

from __future__ import annotations

import re
import struct

from .pdf import Document, Name, Ref, Stream


def written(doc: Document, value) -> bytes:
    """A value as PDF writes it; references are replaced by what they name."""
    value = doc.get(value)
    if value is None or isinstance(value, bool):
        return {None: b"null", True: b"true", False: b"false"}[value]
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^A-Za-z0-9_.+-]", lambda m: b"#%02X" % m[0][0], value.encode("latin-1"))
    if isinstance(value, list):
        return b"[" + b" ".join(written(doc, v) for v in value) + b"]"
    if isinstance(value, dict):
        return b"<< " + b" ".join(written(doc, Name(k)) + b" " + written(doc, v) for k, v in value.items()) + b" >>"
    return str(value).encode()


def with_keywords(data: bytes, keywords: str) -> bytes:
    """The file with its keywords set, the rest of its document information kept.

    ValueError for encrypted files and for those without a cross-reference to go on from.
    """
    doc = Document(data)
    if doc.encrypted:
        raise ValueError("encrypted")
    root = re.findall(rb"/Root\s+(\d+)\s+(\d+)\s+R", data)
    start = re.findall(rb"startxref\s+(\d+)", data)
    if not root or not start:
        raise ValueError("no cross-reference")
    before = int(start[-1])
    tables = [o.info for o in doc.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "XRef"]
    sizes = [d.get("Size") for d in [doc.trailer, *tables]]
    number = max([*doc.objects, *(s - 1 for s in sizes if isinstance(s, int))]) + 1
    raw = keywords.encode("ascii") if keywords.isascii() else b"\xfe\xff" + keywords.encode("utf-16-be")
    info = doc.dict(doc.trailer.get("Info")) | {"Keywords": raw}
    out = data if data.endswith(b"\n") else data + b"\n"
    place = len(out)
    out += b"%d 0 obj\n%s\nendobj\n" % (number, written(doc, info))
    place_of_table = len(out)
    head = b"/Root %s %s R /Info %d 0 R /Prev %d" % (*root[-1], number, before)
    if isinstance(doc.trailer.get("ID"), (list, Ref)):
        head += b" /ID " + written(doc, doc.trailer["ID"])
    if data[before : before + 4] == b"xref":
        out += b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Size %d %s >>\n" % (number, place, number + 1, head)
    else:  # a file whose table is a stream goes on with one
        rows = struct.pack(">BQHBQH", 1, place, 0, 1, place_of_table, 0)
        out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 8 2] /Index [%d 2] /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (number + 1, number + 2, number, len(rows), head, rows)
    return out + b"startxref\n%d\n%%%%EOF\n" % place_of_table
