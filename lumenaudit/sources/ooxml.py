"""Word and PowerPoint files to element rows: zip and XML from the standard library, no Spark."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
VT = "{http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes}"
PARA, TEXT, PROPS, STYLE, VAL = (W + name for name in ("p", "t", "pPr", "pStyle", "val"))
CUSTOM, DOCUMENT, COMMENTS = "docProps/custom.xml", "word/document.xml", "word/comments.xml"
SLIDE = re.compile(r"ppt/slides/slide(.*)\.xml$")
SLIDE_RELS = re.compile(r"ppt/slides/_rels/slide(\d+)\.xml\.rels$")


#: Ends of a zip, entries of its directory and headers of its members.
ZIP_END, ZIP_ENTRY, ZIP_HEADER = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
#: Flags that change nothing here: sizes behind the data (the directory has them too), grades of compression, UTF-8 names.
PLAIN_FLAGS = 0x0008 | 0x0006 | 0x0800


def plain_members(data: bytes) -> list[tuple[str, bytes]] | None:
    """Members of a zip of the usual form, several times as fast as ``zipfile``, which most of the time of small
    files went to. None where anything is unusual or wrong: ``zipfile`` then reads it, or tells what is wrong."""
    try:
        mark, *_, size, start, comment = ZIP_END.unpack_from(data, len(data) - ZIP_END.size)
        end = len(data) - ZIP_END.size
        if mark != b"PK\5\6" or comment or start + size != end or data[end - 20 : end - 16] == b"PK\6\7":
            return None
        out, at, last = [], start, 0
        while at < end:
            mark, _, version, flags, method, _, _, crc, packed, full, n, extra, note, _, _, _, offset = ZIP_ENTRY.unpack_from(data, at)
            name = data[at + ZIP_ENTRY.size : at + ZIP_ENTRY.size + n]
            at += ZIP_ENTRY.size + n + note
            if mark != b"PK\1\2" or version & 255 > 20 or flags & ~PLAIN_FLAGS or method not in (0, 8) or extra or b"\0" in name or not (name.isascii() or flags & 0x800) or offset < last or at > end:
                return None
            if name.endswith(b"/"):
                continue
            mark, _, local_flags, _, _, _, _, _, _, m, extra = ZIP_HEADER.unpack_from(data, offset)
            begin = offset + ZIP_HEADER.size + m + extra
            last = begin + packed
            if mark != b"PK\3\4" or local_flags != flags or data[offset + ZIP_HEADER.size : offset + ZIP_HEADER.size + m] != name or last > start:
                return None
            content = data[begin:last]
            if method:
                inflate = zlib.decompressobj(-zlib.MAX_WBITS)
                content = inflate.decompress(content, full + 1)
                if not inflate.eof or inflate.unused_data:
                    return None
            if len(content) != full or zlib.crc32(content) != crc:
                return None
            out.append((name.decode(), content))
        return out
    except (struct.error, zlib.error, UnicodeDecodeError):
        return None


def members(data: bytes) -> list[tuple[str, bytes]]:
    """Name and content of zip members in the order of the directory."""
    found = plain_members(data)
    if found is not None:
        return found
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def custom_props(xml: bytes | None) -> list[dict]:
    """Properties in order; an unreadable part has none."""
    try:
        root = ET.fromstring(xml) if xml else None
    except ET.ParseError:
        root = None
    found = [e for e in root if local(e.tag) == "property"] if root is not None else []
    return [{"ord": i, "name": e.get("name"), "value": (e[0].text or "").strip() if len(e) else None} for i, e in enumerate(found, 1)]


def relationships(xml: bytes) -> list[tuple[str, str, str]]:
    return [(e.get("Id"), e.get("Type") or "", e.get("Target")) for e in ET.fromstring(xml) if local(e.tag) == "Relationship"]


def text_of(node: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def parse_word(parts: dict[str, bytes]) -> dict[str, list[dict]]:
    if DOCUMENT not in parts:
        raise ValueError(f"{DOCUMENT} is missing")
    root = ET.fromstring(parts[DOCUMENT])
    rels = {i: t for i, _, t in relationships(parts["word/_rels/document.xml.rels"])} if "word/_rels/document.xml.rels" in parts else {}
    out: dict[str, list[dict]] = {k: [] for k in ("paragraphs", "runs", "comments", "word_links", "word_images", "word_tables")}
    for n, para in enumerate(root.iter(PARA), 1):
        props = para.find(PROPS)
        style = props.find(STYLE) if props is not None else None
        if style is None and props is not None:
            style = para.find(f"{PROPS}/{STYLE}")  # of second properties
        texts = [t.text or "" for t in para.iter(TEXT)]
        out["paragraphs"].append({"para_ord": n, "style_id": style.get(VAL) if style is not None else None, "text": "".join(texts)})
        for k, text in enumerate(texts, 1):
            out["runs"].append({"slide": 0, "shape_ord": 0, "para_ord": n, "run_ord": k, "text": text, "link_id": None, "color": None})
    for n, link in enumerate(root.iter(f"{W}hyperlink"), 1):
        out["word_links"].append({"link_ord": n, "text": text_of(link, f"{W}t"), "target": rels.get(link.get(f"{R}id"))})
    for n, image in enumerate(root.iter(f"{WP}docPr"), 1):
        out["word_images"].append({"img_ord": n, "descr": image.get("descr")})
    for n, table in enumerate(root.iter(f"{W}tbl"), 1):
        first = table.find(f"{W}tr")
        head = first.find(f"{W}trPr/{W}tblHeader") if first is not None else None
        out["word_tables"].append({"table_ord": n, "header": head is not None and head.get(f"{W}val", "1") not in ("0", "false", "off")})
    if COMMENTS in parts:
        for e in ET.fromstring(parts[COMMENTS]).iter(f"{W}comment"):
            out["comments"].append({"id": int(e.get(f"{W}id") or 0), "author": e.get(f"{W}author"), "text": text_of(e, f"{W}t")})
    return out


def number_of(name: str) -> int | None:
    digits = re.search(r"(\d+)\.xml", name)
    return int(digits[1]) if digits else None


def parse_slides(parts: list[tuple[str, bytes]]) -> dict[str, list[dict]]:
    """Slides are numbered by their order in the zip; relationships are found by the file's own number."""
    out: dict[str, list[dict]] = {k: [] for k in ("slides", "shapes", "runs", "rels")}
    rels = {int(m[1]): data for name, data in parts if (m := SLIDE_RELS.match(name))}
    for slide, (name, data) in enumerate([x for x in parts if SLIDE.match(x[0])], 1):
        number = number_of(name)
        out["slides"].append({"slide": slide, "file_number": number, "part_name": name})
        if number in rels:
            out["rels"] += [{"slide": slide, "rel_ord": i, "rel_id": a, "rel_type": b, "target": c} for i, (a, b, c) in enumerate(relationships(rels[number]), 1)]
        tree = ET.fromstring(data).find(f"{P}cSld/{P}spTree")
        count: dict[str, int] = {}
        for shape in tree if tree is not None else []:
            kind = local(shape.tag)
            if kind not in ("sp", "pic", "graphicFrame"):
                continue
            count[kind] = n = count.get(kind, 0) + 1
            row = {"slide": slide, "kind": kind, "ord": n, "ph_type": None, "descr": None, "is_table": False, "first_row": None}
            if kind == "pic":
                label = shape.find(f"{P}nvPicPr/{P}cNvPr")
                row["descr"] = label.get("descr") if label is not None else None
            elif kind == "sp":
                holder = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                row["ph_type"] = holder.get("type") if holder is not None else None
                out["runs"] += runs_of(shape, slide, n)
            else:
                table = shape.find(f"{A}graphic/{A}graphicData/{A}tbl")
                props = table.find(f"{A}tblPr") if table is not None else None
                row |= {"is_table": table is not None, "first_row": props.get("firstRow") if props is not None else None}
            out["shapes"].append(row)
    return out


def runs_of(shape: ET.Element, slide: int, n: int) -> list[dict]:
    """Runs of a shape; one without any has an empty first run, which is black."""
    rows = []
    for i, para in enumerate(shape.findall(f"{P}txBody/{A}p"), 1):
        for k, run in enumerate(para.findall(f"{A}r"), 1):
            colour, link, text = run.find(f"{A}rPr/{A}solidFill/{A}srgbClr"), run.find(f"{A}rPr/{A}hlinkClick"), run.find(f"{A}t")
            rows.append({"slide": slide, "shape_ord": n, "para_ord": i, "run_ord": k, "text": text.text if text is not None else None, "link_id": link.get(f"{R}id") if link is not None else None, "color": colour.get("val") if colour is not None else None})
    return rows


def parse(kind: str, data: bytes) -> dict[str, list[dict]]:
    """Element rows by table. Raises where the file is not what its kind says."""
    parts = members(data)
    names = dict(parts)
    out = {"parts": [{"part_ord": i, "part_name": n} for i, (n, _) in enumerate(parts, 1)], "custom_props": custom_props(names.get(CUSTOM))}
    return out | (parse_word(names) if kind == "word" else parse_slides(parts))
