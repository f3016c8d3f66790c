"""Small Word, PowerPoint and PDF files from rows: test documents, and exports of element tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lineage
from ..schema import PARSED
from . import ooxml
from .files import parse_batches, parsed_schema
from .writers import CONTENT_NS, OFFICE_REL, RELS_NS

NAMES = {"w": ooxml.W, "p": ooxml.P, "a": ooxml.A, "r": ooxml.R, "wp": ooxml.WP}
SPACES = " ".join(f'xmlns:{k}="{v[1:-1]}"' for k, v in NAMES.items())


#: What a member's header and its entry in the directory have in common.
MEMBER = struct.Struct("<5H3L2H")


def member(name: str, text: str) -> tuple[bytes, bytes, bytes]:
    """Name, common fields and deflated data of a zip member, dated 1980-01-01."""
    label, raw = name.encode(), text.encode()
    packed = zlib.compress(raw, wbits=-zlib.MAX_WBITS)
    return label, MEMBER.pack(20, 0x800, 8, 0, 33, zlib.crc32(raw), len(packed), len(raw), len(label), 0), packed


CONTENT_TYPES = member("[Content_Types].xml", f'<Types xmlns="{CONTENT_NS}"/>')


def zipped(parts: list[tuple[str, str]]) -> bytes:
    """A zip of the content types and the parts. ``zipfile`` took most of the time of small files."""
    out, directory, at = [], [], 0
    for label, fields, packed in [CONTENT_TYPES, *(member(*p) for p in parts)]:
        directory += [b"PK\1\2\x14\0", fields, struct.pack("<3HLL", 0, 0, 0, 0, at), label]
        out += [b"PK\3\4", fields, label, packed]
        at += 4 + MEMBER.size + len(label) + len(packed)
    entries = b"".join(directory)
    n = len(parts) + 1
    return b"".join([*out, entries, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, len(entries), at, 0)])


def relationships(targets: list[str]) -> str:
    rows = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE_REL}/hyperlink" Target={quoteattr(t)} TargetMode="External"/>' for i, t in enumerate(targets, 1))
    return f'<Relationships xmlns="{RELS_NS}">{rows}</Relationships>'


@lru_cache(4096)
def opening(style: str | None) -> str:
    """Of a paragraph, up to its text."""
    props = f"<w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr>" if style else ""
    return f'<w:p>{props}<w:r><w:t xml:space="preserve">'


def word(row: dict) -> bytes:
    """paragraphs: array<struct(style, text)>."""
    body = "".join([f"{opening(p.get('style'))}{escape(p['text'] or '')}</w:t></w:r></w:p>" for p in row["paragraphs"] or []])
    return zipped([(ooxml.DOCUMENT, f'<w:document xmlns:w="{ooxml.W[1:-1]}"><w:body>{body}</w:body></w:document>')])


def deck(row: dict) -> bytes:
    """slides: array<struct(title, color, text, target, picture)>; null members are left out."""
    parts: list[tuple[str, str]] = []
    for n, s in enumerate(row["slides"] or [], 1):
        shapes = ""
        for kind, text in (("title", s["title"]), (None, s["text"])):
            if text is None:
                continue
            holder = f'<p:ph type="{kind}"/>' if kind else ""
            fill = f"<a:solidFill><a:srgbClr val={quoteattr(s['color'])}/></a:solidFill>" if s["color"] and not kind else ""
            click = '<a:hlinkClick r:id="rId1"/>' if s["target"] and not kind else ""
            shapes += f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="s"/><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:rPr>{fill}{click}</a:rPr><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sp>'
        if s["picture"] is not None:
            shapes += f'<p:pic><p:nvPicPr><p:cNvPr id="2" name="p" descr={quoteattr(s["picture"])}/></p:nvPicPr></p:pic>'
        parts.append((f"ppt/slides/slide{n}.xml", f"<p:sld {SPACES}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"))
        if s["target"]:
            parts.append((f"ppt/slides/_rels/slide{n}.xml.rels", relationships([s["target"]])))
    return zipped(parts)


def literal(text: str | None) -> str:
    return "<FEFF" + (text or "").encode("utf-16-be", "surrogatepass").hex() + ">"


def portable(row: dict) -> bytes:
    """title, language, links: array<struct(url, text)>: one page, a link in each line with its text in the box."""
    links = row["links"] or []
    lines = [f"BT 1 0 0 1 52 {20 * n + 5} Tm {literal(x['text'])} Tj ET" for n, x in enumerate(links, 1) if x["text"]]
    objects = {
        1: "<< /Type /Catalog /Pages 2 0 R" + (f" /Lang {literal(row['language'])}" if row["language"] is not None else "") + " >>",
        2: "<< /Type /Pages /Kids [4 0 R] /Count 1 >>",
        3: "<<" + (f" /Title {literal(row['title'])}" if row["title"] is not None else "") + " >>",
        4: f"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Annots [{' '.join(f'{10 + i} 0 R' for i in range(len(links)))}] >>",
    }
    for i, x in enumerate(links):
        objects[10 + i] = f"<< /Type /Annot /Subtype /Link /Rect [50 {20 * i + 20} 150 {20 * i + 29}] /A << /S /URI /URI {literal(x['url'])} >> >>"
    content = zlib.compress("\n".join(lines).encode())
    out = b"%PDF-1.7\n" + b"".join(f"{n} 0 obj\n{t}\nendobj\n".encode() for n, t in objects.items())
    out += f"5 0 obj\n<< /Length {len(content)} /Filter /FlateDecode >>\nstream\n".encode() + content + b"\nendstream\nendobj\n"
    return out + b"trailer\n<< /Root 1 0 R /Info 3 0 R >>\n%%EOF\n"


def values(array: pa.Array) -> list:
    """As ``to_pylist``, which takes longer to make small documents' rows than they take to become files."""
    if pa.types.is_list(array.type):
        items, at = values(array.flatten()), 0
        out: list = []
        for n in array.value_lengths().to_pylist():
            out.append(None if n is None else items[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(array.type):
        names = [f.name for f in array.type]
        made = [dict(zip(names, v)) for v in zip(*map(values, array.flatten()))]
        return [r if ok else None for r, ok in zip(made, array.is_valid().to_pylist())] if array.null_count else made
    return array.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(array.type) else array.to_pylist()


#: Rows that are made into files together.
AT_ONCE = 64


def build(rows: DataFrame, path: str, kind: str, make: Callable[[dict], bytes], read: bool = False, **columns: Column) -> DataFrame:
    """path, kind, content: a file for each row, made from the columns. read: the parsed rows of these
    files instead, as ``parse_files`` has them; they are read where they are made, so neither their
    contents go through the JVM nor a second Python worker runs beside the first."""
    lineage.bound_batches(rows.sparkSession)
    schema = parsed_schema() if read else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = [values(c) for c in batch.slice(at, AT_ONCE).columns]
                made = [make(dict(zip(batch.schema.names, r))) for r in zip(*part)]
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array([kind] * len(made)), pa.array(made, pa.binary())], ["path", "kind", "content"])

    told = rows.select(F.col(path).cast("string").alias("path"), *[c.alias(n) for n, c in columns.items()])
    if read:
        return told.mapInArrow(lambda batches: parse_batches(work(batches), schema), PARSED)
    return told.mapInArrow(work, "path string, kind string, content binary")
