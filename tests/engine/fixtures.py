"""Generated office files and PDFs."""

import io
import zipfile
import zlib

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
VT = "http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes"
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"></Types>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>'
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts:
            z.writestr(name, text)
    return out.getvalue()


def properties(*values):
    rows = "".join(f'<property fmtid="x" pid="{i + 2}" name="{n}"><vt:bool>{v}</vt:bool></property>' for i, (n, v) in enumerate(values))
    return f'<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties" xmlns:vt="{VT}">{rows}</Properties>'


def para(text, style=None, split=None):
    pieces = [text] if split is None else [text[:split], text[split:]]
    runs = "".join(f'<w:r><w:t xml:space="preserve">{x}</w:t></w:r>' for x in pieces)
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{props}{runs}</w:p>"


def link(rel, text):
    return f'<w:p><w:hyperlink r:id="{rel}"><w:r><w:t>{text}</w:t></w:r></w:hyperlink></w:p>'


def image(descr=None):
    attr = f' descr="{descr}"' if descr is not None else ""
    return f'<w:p><w:r><w:drawing><wp:inline><wp:docPr id="1" name="x"{attr}/></wp:inline></w:drawing></w:r></w:p>'


def table(header=False):
    head = "<w:trPr><w:tblHeader/></w:trPr>" if header else ""
    return f"<w:tbl><w:tr>{head}<w:tc>{para('cell')}</w:tc></w:tr></w:tbl>"


def docx(body, props=None, comments=None, rels=()):
    parts = [("[Content_Types].xml", TYPES), ("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>")]
    if rels:
        parts.append(("word/_rels/document.xml.rels", RELS % "".join(f'<Relationship Id="{i}" Type="{LINK}" Target="{t}"/>' for i, t in rels)))
    if comments:
        parts.append(("word/comments.xml", f"<w:comments {W}>" + "".join(f'<w:comment w:id="{i}" w:author="a">{para(t)}</w:comment>' for i, t in comments) + "</w:comments>"))
    if props:
        parts.append(("docProps/custom.xml", properties(*props)))
    return zipped(parts)


def shape(text="text", ph=None, color=None, link_id=None):
    holder = f'<p:ph type="{ph}"/>' if ph else ""
    fill = f'<a:solidFill><a:srgbClr val="{color}"/></a:solidFill>' if color else ""
    click = f'<a:hlinkClick r:id="{link_id}"/>' if link_id else ""
    return f"<p:sp><p:nvSpPr><p:cNvPr id='1' name='s'/><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:rPr>{fill}{click}</a:rPr><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"


def picture(descr=None):
    attr = f' descr="{descr}"' if descr is not None else ""
    return f"<p:pic><p:nvPicPr><p:cNvPr id='2' name='p'{attr}/></p:nvPicPr></p:pic>"


def frame(first=None):
    attr = f' firstRow="{first}"' if first is not None else ""
    return f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tblPr{attr}/></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"


def pptx(slides, rels=None, props=None, order=None):
    """slides: shapes by file number; order: of the files in the zip."""
    parts = [("[Content_Types].xml", TYPES)]
    for n in order or sorted(slides):
        parts.append((f"ppt/slides/slide{n}.xml", f"<p:sld {P}><p:cSld><p:spTree>{''.join(slides[n])}</p:spTree></p:cSld></p:sld>"))
    for n, rows in (rels or {}).items():
        parts.append((f"ppt/slides/_rels/slide{n}.xml.rels", RELS % "".join(f'<Relationship Id="{i}" Type="{LINK}" Target="{t}"/>' for i, t in rows)))
    if props:
        parts.append(("docProps/custom.xml", properties(*props)))
    return zipped(parts)


def pdf(pages=1, title=None, lang=None, keywords=None, content=b"", annots=(), figure_alt=None, image=False, encrypt=False, packed=False):
    """annots: of page 1, as PDF dictionaries. packed: small objects go to an object stream."""
    objects = {}
    kids = " ".join(f"{10 + i} 0 R" for i in range(pages))
    root = "<< /Type /Catalog /Pages 2 0 R"
    root += f" /Lang ({lang})" if lang is not None else ""
    root += " /StructTreeRoot 5 0 R" if figure_alt is not None else ""
    objects[1] = root + " >>"
    objects[2] = f"<< /Type /Pages /Kids [{kids}] /Count {pages} >>"
    info = "".join(f" /{k} ({v})" for k, v in (("Title", title), ("Keywords", keywords)) if v is not None)
    objects[3] = f"<<{info} >>"
    if figure_alt is not None:
        objects[5] = "<< /Type /StructTreeRoot /K [6 0 R] >>"
        objects[6] = "<< /S /Document /K [7 0 R 8 0 R] >>"
        objects[7] = "<< /S /P /Pg 10 0 R /K 0 >>"
        objects[8] = f"<< /S /Figure /Pg 10 0 R /Alt ({figure_alt}) /K << /Type /MCR /Pg 10 0 R /MCID 1 >> >>"
    for i in range(pages):
        extra = f" /Annots [{' '.join(annots)}]" if i == 0 and annots else ""
        res = " /Resources << /XObject << /Im1 50 0 R >> >>" if image else ""
        objects[10 + i] = f"<< /Type /Page /Parent 2 0 R /Contents {30 + i} 0 R{extra}{res} >>"
    streams = {30 + i: ("/Filter /FlateDecode", zlib.compress((content if i == 0 else b"") + (b"\nq /Im1 Do Q" if image else b""))) for i in range(pages)}
    if image:
        streams[50] = ("/Type /XObject /Subtype /Image /Width 1 /Height 1", b"\0")
    if packed:
        body, head = b"", []
        for n, text in objects.items():
            head.append(f"{n} {len(body)}")
            body += text.encode("latin-1") + b"\n"
        first = (" ".join(head) + "\n").encode()
        streams[60] = (f"/Type /ObjStm /N {len(objects)} /First {len(first)} /Filter /FlateDecode", zlib.compress(first + body))
        objects = {}
    out = b"%PDF-1.7\n" + b"".join(f"{n} 0 obj\n{t}\nendobj\n".encode("latin-1") for n, t in objects.items())
    out += b"".join(f"{n} 0 obj\n<< /Length {len(d)} {k} >>\nstream\n".encode() + d + b"\nendstream\nendobj\n" for n, (k, d) in streams.items())
    extra = " /Encrypt << /Filter /Standard >>" if encrypt else ""
    return out + f"trailer\n<< /Root 1 0 R /Info 3 0 R{extra} >>\n%%EOF".encode()
