"""A small PDF reader: objects, object streams, pages, annotations, images, structure, text places.

Scope: documents that are not encrypted. Objects are found by their own marks, not by the
cross-reference table, so damaged tables do not matter; of repeated objects the last counts. Texts
are decoded by their font's table of Unicode values, or by the standard encoding it names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from .pdf_streams import unfiltered

SPACE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
OBJECT = re.compile(rb"(?<![0-9])(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b")
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Name(str):
    pass


class Word(str):
    """An operator or another bare word."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes

    def data(self) -> bytes:
        return unfiltered(self.raw, self.info)


class Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            c = data[self.at]
            if c in SPACE:
                self.at += 1
            elif c == 0x25:  # a comment
                ends = [e for e in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends, default=n)
            else:
                return

    def value(self):
        """The next value; raises EOFError at the end."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise EOFError
        c = data[at : at + 1]
        if c == b"/":
            return self.name()
        if c == b"(":
            return self.text()
        if data[at : at + 2] == b"<<":
            return self.dictionary()
        if c == b"<":
            end = data.index(b">", at)
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self.until(b"]")
        if c in (b"]", b"}", b"{", b")") or data[at : at + 2] == b">>":
            self.at += 2 if c == b">" else 1
            return Word(c.decode())
        end = at
        while end < len(data) and data[end] not in SPACE and data[end] not in DELIMITERS:
            end += 1
        word = data[at : max(end, at + 1)]
        self.at = at + len(word)
        if re.fullmatch(rb"[+-]?\d+", word):
            again = re.compile(rb"[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![0-9A-Za-z])").match(data, self.at)
            if again and word[:1].isdigit():
                self.at = again.end()
                return Ref(int(word))
            return int(word)
        if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Word(word.decode("latin-1")))

    def name(self) -> Name:
        end = self.at + 1
        while end < len(self.data) and self.data[end] not in SPACE and self.data[end] not in DELIMITERS:
            end += 1
        raw, self.at = self.data[self.at + 1 : end], end
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))

    def text(self) -> bytes:
        out, depth, at, data = bytearray(), 0, self.at, self.data
        while at < len(data):
            c = data[at]
            if c == 0x5C:
                at += 1
                e = data[at] if at < len(data) else 0
                octal = re.compile(rb"[0-7]{1,3}").match(data, at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    at = octal.end()
                    continue
                if e in ESCAPES:
                    out.append(ESCAPES[e])
                elif e == 0x0D and data[at + 1 : at + 2] == b"\n":
                    at += 1
                elif e not in b"\r\n":
                    out.append(e)
            elif c == 0x28:
                depth += 1
                if depth > 1:
                    out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = at + 1
                    return bytes(out)
                out.append(c)
            else:
                out.append(c)
            at += 1
        raise EOFError

    def until(self, end: bytes) -> list:
        out = []
        while True:
            v = self.value()
            if type(v) is Word and v == end.decode():
                return out
            out.append(v)

    def dictionary(self) -> dict:
        self.at += 2
        items = self.until(b">")
        return {str(k): v for k, v in zip(items[::2], items[1::2])}


def decoded(raw) -> str | None:
    """A text string."""
    if not isinstance(raw, bytes):
        return None
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF header")
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        at = 0
        while m := OBJECT.search(data, at):
            at = self.read(data, int(m[1]), m.end())
        for m in re.finditer(rb"\btrailer\b", data):
            try:
                found = Lexer(data, m.end()).value()
                self.trailer |= found if isinstance(found, dict) else {}
            except (EOFError, ValueError):
                continue
        for o in list(self.objects.values()):
            if isinstance(o, Stream) and o.info.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in o.info.items() if k in ("Root", "Info", "Encrypt", "ID")}
        self.encrypted = "Encrypt" in self.trailer
        if not self.encrypted:
            for o in [o for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "ObjStm"]:
                self.unpack(o)

    def read(self, data: bytes, number: int, at: int) -> int:
        """Reads an object and returns where to look for the next."""
        lexer = Lexer(data, at)
        try:
            value = lexer.value()
        except (EOFError, ValueError):
            return at
        lexer.skip()
        if isinstance(value, dict) and data[lexer.at : lexer.at + 6] == b"stream":
            start = lexer.at + 6
            start += 2 if data[start : start + 2] == b"\r\n" else 1
            size = value.get("Length")
            end = start + size if isinstance(size, int) and data[start + size : start + size + 20].lstrip().startswith(b"endstream") else data.find(b"endstream", start)
            end = len(data) if end < 0 else end
            self.objects[number] = Stream(value, data[start:end])
            return end
        self.objects[number] = value
        return lexer.at

    def unpack(self, stream: Stream) -> None:
        data, first = stream.data(), self.get(stream.info.get("First"))
        head = Lexer(data)
        places = [(head.value(), head.value()) for _ in range(self.get(stream.info.get("N")))]
        for number, at in places:
            self.objects.setdefault(number, Lexer(data, first + at).value())

    def get(self, value):
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def dict(self, value) -> dict:
        value = self.get(value)
        return value.info if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def list(self, value) -> list:
        value = self.get(value)
        return value if isinstance(value, list) else [] if value is None else [value]

    def pages(self) -> list[tuple[int | None, dict]]:
        """(object number, page) in order; resources are inherited."""
        out: list[tuple[int | None, dict]] = []
        seen: set[int] = set()

        def walk(node, resources) -> None:
            number = node.number if isinstance(node, Ref) else None
            if number in seen:
                return
            if number is not None:
                seen.add(number)
            d = self.dict(node)
            resources = d.get("Resources", resources)
            if "Kids" in d:
                for kid in self.list(d["Kids"]):
                    walk(kid, resources)
            elif d:
                out.append((number, d | {"Resources": resources}))

        walk(self.dict(self.trailer.get("Root")).get("Pages"), None)
        return out


def multiply(a: tuple, b: tuple) -> tuple:
    """The matrix that applies ``a``, then ``b``."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


#: Standard encodings as Python names them.
ENCODINGS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}
#: Forms in forms: deeper ones are an error of the page.
DEEPEST = 16


class Font:
    """Codes to text. Codes that the table does not have are the replacement character."""

    def __init__(self, doc: Document, info: dict):
        self.wide = doc.get(info.get("Subtype")) == "Type0"
        encoding = doc.get(info.get("Encoding"))
        base = doc.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        self.codec = ENCODINGS.get(str(base))
        self.spaces: list[tuple[bytes, bytes]] = []
        self.chars: dict[bytes, str | None] = {}
        self.ranges: list[tuple[bytes, bytes, object]] = []
        table = doc.get(info.get("ToUnicode"))
        self.table = isinstance(table, Stream)
        if self.table:
            self.learn(table.data())

    def learn(self, data: bytes) -> None:
        lexer, stack = Lexer(data), []
        while True:
            try:
                v = lexer.value()
            except EOFError:
                return
            if type(v) is not Word:
                stack.append(v)
                continue
            if v == "endcodespacerange":
                self.spaces += [(a, b) for a, b in zip(stack[::2], stack[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)]
            elif v == "endbfchar":
                self.chars |= {a: self.unicode(b) for a, b in zip(stack[::2], stack[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif v == "endbfrange":
                self.ranges += [t for t in zip(stack[::3], stack[1::3], stack[2::3]) if isinstance(t[0], bytes) and isinstance(t[1], bytes)]
            stack.clear()

    @staticmethod
    def unicode(raw: bytes) -> str:
        return raw.decode("utf-16-be", "replace")

    def char(self, code: bytes) -> str | None:
        if code not in self.chars:
            self.chars[code] = self.in_ranges(code)
        return self.chars[code]

    def in_ranges(self, code: bytes) -> str | None:
        for low, high, to in self.ranges:
            if len(low) == len(code) and low <= code <= high:
                n = int.from_bytes(code) - int.from_bytes(low)
                if isinstance(to, list):
                    return self.unicode(to[n]) if n < len(to) and isinstance(to[n], bytes) else None
                if isinstance(to, bytes) and to:
                    return self.unicode((int.from_bytes(to) + n & (1 << 8 * len(to)) - 1).to_bytes(len(to)))
        return None

    def size(self, raw: bytes, at: int) -> int:
        for low, high in self.spaces:
            code = raw[at : at + len(low)]
            if len(code) == len(low) and all(a <= c <= b for a, c, b in zip(low, code, high)):
                return len(low)
        return 2 if self.wide else 1

    def text(self, raw: bytes) -> str:
        if not self.table:
            if self.wide:
                return "\ufffd" * (len(raw) // 2)
            return raw.decode(self.codec, "replace") if self.codec else decoded(raw) or ""
        out, at = [], 0
        while at < len(raw):
            code = raw[at : at + self.size(raw, at)]
            char = self.char(code)
            if char is None:
                char = "\ufffd" if self.wide else code.decode(self.codec or "latin-1", "replace")
            out.append(char)
            at += len(code)
        return "".join(out)


def page_content(doc: Document, page: dict) -> tuple[list[tuple[str, float, float]], list[str]]:
    """Texts with the place where they start, and names of images drawn, in order; those of forms
    come where the form is drawn."""
    texts: list[tuple[str, float, float]] = []
    drawn: list[str] = []
    fonts: dict[int, Font] = {}
    data = b"\n".join(s.data() for c in doc.list(page.get("Contents")) if isinstance(s := doc.get(c), Stream))
    draw(doc, data, doc.dict(page.get("Resources")), UNIT, texts, drawn, fonts, 0)
    return texts, drawn


def draw(doc: Document, data: bytes, resources: dict, view: tuple, texts: list, drawn: list, fonts: dict[int, Font], depth: int) -> None:
    """Adds what a content stream shows to ``texts`` and ``drawn``."""
    if depth > DEEPEST:
        raise ValueError("forms too deep")
    objects, named = doc.dict(resources.get("XObject")), doc.dict(resources.get("Font"))
    lexer, stack = Lexer(data), []
    saved, line, leading, font = [], UNIT, 0.0, None

    def show(raw: bytes) -> None:
        at = multiply(line, view)
        texts.append((font.text(raw) if font else decoded(raw) or "", at[4], at[5]))

    while True:
        try:
            v = lexer.value()
        except EOFError:
            return
        if type(v) is not Word:
            stack.append(v)
            continue
        n = [float(x) for x in stack if isinstance(x, (int, float)) and not isinstance(x, bool)]
        if v == "q":
            saved.append((view, font, leading))
        elif v == "Q":
            view, font, leading = saved.pop() if saved else (view, font, leading)
        elif v == "cm" and len(n) == 6:
            view = multiply(tuple(n), view)
        elif v == "BT":
            line = UNIT
        elif v == "Tf" and stack and isinstance(stack[0], Name):
            info = doc.dict(named.get(stack[0]))
            if info and id(info) not in fonts:
                fonts[id(info)] = Font(doc, info)
            font = fonts[id(info)] if info else None
        elif v == "Tm" and len(n) == 6:
            line = tuple(n)
        elif v in ("Td", "TD") and len(n) == 2:
            line = multiply((1.0, 0.0, 0.0, 1.0, *n), line)
            leading = -n[1] if v == "TD" else leading
        elif v == "TL" and n:
            leading = n[0]
        elif v == "T*":
            line = multiply((1.0, 0.0, 0.0, 1.0, 0.0, -leading), line)
        elif v == "Tj" and stack and isinstance(stack[-1], bytes):
            show(stack[-1])
        elif v in ("'", '"') and stack and isinstance(stack[-1], bytes):
            line = multiply((1.0, 0.0, 0.0, 1.0, 0.0, -leading), line)
            show(stack[-1])
        elif v == "TJ" and stack and isinstance(stack[-1], list):
            show(b"".join(x for x in stack[-1] if isinstance(x, bytes)))
        elif v == "Do" and stack and isinstance(stack[-1], Name):
            found = doc.get(objects.get(stack[-1]))
            kind = doc.dict(found).get("Subtype")
            if kind == "Image":
                drawn.append(str(stack[-1]))
            elif kind == "Form" and isinstance(found, Stream):
                matrix = [float(x) for x in map(doc.get, doc.list(found.info.get("Matrix"))) if isinstance(x, (int, float))]
                inside = multiply(tuple(matrix), view) if len(matrix) == 6 else view
                draw(doc, found.data(), doc.dict(found.info.get("Resources")) or resources, inside, texts, drawn, fonts, depth + 1)
        elif v == "ID":  # an inline image: skip its data
            end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?![0-9A-Za-z])").search(data, lexer.at)
            lexer.at = end.end() if end else len(data)
            drawn.append("inline")
        stack.clear()


def inherited(doc: Document, d: dict, key: str):
    for _ in range(32):
        if key in d or "Parent" not in d:
            break
        d = doc.dict(d["Parent"])
    return doc.get(d.get(key))


def annotation(doc: Document, value, page: int, n: int) -> dict:
    d = doc.dict(value)
    rect = [float(x) for x in map(doc.get, doc.list(d.get("Rect"))) if isinstance(x, (int, float))]
    kind, flags = inherited(doc, d, "FT"), inherited(doc, d, "Ff")
    return {
        "page": page, "ann_ord": n, "subtype": str(doc.get(d.get("Subtype")) or "") or None, "url": decoded(doc.get(doc.dict(d.get("A")).get("URI"))),
        "field_type": str(kind) if kind else None, "field_name": decoded(inherited(doc, d, "T")), "alt_text": decoded(inherited(doc, d, "TU")), "field_label": None,
        "field_flags": flags if isinstance(flags, int) else None, "tab_index": None, "rect": [min(rect[0], rect[2]), min(rect[1], rect[3]), max(rect[0], rect[2]), max(rect[1], rect[3])] if len(rect) == 4 else None,
    }


def structure(doc: Document, numbers: dict[int, int]) -> list[dict]:
    """Structure elements in pre-order with the page that they or their content are on."""
    rows: list[dict] = []
    seen: set[int] = set()
    roles = doc.dict(doc.dict(doc.dict(doc.trailer.get("Root")).get("StructTreeRoot")).get("RoleMap"))
    todo = [(doc.dict(doc.trailer.get("Root")).get("StructTreeRoot"), None, None)]
    while todo:
        value, parent, page = todo.pop()
        if isinstance(value, Ref):
            if value.number in seen:
                continue
            seen.add(value.number)
        d = doc.dict(value)
        here = d.get("Pg")
        page = numbers.get(here.number, page) if isinstance(here, Ref) else page
        node = parent
        if "S" in d:
            node = len(rows) + 1
            role = str(doc.get(d["S"]))
            kids = [doc.dict(k).get("Pg") for k in doc.list(d.get("K")) if not isinstance(doc.get(k), int)]
            own = page or next((numbers[k.number] for k in kids if isinstance(k, Ref) and k.number in numbers), None)
            rows.append({"page": own, "node_id": node, "parent_id": parent, "preorder": node, "role": str(roles.get(role, role)), "alt": decoded(doc.get(d.get("Alt")))})
        todo += [(k, node, page) for k in reversed(doc.list(d.get("K"))) if not isinstance(doc.get(k), int)]
    return rows


def parse(data: bytes) -> tuple[dict[str, list[dict]], str | None]:
    """Element rows by table, and what could not be extracted. Encrypted files have metadata rows alone."""
    doc = Document(data)
    root, info = doc.dict(doc.trailer.get("Root")), doc.dict(doc.trailer.get("Info"))
    meta = {"title": None, "language": None, "keywords": None, "author": None, "encrypted": doc.encrypted, "n_pages": None, "xmp": None}
    out: dict[str, list[dict]] = {"pdf_meta": [meta], "text_items": [], "annotations": [], "images": [], "struct_nodes": []}
    if doc.encrypted:
        return out, None
    pages, errors = doc.pages(), []
    if not root or not pages:
        raise ValueError("no pages")
    xmp = doc.get(root.get("Metadata"))
    meta |= {"title": decoded(doc.get(info.get("Title"))), "language": decoded(doc.get(root.get("Lang"))), "keywords": decoded(doc.get(info.get("Keywords"))), "author": decoded(doc.get(info.get("Author"))), "n_pages": len(pages)}
    try:
        meta["xmp"] = xmp.data().decode("utf-8", "replace") if isinstance(xmp, Stream) else None
    except ValueError as e:
        errors.append(str(e))
    numbers = {number: i for i, (number, _) in enumerate(pages, 1) if number is not None}
    for i, (_, page) in enumerate(pages, 1):
        out["annotations"] += [annotation(doc, a, i, n) for n, a in enumerate(doc.list(page.get("Annots")), 1)]
        try:
            texts, drawn = page_content(doc, page)
        except (ValueError, zlib.error) as e:
            errors.append(f"page {i}: {e}")
            continue
        out["text_items"] += [{"page": i, "item_ord": n, "text": t, "x": x, "y": y} for n, (t, x, y) in enumerate(texts, 1)]
        out["images"] += [{"page": i, "img_ord": n, "image_id": name} for n, name in enumerate(drawn, 1)]
    out["struct_nodes"] = structure(doc, numbers)
    return out, "; ".join(errors) or None
