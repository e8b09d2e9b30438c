"""Bytes of one document to boxes, in pure Python: text, HTML, DOCX and XLSX.

A reader returns a Parsed or None for bytes that it cannot read. Only the standard library is used; PDF and XLS have no
reader here, as the image has no library for them.
"""

from __future__ import annotations

import re
import zipfile
from dataclasses import dataclass, field
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree

BLACK = "rgba(0,0,0,255)"


@dataclass
class Parsed:
    """pages: (page_id, width, height); boxes: (page_id, style_id, x, y, w, h, cell_type, vnum, vbool, text, formula)."""

    source_type: str
    pages: list[tuple] = field(default_factory=list)
    fonts: list[str] = field(default_factory=list)
    styles: list[tuple] = field(default_factory=list)
    boxes: list[tuple] = field(default_factory=list)
    page_count: int = 1


def _plain(kind: str, font: str, boxes: list[tuple], width: float, height: float) -> Parsed:
    rows = [(0, 0, float(x), float(y), float(w), float(h), "string", None, None, t, None) for x, y, w, h, t in boxes]
    return Parsed(kind, [(0, float(width), float(height))], [font], [(0, 12.0, BLACK, "normal", 0, 0)], rows)


def _bytes(t: str) -> int:
    return len(t.encode())


# -- text -----------------------------------------------------------------------------------------


def read_text(data: bytes) -> Parsed:
    lines = data.decode("utf-8", "replace").split("\n")
    return _plain("text", "monospace", [(1, i, _bytes(t), 1, t) for i, t in enumerate(lines, 1) if t], max(map(_bytes, lines)), len(lines))


# -- HTML -----------------------------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "noscript", "template"))
_FLOW = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre dt dd figcaption caption".split())
#: What a start tag closes, and the elements that the search for it does not leave.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_P_SCOPE = frozenset("table td th caption button html body object".split())
_HEAD = frozenset("base link meta title style script noscript template head".split())


class _Events(HTMLParser):
    """Follows the stack of open elements; text of the outermost flow block or cell is gathered until it closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.tables: list[dict] = []
        self.line = 0
        self.boxes: list[tuple] = []
        self.hold: tuple | None = None  # (depth of the element on the stack, tag, x, y, w, h)
        self.text: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag in _ENDS_P:
            self._close_until({"p"}, _P_SCOPE)
        if tag in _CLOSES:
            self._close_until(*_CLOSES[tag])
        if tag in _VOID:
            return
        self.open.append(tag)
        if tag in _SILENT:
            self.silent += 1
        elif self.hold is None and not self.silent and "title" not in self.open:
            self._enter(tag, dict(attrs))

    def _enter(self, tag: str, attrs: dict) -> None:
        depth, table = len(self.open) - 1, self.tables[-1] if self.tables else None
        if tag == "table":
            self.tables.append({"row": table["row"] if table else self.line - 1, "col": 0, "depth": depth})
        elif table and tag == "tr":
            table["row"] += 1
            table["col"] = 0
        elif table and tag in ("td", "th"):
            w, h = _span(attrs.get("colspan")), _span(attrs.get("rowspan"))
            self.hold = (depth, tag, table["col"], table["row"], w, h)
            table["col"] += w
        elif tag in _FLOW:
            self.hold = (depth, tag, depth, None, None, 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") and "table" in self.open and tag not in self.open[len(self.open) - 1 - self.open[::-1].index("table") :]:
                return
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.hold is not None and not self.silent:
            self.text.append(data)

    def _close_until(self, tags: set, scope: frozenset | set) -> None:
        """Closes the outermost of the tags that is open within the scope, and all in it."""
        found = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in tags:
                found = i
            elif self.open[i] in scope:
                break
        while found is not None and len(self.open) > found:
            self._pop()

    def _pop(self) -> str:
        tag = self.open.pop()
        depth = len(self.open)
        if tag in _SILENT:
            self.silent -= 1
        if self.hold is not None and self.hold[0] == depth:
            self._emit()
        elif self.hold is None and tag == "table" and self.tables and self.tables[-1]["depth"] == depth:
            used = self.tables.pop()
            if not self.tables:
                self.line = used["row"] + 1
        return tag

    def _emit(self) -> None:
        _, tag, x, y, w, h = self.hold
        text = re.sub(r"[ \t\n\x0b\f\r]+", " ", "".join(self.text)).strip(" ")
        self.hold, self.text = None, []
        if y is None:
            if not text:
                return
            y, w = self.line, _bytes(text)
            self.line += 1
        self.boxes.append((x, y, w, h, text))

    def finish(self) -> list[tuple]:
        self.close()
        while self.open:
            self._pop()
        return self.boxes


def _span(value: str | None) -> int:
    return int(value) if value and value.strip().isdigit() and int(value) > 0 else 1


def read_html(data: bytes) -> Parsed:
    """0-based flow lines and table cells. Bare text outside flow blocks and cells has no box."""
    p = _Events()
    p.feed(data.decode("utf-8", "replace"))
    boxes = p.finish()
    return _plain("html", "default", boxes, max((b[0] + b[2] for b in boxes), default=0), max((b[1] + b[3] for b in boxes), default=0))


# -- DOCX -----------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_text(p: ElementTree.Element) -> str:
    piece = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((e.text or "") if e.tag == f"{_W}t" else piece.get(e.tag, "") for e in p.iter())


def read_docx(data: bytes) -> Parsed | None:
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    line, boxes = 0, []
    for block in body if body is not None else ():
        if block.tag == f"{_W}p" and (text := _docx_text(block)):
            line += 1
            boxes.append((1, line, _bytes(text), 1, text))
        elif block.tag == f"{_W}tbl":
            for row in block.iterfind(f"{_W}tr"):
                line, col = line + 1, 1
                for cell in row.iterfind(f"{_W}tc"):
                    span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                    w = _span(span.get(f"{_W}val")) if span is not None else 1
                    merge = cell.find(f"{_W}tcPr/{_W}vMerge")
                    if merge is None or merge.get(f"{_W}val") is not None:
                        boxes.append((col, line, w, 1, "\n".join(t for t in map(_docx_text, cell.iterfind(f"{_W}p")) if t)))
                    col += w
    return _plain("docx", "default", boxes, max((b[0] + b[2] - 1 for b in boxes), default=0), line)


# -- XLSX -----------------------------------------------------------------------------------------

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _cell_at(ref: str) -> tuple[int, int]:
    """A1 -> (column, row), 1-based."""
    m = re.match(r"([A-Z]+)(\d+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return col, int(m[2])


def _area(ref: str) -> tuple[int, int, int, int]:
    a, _, b = ref.partition(":")
    return (*_cell_at(a), *_cell_at(b or a))


def _unescape(t: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), t)


def workbook_parts(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in workbook order; a part that is missing is ''."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in z.namelist() else {}
    out = []
    for s in book.iterfind(f"{_M}sheets/{_M}sheet"):
        target = rels.get(s.get(f"{_R}id"), "")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        out.append((s.get("name", ""), part if part in z.namelist() else ""))
    return out


def _number(t: str) -> float:
    m = re.match(r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", t)
    return float(m[0]) if m else 0.0


def read_sheet(data: bytes, page: int, shared: list[str]) -> tuple[list[tuple], int, int]:
    """Boxes of a worksheet part with its extent. Cells under merges or formula regions have no box of their own."""
    root = ElementTree.fromstring(data)
    merges = [_area(m.get("ref")) for m in root.iterfind(f"{_M}mergeCells/{_M}mergeCell")]
    cells = [(c, *_cell_at(c.get("r"))) for c in root.iter(f"{_M}c") if c.get("r")]
    regions = {(x, y): _area(f.get("ref")) for c, x, y in cells if (f := c.find(f"{_M}f")) is not None and f.get("t") in ("shared", "array") and f.get("ref")}
    hidden = {(x, y) for a, b, e, f in [*merges, *regions.values()] for x in range(a, e + 1) for y in range(b, f + 1)} - {m[:2] for m in merges} - set(regions)
    size = {m[:2]: (m[2] - m[0] + 1, m[3] - m[1] + 1) for m in [*merges, *regions.values()]}
    out, width, height = [], 0, 0
    for c, x, y in cells:
        width, height = max(width, x), max(height, y)
        v, f, kind = c.find(f"{_M}v"), c.find(f"{_M}f"), c.get("t", "n")
        inline = c.find(f"{_M}is")
        if (x, y) in hidden or (v is None and f is None and inline is None):
            continue
        raw = (v.text or "") if v is not None else "".join(t.text or "" for t in inline.iter(f"{_M}t")) if inline is not None else ""
        vnum = vbool = None
        if kind == "s":
            kind, text = "string", shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
        elif kind in ("str", "inlineStr"):
            kind, text = "string", _unescape(raw)
        elif kind == "b":
            kind, text, vbool = "bool", raw, raw == "1"
        elif kind == "e":
            kind, text = "error", raw
        else:
            kind, text, vnum = "number", raw, _number(raw)
        w, h = size.get((x, y), (1, 1))
        formula = f"={f.text}" if f is not None and f.text else None
        out.append((page, int(c.get("s", 0)), float(x), float(y), float(w), float(h), kind, vnum, vbool, text, formula))
    return out, width, height


def read_xlsx(data: bytes) -> Parsed | None:
    """Raw values; style ids are the cells' format indices, without fonts and styles. A missing part leaves a gap in page ids."""
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = [_unescape("".join(t.text or "" for t in s.iter(f"{_M}t"))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind(f"{_M}si")]
            sheets = workbook_parts(z)
            out = Parsed("xlsx", page_count=len(sheets))
            for i, (_, part) in enumerate(sheets):
                if part:
                    boxes, w, h = read_sheet(z.read(part), i, shared)
                    out.pages.append((i, float(w), float(h)))
                    out.boxes += boxes
            return out
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
        return None


# -- dispatch -------------------------------------------------------------------------------------

READERS = {"text": read_text, "html": read_html, "docx": read_docx, "xlsx": read_xlsx}
_SNIFF = re.compile(rb"(?:\xef\xbb\xbf)?[ \t\n\x0b\f\r]*(?:<!doctype[ \t\n\x0b\f\r]+html|<html(?:>|[ \t\n\x0b\f\r]|\Z))", re.I)


def detect(data: bytes) -> str:
    if data.startswith(b"%PDF"):
        return "pdf"
    if data.startswith(b"PK\x03\x04"):
        xl, word = (data[:4096].find(m) for m in (b"xl/", b"word/"))
        return "docx" if word >= 0 and (xl < 0 or word < xl) else "xlsx"
    if data.startswith(bytes.fromhex("d0cf11e0a1b11ae1")):
        return "xls"
    return "html" if _SNIFF.match(data) else "text"


def read(data: bytes | None, fmt: str = "auto") -> Parsed | None:
    """The document by the named or detected format; None if there is no reader or it fails, or for no bytes at all."""
    if not data:
        return None
    reader = READERS.get(detect(data) if fmt == "auto" else fmt)
    return reader(data) if reader else None
