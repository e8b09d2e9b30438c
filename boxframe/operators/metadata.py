"""Metadata of containers as JSON, by Arrow-batched functions over a BINARY column; null for what cannot be read."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import sys
import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.readers import _M, detect, workbook_parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OOXML = ("[Content_Types].xml",)
MAX_DEPTH = 8


def _zip(data: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(BytesIO(data))
    except zipfile.BadZipFile:
        return None


def _leaves(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Local names and texts of a property part."""
    if part not in z.namelist():
        return {}
    return {e.tag.rpartition("}")[2]: e.text for e in ElementTree.fromstring(z.read(part)).iter() if e.text and e.text.strip() and not len(e)}


def xlsx_manifest(data: bytes) -> dict | None:
    """From the central directory only."""
    if (z := _zip(data)) is None:
        return None
    n = z.namelist()
    return {"parts": sorted(n), "worksheets": sum(bool(re.match(r"xl/worksheets/[^/]+\.xml$", x)) for x in n), "tables": sum(x.startswith("xl/tables/") for x in n), "has_vba": "xl/vbaProject.bin" in n, "has_external_links": any(x.startswith("xl/externalLinks/") for x in n), "has_custom_props": "docProps/custom.xml" in n}


def xlsx_sheet_meta(data: bytes) -> list | None:
    """Merges and the dimension of each sheet."""
    if (z := _zip(data)) is None or "xl/workbook.xml" not in z.namelist():
        return None
    out = []
    for name, part in workbook_parts(z):
        root = ElementTree.fromstring(z.read(part)) if part else None
        merges = [m.get("ref") for m in root.iterfind(f"{_M}mergeCells/{_M}mergeCell")] if root is not None else []
        dim = root.find(f"{_M}dimension") if root is not None else None
        out.append({"name": name, "merges": merges, "dimension": dim.get("ref") if dim is not None else None})
    return out


def xlsx_metadata(data: bytes, lean: bool = False) -> dict | None:
    """Properties, workbook flags, sheets, defined names, links and macros; worksheets are read only if not lean."""
    if (z := _zip(data)) is None or "xl/workbook.xml" not in z.namelist():
        return None
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    pr, calc, view, protect = (book.find(f"{_M}{x}") for x in ("workbookPr", "calcPr", "bookViews/" + _M + "workbookView", "workbookProtection"))
    sheets = workbook_parts(z)
    out = {
        "core": _leaves(z, "docProps/core.xml"), "app": _leaves(z, "docProps/app.xml"), "custom": _leaves(z, "docProps/custom.xml"),
        "workbook": {"date1904": pr is not None and pr.get("date1904") in ("1", "true"), "calc_mode": calc.get("calcMode", "auto") if calc is not None else "auto", "active_tab": int(view.get("activeTab", 0)) if view is not None else 0, "protected": protect is not None, "sheet_count": len(sheets)},
        "sheets": [{"name": s.get("name"), "state": s.get("state", "visible")} for s in book.iterfind(f"{_M}sheets/{_M}sheet")],
        "names": [{"name": d.get("name"), "target": d.text} for d in book.iterfind(f"{_M}definedNames/{_M}definedName")],
        "external_links": sorted(x for x in z.namelist() if re.match(r"xl/externalLinks/[^/]+\.xml$", x)), "tables": sorted(x for x in z.namelist() if x.startswith("xl/tables/")),
    }
    vba = z.read("xl/vbaProject.bin") if "xl/vbaProject.bin" in z.namelist() else None
    out["vba"] = {"present": vba is not None, "size": len(vba or b""), "sha256": hashlib.sha256(vba).hexdigest() if vba is not None else None}
    if not lean:
        out["worksheet_parts"] = xlsx_sheet_meta(data)
    return out


def xlsx_vba_base64(data: bytes) -> str | None:
    z = _zip(data)
    return None if z is None else base64.b64encode(z.read("xl/vbaProject.bin")).decode() if "xl/vbaProject.bin" in z.namelist() else ""


def xlsx_style_decode(data: bytes) -> dict | None:
    """Cell formats resolved to fonts, fills and number formats; equal formats share an id in first-seen order."""
    if (z := _zip(data)) is None or "xl/styles.xml" not in z.namelist():
        return None
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    plain = lambda e: {c.tag.rpartition("}")[2]: dict(c.attrib) for c in e} if e is not None else {}
    at = lambda path, i: (lambda a: a[i] if i < len(a) else None)(root.findall(path))
    formats = {f.get("numFmtId"): f.get("formatCode") for f in root.iterfind(f"{_M}numFmts/{_M}numFmt")}
    ids, styles, of = {}, [], []
    for x in root.iterfind(f"{_M}cellXfs/{_M}xf"):
        style = {"numfmt": formats.get(x.get("numFmtId"), x.get("numFmtId")), "font": plain(at(f"{_M}fonts/{_M}font", int(x.get("fontId", 0)))), "fill": plain(at(f"{_M}fills/{_M}fill/{_M}patternFill", int(x.get("fillId", 0)))), "border": plain(at(f"{_M}borders/{_M}border", int(x.get("borderId", 0))))}
        key = json.dumps(style, sort_keys=True)
        if key not in ids:
            ids[key] = len(styles)
            styles.append(style)
        of.append(ids[key])
    return {"styles": styles, "s_to_id": of}


def pdf_metadata(data: bytes) -> dict | None:
    """What the bytes tell without a PDF library: version, pages, encryption, tagging, literal Info strings and XMP."""
    if not data.startswith(b"%PDF"):
        return None
    info = {k: m[1].decode("latin-1") for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped") if (m := re.search(rb"/" + k.encode() + rb"\s*\(((?:[^()\\]|\\.)*)\)", data))}
    xmp = re.search(rb"<x:xmpmeta.*?</x:xmpmeta>", data, re.S)
    return {"info": info, "version": data[5:8].decode("latin-1"), "page_count": len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data)), "encrypted": b"/Encrypt" in data, "tagged": bool(re.search(rb"/Marked\s+true", data)), "xmp": xmp[0].decode("utf-8", "replace") if xmp else None}


def header(data: bytes) -> dict:
    """Dialect, integrity and hash of any document."""
    kind = detect(data)
    pages = {"pdf": lambda: (pdf_metadata(data) or {}).get("page_count"), "xlsx": lambda: len(xlsx_sheet_meta(data) or []) or None}.get(kind, lambda: 1)()
    return {"dialect": kind, "sha256": hashlib.sha256(data).hexdigest(), "size": len(data), "page_count": pages}


def container_walk(data: bytes, path: str = "", depth: int = 0) -> list[dict]:
    """The tree of nested containers as rows; office packages are leaves."""
    kind = "pdf" if data.startswith(b"%PDF") else "ole" if data.startswith(bytes.fromhex("d0cf11e0a1b11ae1")) else "zip" if data.startswith(b"PK\x03\x04") else "xml" if data.lstrip().startswith(b"<?xml") else "other"
    z = _zip(data) if kind == "zip" else None
    package = z is not None and any(n in z.namelist() for n in OOXML)
    out = [{"path": path, "depth": depth, "dialect": "ooxml" if package else kind, "size": len(data), "sha256": hashlib.sha256(data).hexdigest()}]
    if z is not None and not package:
        out[0]["member_count"] = len(z.namelist())
        if depth >= MAX_DEPTH:
            out[0]["truncated"] = "max depth"
            return out
        for n in z.namelist():
            if not n.endswith("/"):
                out += container_walk(z.read(n), f"{path}/{n}", depth + 1)
    return out


FUNCTIONS = {f.__name__: f for f in (xlsx_manifest, xlsx_sheet_meta, xlsx_metadata, xlsx_vba_base64, xlsx_style_decode, pdf_metadata, header, container_walk)}


def as_json(name: str, content: Column) -> Column:
    """One of FUNCTIONS over a BINARY column, as JSON; a document that breaks a parser gives null and not a failed job."""
    function = FUNCTIONS[name]

    def one(data: bytes | None) -> str | None:
        try:
            r = function(data) if data else None
        except (KeyError, ValueError, AttributeError, ElementTree.ParseError, zipfile.BadZipFile):
            return None
        return r if r is None or isinstance(r, str) else json.dumps(r, sort_keys=True)

    def batch(s: pd.Series) -> pd.Series:
        return s.map(lambda d: one(bytes(d)) if d is not None else None)

    return F.pandas_udf(batch, "string")(content)
