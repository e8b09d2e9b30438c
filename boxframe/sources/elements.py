"""Files as raw elements, and what makes boxes of them.

Python only takes a file apart: an element is a tag or a cell with its own attributes and text, in the file's order, one row each. Where it
stands on the page is found by DataFrame operations: lines are running counts, columns are running spans of a row, merged
cells are tested against their sheet's areas, shared strings are joined, extents are aggregates. A file of any size is many
rows that Spark deals out, spills and orders; nothing holds its boxes together.
"""

from __future__ import annotations

import sys
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.casts import letters_column
from ..plans.store import stored
from . import readers
from .detect import detect
from .text import parsed

for _m in (readers.__name__, __name__):
    cloudpickle.register_pickle_by_value(sys.modules[_m])

#: Elements that a task passes on at a time.
BATCH = 4_096
BOX = ["doc_id", "page_id", "style_id", "x", "y", "w", "h", "cell_type", "vnum", "vbool", "text", "formula"]


def _elements(df: DataFrame, content: str, columns: str, take_apart: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """doc_id, seq and the columns of the elements of every document; documents that cannot be taken apart have none."""
    ddl = f"doc_id long, seq long, {columns}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for key, data in zip(b.column("doc_id").to_pylist(), b.column("__content"), strict=True):
                if not (data := data.as_py()):
                    continue
                for seq, element in enumerate(take_apart(data)):
                    rows.append((key, seq, *element))
                    if len(rows) >= BATCH:
                        yield passed()
                        rows = []
        if rows:
            yield passed()

    return df.select("doc_id", F.col(content).cast("binary").alias("__content")).mapInArrow(each, ddl)


def _before(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def _sum(what: Column, over: Window) -> Column:
    return F.coalesce(F.sum(what).over(over), F.lit(0))


def _boxes(rows: DataFrame, **more: Column) -> DataFrame:
    """rows as boxes: what is not given is a plain string of the only style on the first page."""
    null = lambda kind: F.lit(None).cast(kind)
    given = {"page_id": F.lit(0), "style_id": F.lit(0), "cell_type": F.lit("string"), "vnum": null("double"), "vbool": null("boolean"), "formula": null("string")} | more
    out = rows.withColumns(given)
    return out.select(*[F.col(c).cast("double").alias(c) if c in ("x", "y", "w", "h") else F.col(c) for c in BOX])


# -- HTML -----------------------------------------------------------------------------------------


class _Html(readers._Events):
    """Flow blocks, cells and table rows as they close or open; the parser's own counters are not used."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple] = []
        self.top = self.tops = self.trs = 0

    def _enter(self, tag: str, attrs: dict) -> None:
        depth, table = len(self.open) - 1, self.tables[-1] if self.tables else None
        if tag == "table":
            if table is None:
                self.tops += 1
                self.top = self.tops
            self.trs += 1
            self.tables.append({"row": 0, "depth": depth, "n": 0, "tr": self.trs})
        elif table and tag == "tr":
            self.trs += 1
            table |= {"n": table["n"] + 1, "tr": self.trs}
            if len(self.tables) == 1:
                self.found.append(("tr", self.top, None, None, None, None, depth, None))
        elif table and tag in ("td", "th"):
            self.hold = (depth, "cell", readers._span(attrs.get("colspan")), readers._span(attrs.get("rowspan")), sum(t["n"] for t in self.tables), table["tr"])
        elif tag in readers._FLOW:
            self.hold = (depth, "flow", None, None, None, None)

    def _emit(self) -> None:
        depth, kind, span, rows, up, tr = self.hold
        self.found.append((kind, self.top if self.tables else 0, up, tr, span, rows, depth, "".join(self.text)))
        self.hold, self.text = None, []


def _html(data: bytes) -> Iterator[tuple]:
    p = _Html()
    p.feed(data.decode("utf-8", "replace"))
    p.finish()
    return iter(p.found)


def html(df: DataFrame, content: str = "content") -> DataFrame:
    """Elements of HTML documents: kind (flow, cell, tr), the top-level table (0: none), rows of the open tables so far (up), the row, spans, depth, text."""
    return _elements(df, content, "kind string, top int, up int, tr int, span int, rows int, depth int, text string", _html)


def html_boxes(elements: DataFrame) -> DataFrame:
    """The boxes of HTML elements. Lines outside tables count on from the rows of the tables before; lines within one end with it."""
    text = F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "))
    e = elements.withColumn("text", text)
    line = F.when((F.col("kind") == "flow") & (F.col("text") != ""), 1).otherwise(0)
    doc, table = _before("doc_id"), _before("doc_id", "top")
    e = e.withColumns({"__line": line, "__lines": _sum(F.when(F.col("top") == 0, line).otherwise(0), doc), "__rows": _sum((F.col("kind") == "tr").cast("int"), doc)})
    opened = F.min(F.col("__lines") + F.col("__rows")).over(Window.partitionBy("doc_id", "top"))
    inner = _sum(F.col("__line"), table)
    y = F.when(F.col("kind") == "cell", opened - 1 + F.col("up")).when(F.col("top") == 0, F.col("__lines") + F.col("__rows")).otherwise(opened + inner)
    x = F.when(F.col("kind") == "cell", _sum(F.col("span"), _before("doc_id", "tr"))).otherwise(F.col("depth"))
    e = e.withColumns({"y": y, "x": x}).where("kind = 'cell' or __line = 1")
    return _boxes(e.withColumns({"w": F.coalesce("span", F.octet_length("text")), "h": F.coalesce("rows", F.lit(1))}))


# -- DOCX -----------------------------------------------------------------------------------------


def _docx(data: bytes) -> Iterator[tuple]:
    w = readers._W
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return
    for block in body if body is not None else ():
        if block.tag == f"{w}p":
            yield "p", None, False, readers._docx_text(block)
        elif block.tag == f"{w}tbl":
            for row in block.iterfind(f"{w}tr"):
                yield "tr", None, False, None
                for cell in row.iterfind(f"{w}tc"):
                    span, merge = cell.find(f"{w}tcPr/{w}gridSpan"), cell.find(f"{w}tcPr/{w}vMerge")
                    text = "\n".join(t for t in map(readers._docx_text, cell.iterfind(f"{w}p")) if t)
                    yield "cell", readers._span(span.get(f"{w}val")) if span is not None else 1, merge is not None and merge.get(f"{w}val") is None, text


def docx(df: DataFrame, content: str = "content") -> DataFrame:
    """Elements of DOCX documents: kind (p, tr, cell), span, whether a cell continues the one above, text."""
    return _elements(df, content, "kind string, span int, continued boolean, text string", _docx)


def docx_boxes(elements: DataFrame) -> DataFrame:
    """The boxes of DOCX elements: a paragraph with a text and a table row are a line each; continued cells only take their place."""
    new = (F.col("kind") == "tr") | ((F.col("kind") == "p") & (F.col("text") != ""))
    upto = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = elements.withColumn("y", F.sum(F.when(new, 1).otherwise(0)).over(upto))
    row = F.sum(F.when(F.col("kind") == "tr", 1).otherwise(0)).over(upto)
    e = e.withColumn("__row", row)
    x = F.when(F.col("kind") == "cell", 1 + _sum(F.when(F.col("kind") == "cell", F.col("span")).otherwise(0), _before("doc_id", "__row"))).otherwise(1)
    e = e.withColumn("x", x).where("(kind = 'p' and text != '') or (kind = 'cell' and not continued)")
    return _boxes(e.withColumns({"w": F.coalesce("span", F.octet_length("text")), "h": F.lit(1)}))


# -- XLSX -----------------------------------------------------------------------------------------


def _xlsx(data: bytes, first: int = 0, last: int = 0) -> Iterator[tuple]:
    m = readers._M
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            names = set(z.namelist())
            if "xl/sharedStrings.xml" in names:
                for i, s in enumerate(ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind(f"{m}si")):
                    yield "shared", None, str(i), None, None, readers._unescape("".join(t.text or "" for t in s.iter(f"{m}t"))), None, None, None
            for page, (name, part) in enumerate(readers.workbook_parts(z)):
                if page + 1 < first or 0 < last < page + 1:
                    continue
                yield "sheet", page, name, None, None, part, None, None, None
                if not part:
                    continue
                with z.open(part) as stream:
                    for _, e in ElementTree.iterparse(stream):
                        if e.tag == f"{m}c" and e.get("r"):
                            v, f, inline = e.find(f"{m}v"), e.find(f"{m}f"), e.find(f"{m}is")
                            raw = (v.text or "") if v is not None else "".join(t.text or "" for t in inline.iter(f"{m}t")) if inline is not None else None
                            if raw is not None and e.get("t") in ("str", "inlineStr"):
                                raw = readers._unescape(raw)
                            yield "cell", page, e.get("r"), e.get("t", "n"), int(e.get("s", 0)), raw, f is not None, f.text if f is not None else None, f.get("ref") if f is not None and f.get("t") in ("shared", "array") else None
                            e.clear()
                        elif e.tag == f"{m}mergeCell":
                            yield "merge", page, e.get("ref"), None, None, None, None, None, None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
        return


def xlsx(df: DataFrame, content: str = "content", first: int = 0, last: int = 0) -> DataFrame:
    """Elements of workbooks: kind (shared, sheet, cell, merge), page, ref (a name, index or area), type, style, raw value, formula and the area it fills.

    Of the sheets first to last only, from 1, both included, as far as there are any; 0 is no bound. Others are not unpacked.
    """
    return _elements(df, content, "kind string, page int, ref string, t string, style int, raw string, has_formula boolean, formula string, area string", partial(_xlsx, first=first, last=last))


def _place(ref: Column) -> tuple[Column, Column]:
    """Column and row of A1, from 1."""
    return letters_column(F.regexp_extract(ref, "^([A-Z]+)", 1)), F.regexp_extract(ref, r"^[A-Z]+(\d+)", 1).cast("int")


def _area(ref: Column) -> Column:
    first, last = F.split_part(ref, F.lit(":"), F.lit(1)), F.when(F.contains(ref, F.lit(":")), F.split_part(ref, F.lit(":"), F.lit(2))).otherwise(ref)
    (a, b), (c, d) = _place(first), _place(last)
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))


def xlsx_boxes(elements: DataFrame) -> DataFrame:
    """The boxes of workbook elements (a stored table): cells with a value or a formula that no merged or formula area covers."""
    sheet = ["doc_id", "page"]
    areas = elements.where("kind = 'merge' or area is not null").select(*sheet, "seq", (F.col("kind") == "merge").alias("merge"), _area(F.coalesce("area", "ref")).alias("at"), "ref")
    x0, y0 = _place(F.col("ref"))
    # Where an area starts: a formula's is at its cell, whatever its reference says.
    areas = areas.select(*sheet, F.struct("seq", "merge", "at.*", F.when(F.col("merge"), F.col("at.a")).otherwise(x0).alias("x"), F.when(F.col("merge"), F.col("at.b")).otherwise(y0).alias("y")).alias("area_"))
    # A sheet's areas come to its cells as one array.
    areas = areas.groupBy(*sheet).agg(F.array_sort(F.collect_list("area_")).alias("__areas"))
    cx, cy = _place(F.col("ref"))
    cells = elements.where("kind = 'cell' and (raw is not null or has_formula)").withColumns({"x": cx, "y": cy}).join(areas, sheet, "left")
    every = F.coalesce("__areas", F.array().cast(areas.schema["__areas"].dataType))
    here = lambda a: (a["x"] == F.col("x")) & (a["y"] == F.col("y"))
    inside = lambda a: (F.col("x") >= a["a"]) & (F.col("x") <= a["c"]) & (F.col("y") >= a["b"]) & (F.col("y") <= a["d"])
    # Of areas that start at one cell the last formula's extent counts, else the last merge's.
    own = lambda merge: F.try_element_at(F.filter(every, lambda a: here(a) & (a["merge"] == merge)), F.lit(-1))
    cells = cells.withColumns({"__own": F.coalesce(own(False), own(True)), "__hidden": F.exists(every, inside)}).where("not __hidden or __own is not null")
    shared = elements.where("kind = 'shared'").select(F.col("doc_id").alias("__d"), F.col("ref").alias("__i"), F.col("raw").alias("__shared"))
    index = F.when((F.col("t") == "s") & F.col("raw").rlike(r"^\d+\z"), F.col("raw").cast("long").cast("string"))
    cells = cells.join(shared, (F.col("doc_id") == F.col("__d")) & (index == F.col("__i")), "left")
    kind = F.when(F.col("t").isin("s", "str", "inlineStr"), "string").when(F.col("t") == "b", "bool").when(F.col("t") == "e", "error").otherwise("number")
    raw = F.coalesce("raw", F.lit(""))
    number = F.regexp_extract(raw, r"^\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))", 1)
    size = lambda last, first: F.coalesce(F.col(f"__own.{last}") - F.col(f"__own.{first}") + 1, F.lit(1))
    return _boxes(
        cells.withColumns({"text": F.when(F.col("t") == "s", F.coalesce("__shared", F.lit(""))).otherwise(raw), "w": size("c", "a"), "h": size("d", "b")}),
        page_id=F.col("page"), style_id=F.col("style"), cell_type=kind, vnum=F.when(kind == "number", F.coalesce(number.try_cast("double"), F.lit(0.0))), vbool=F.when(F.col("t") == "b", raw == "1"),
        formula=F.when(F.col("formula") != "", F.concat(F.lit("="), F.col("formula"))),
    )


def xlsx_pages(elements: DataFrame) -> DataFrame:
    """doc_id, page_id, name, width and height of the sheets that have a part; the extent counts empty cells too."""
    x, y = _place(F.col("ref"))
    size = elements.where("kind = 'cell'").groupBy("doc_id", "page").agg(F.max(x).alias("w"), F.max(y).alias("h"))
    sheets = elements.where("kind = 'sheet' and raw != ''").select("doc_id", "page", F.col("ref").alias("name")).join(size, ["doc_id", "page"], "left")
    return sheets.select("doc_id", F.col("page").alias("page_id"), "name", *[F.coalesce(c, F.lit(0)).cast("double").alias(n) for c, n in (("w", "width"), ("h", "height"))])


def text_boxes(df: DataFrame, content: str = "content") -> DataFrame:
    return parsed(df.select("doc_id", F.col(content).cast("binary").alias("content"))).select("doc_id", F.inline("bboxes")).select(BOX)


def boxes(df: DataFrame, content: str = "content") -> DataFrame:
    """The boxes of documents of any format that has a reader, by their first bytes; PDF and XLS have none. A workbook that cannot be read has no box."""
    rows = df.select("doc_id", F.col(content).cast("binary").alias("content")).where(F.octet_length("content") > 0).withColumn("kind", detect(F.col("content")))
    of = lambda kind: rows.where(F.col("kind") == kind).drop("kind")
    return html_boxes(html(of("html"))).unionByName(docx_boxes(docx(of("docx")))).unionByName(xlsx_boxes(stored(xlsx(of("xlsx")), "elements"))).unionByName(text_boxes(of("text")))


def doc(df: DataFrame, content: str = "content") -> DataFrame:
    """The documents themselves, where one page is a document (text, HTML, DOCX): format, checksum and number of pages."""
    data = F.col(content).cast("binary")
    return df.where(F.octet_length(data) > 0).select("doc_id", F.lit(0).alias("document_id"), detect(data).alias("source_type"), F.lit(None).cast("string").alias("filename"), F.sha2(data, 256).alias("checksum"), F.lit(1).alias("page_count"))


def xlsx_sheets(elements: DataFrame) -> DataFrame:
    """doc_id, page_id, name, width, height and merges (the areas in the file's order, null for none) of the sheets that have a part."""
    merges = elements.where("kind = 'merge'").groupBy("doc_id", F.col("page").alias("page_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ref"))), lambda m: m["ref"]).alias("merges"))
    return xlsx_pages(elements).join(merges, ["doc_id", "page_id"], "left")


def headers(df: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, dialect, sha256, size and page_count of documents of any format; a workbook has as many pages as sheets, PDF and XLS an unknown number."""
    rows = df.select("doc_id", F.col(content).cast("binary").alias("content")).where(F.octet_length("content") > 0).withColumn("dialect", detect(F.col("content")))
    sheets = xlsx(rows.where("dialect = 'xlsx'")).where("kind = 'sheet'").groupBy("doc_id").agg(F.count("*").cast("int").alias("sheets"))
    told = rows.select("doc_id", "dialect", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))
    return told.join(sheets, "doc_id", "left").select("doc_id", "dialect", "sha256", "size", F.when(F.col("dialect").isin("text", "html", "docx"), F.lit(1)).otherwise(F.col("sheets")).alias("page_count"))


def page_extent(boxes: DataFrame, last: int = 0) -> DataFrame:
    """doc_id, page_id, width and height of pages that end with their boxes; last is 1 where coordinates start at 1."""
    return boxes.groupBy("doc_id", "page_id").agg(F.max(F.col("x") + F.col("w") - last).alias("width"), F.max(F.col("y") + F.col("h") - last).alias("height"))
