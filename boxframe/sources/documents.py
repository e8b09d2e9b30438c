"""Any BINARY column of documents to the five tables: one parse per document, all tables projected from it."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import readers
from .readers import Parsed, read

for _m in (readers.__name__, __name__):
    cloudpickle.register_pickle_by_value(sys.modules[_m])

PAGE = "page_id int, document_id int, page_number int, width double, height double"
FONT = "font_id int, name string"
STYLE = "style_id int, font_id int, font_size double, color string, weight string, italic int, underline int"
BOX = "page_id int, style_id int, x double, y double, w double, h double, cell_type string, vnum double, vbool boolean, text string, formula string"
DOC = "document_id int, source_type string, filename string, checksum string, page_count int"
PARSED = f"doc_id long, doc struct<{DOC.replace(' ', ':').replace(',:', ', ')}>, pages array<struct<{PAGE.replace(' ', ':').replace(',:', ', ')}>>, fonts array<struct<{FONT.replace(' ', ':').replace(',:', ', ')}>>, styles array<struct<{STYLE.replace(' ', ':').replace(',:', ', ')}>>, bboxes array<struct<{BOX.replace(' ', ':').replace(',:', ', ')}>>"
TABLES = {"doc": DOC, "pages": PAGE, "fonts": FONT, "styles": STYLE, "bboxes": BOX}


def tables_of(p: Parsed, data: bytes) -> dict[str, list[tuple]]:
    return {
        "doc": [(0, p.source_type, None, hashlib.sha256(data).hexdigest(), p.page_count)], "pages": [(i, 0, i + 1, w, h) for i, w, h in p.pages], "fonts": list(enumerate(p.fonts)),
        "styles": [(i, *s) for i, s in enumerate(p.styles)], "bboxes": p.boxes,
    }


def parse(df: DataFrame, content: str = "content", fmt: str = "auto") -> DataFrame:
    """doc_id with doc, pages, fonts, styles and bboxes; unreadable documents have no row. Store it before projecting several tables."""
    schema = to_arrow_schema(StructType.fromDDL(PARSED))
    names = {t: [f.split()[0] for f in ddl.split(", ")] for t, ddl in TABLES.items()}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, data in zip(b.column("doc_id"), b.column("__content"), strict=True):
                data = data.as_py()
                if (p := read(data, fmt)) is not None:
                    t = {k: [dict(zip(names[k], r, strict=True)) for r in v] for k, v in tables_of(p, data).items()}
                    rows.append({"doc_id": key.as_py(), **t, "doc": t["doc"][0]})
                if len(rows) >= 64:  # long documents: few to a batch
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select("doc_id", F.col(content).cast("binary").alias("__content")).mapInArrow(parsed, PARSED)


def table(parsed: DataFrame, name: str) -> DataFrame:
    """One of the five tables of parsed documents."""
    return parsed.select("doc_id", "doc.*") if name == "doc" else parsed.select("doc_id", F.inline(name))


def _function(name: str, fmt: str):
    class Rows:
        def eval(self, content: bytes):
            p = read(content.encode() if isinstance(content, str) else content, fmt)
            if p is not None:
                yield from tables_of(p, content if isinstance(content, bytes) else content.encode())[name]

    return udtf(Rows, returnType=TABLES[name])


def register(spark: SparkSession) -> list[str]:
    """Registers bb[_text|_html|_docx|_xlsx][_doc|_pages|_fonts|_styles] as table functions of bytes, usable laterally; bb..._blob is another name for the boxes."""
    names = []
    for fmt in ("auto", "text", "html", "docx", "xlsx"):
        for name in TABLES:
            sql = "bb" + ("" if fmt == "auto" else f"_{fmt}") + ("" if name == "bboxes" else f"_{name}")
            for n in (sql, f"{sql}_blob") if name == "bboxes" else (sql,):
                spark.udtf.register(n, _function(name, fmt))
                names.append(n)
    return names
