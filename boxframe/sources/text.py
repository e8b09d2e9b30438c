"""Text to boxes with built-in functions: one box per non-empty line, byte widths, 1-based coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BLACK


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


def bboxes(docs: DataFrame) -> DataFrame:
    """Blank lines advance y without a box; a carriage return stays in its line."""
    at = F.lit(0).alias("page_id"), F.lit(0).alias("style_id"), F.lit(1).alias("x"), (F.col("i") + 1).alias("y")
    rest = F.octet_length("line").alias("w"), F.lit(1).alias("h"), F.lit("string").alias("cell_type"), F.col("line").alias("text")
    return _lines(docs).where("line != ''").select("doc_id", *at, *rest)


def pages(docs: DataFrame) -> DataFrame:
    """Width is the longest line in bytes, height the number of lines; no explode is needed."""
    lines = F.split("text", "\n", -1)
    width = F.array_max(F.transform(lines, F.octet_length)).cast("double")
    return docs.where("text is not null").select("doc_id", F.lit(0).alias("page_id"), F.lit(0).alias("document_id"), F.lit(1).alias("page_number"), width.alias("width"), F.size(lines).cast("double").alias("height"))


def doc(docs: DataFrame) -> DataFrame:
    """filename is always null: the unit is a blob."""
    return docs.where("text is not null").select("doc_id", F.lit(0).alias("document_id"), F.lit("text").alias("source_type"), F.lit(None).cast("string").alias("filename"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.lit(1).alias("page_count"))


def fonts(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.lit(0).alias("font_id"), F.lit("monospace").alias("name"))


def styles(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.lit(0).alias("style_id"), F.lit(0).alias("font_id"), F.lit(12.0).alias("font_size"), F.lit(BLACK).alias("color"), F.lit("normal").alias("weight"), F.lit(0).alias("italic"), F.lit(0).alias("underline"))


def words(docs: DataFrame) -> DataFrame:
    """Monospace word boxes: x is the byte offset in the line + 1, w the byte length, lines 12 apart and 10 high.

    The first line is bold and larger, like a heading.
    """
    lines = _lines(docs).where("line != ''").withColumn("t", F.split("line", " "))
    # Offsets are running sums of byte lengths, one pass over a line's words.
    step = lambda a, w: F.struct((a.at + F.octet_length(w) + 1).alias("at"), F.concat(a.out, F.array(F.struct(a.at.alias("at"), w.alias("w")))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,w:string>>").alias("out"))
    out = lines.select("doc_id", "i", F.inline(F.filter(F.aggregate("t", start, step, lambda a: a.out), lambda b: b.w != "")))
    head = F.col("i") == 0
    return out.select(
        "doc_id", F.lit(0).alias("page_id"), (F.col("i").cast("long") * 1_000_000 + F.col("at")).alias("ord"), (F.col("at") + 1).cast("double").alias("x"), ((F.col("i") + 1) * 12).cast("double").alias("y"),
        F.octet_length("w").cast("double").alias("w"), F.lit(10.0).alias("h"), F.col("w").alias("text"), F.when(head, 1).otherwise(0).alias("style_id"), F.when(head, "bold").otherwise("normal").alias("weight"),
        F.when(head, 14.0).otherwise(10.0).alias("font_size"), F.lit("monospace").alias("font_name"), F.lit(BLACK).alias("color"),
    )


def parsed(contents: DataFrame) -> DataFrame:
    """doc_id, doc and bboxes of contents (doc_id, content) that are texts, as documents.parse gives them, by built-in functions only."""
    rows = contents.where(F.col("content").isNotNull()).withColumn("__t", F.decode("content", "UTF-8"))
    none = lambda kind: F.lit(None).cast(kind)
    box = lambda line, i: F.struct(F.lit(0).alias("page_id"), F.lit(0).alias("style_id"), F.lit(1.0).alias("x"), (i + 1.0).alias("y"), F.octet_length(line).cast("double").alias("w"), F.lit(1.0).alias("h"), F.lit("string").alias("cell_type"), none("double").alias("vnum"), none("boolean").alias("vbool"), line.alias("text"), none("string").alias("formula"))
    boxes = F.filter(F.transform(F.split("__t", "\n"), lambda line, i: F.when(line != "", box(line, i))), lambda b: b.isNotNull())
    doc = F.struct(F.lit(0).alias("document_id"), F.lit("text").alias("source_type"), none("string").alias("filename"), F.sha2("content", 256).alias("checksum"), F.lit(1).alias("page_count"))
    return rows.select("doc_id", doc.alias("doc"), boxes.alias("bboxes"))
