"""Format detection as Column expressions over bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTML = r"(?i)\A(\xEF\xBB\xBF)?[ \t\n\x0B\f\r]*(<!doctype[ \t\n\x0B\f\r]+html|<html(>|[ \t\n\x0B\f\r]|\z))"
OLE = "d0cf11e0a1b11ae1"


def detect(content: Column) -> Column:
    """pdf, xlsx, docx, xls, html or text by magic bytes; within zip files the first marker in 4096 bytes."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    xl, word = F.instr(head, "xl/"), F.instr(head, "word/")
    zipped = F.when((word > 0) & ((xl == 0) | (word < xl)), "docx").otherwise("xlsx")
    return (
        F.when(F.hex(F.substring(content, 1, 4)) == "25504446", "pdf").when(F.hex(F.substring(content, 1, 4)) == "504B0304", zipped)
        .when(F.lower(F.hex(F.substring(content, 1, 8))) == OLE, "xls").when(head.rlike(HTML), "html").otherwise("text")
    )
