"""Annotations to XFDF with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("square", "highlight", "underline", "strikeout", "squiggly", "circle", "text", "freetext")
HEAD = '<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve"><annots>'
TAIL = "</annots></xfdf>"


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def annotation(top_left: Column | None = None) -> Column:
    """One element from page (1-based), x, y, w, h, page_height, type, color, title and contents; y is from the top unless told."""
    flip = F.lit(True) if top_left is None else top_left
    low = F.when(flip, F.col("page_height") - F.col("y") - F.col("h")).otherwise(F.col("y"))
    x0, y0, x1, y1 = F.col("x"), low, F.col("x") + F.col("w"), low + F.col("h")
    kind = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("square")
    rect = F.format_string("%.3f,%.3f,%.3f,%.3f", x0, y0, x1, y1)
    quad = F.format_string("%.3f,%.3f,%.3f,%.3f,%.3f,%.3f,%.3f,%.3f", x0, y1, x1, y1, x0, y0, x1, y0)
    coords = F.when(kind.isin("highlight", "underline", "strikeout"), F.concat(F.lit(' coords="'), quad, F.lit('"'))).otherwise("")
    return F.concat(F.lit("<"), kind, F.lit(' page="'), (F.col("page") - 1).cast("string"), F.lit('" rect="'), rect, F.lit('"'), coords, F.lit(' color="'), escaped(F.col("color")), F.lit('" title="'), escaped(F.col("title")), F.lit('"><contents>'), escaped(F.col("contents")), F.lit("</contents></"), kind, F.lit(">"))


def documents(annots: DataFrame, key: str, order: list[str]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, annotation().alias("__a"))))
    return annots.groupBy(key).agg(F.concat(F.lit(HEAD), F.array_join(F.transform(rows, lambda r: r["__a"]), ""), F.lit(TAIL)).alias("xfdf"))


# What a text is taken for in the overlay, in this order, and its colour.
OVERLAY = (
    ("year", r"^\d{4}\z", "#2563eb"), ("ein", r"^\d{2}-?\d{7}\z", "#dc2626"), ("currency", r"^\$[\d,]+(\.\d{2})?\z", "#16a34a"), ("number", r"^[\d,]+\.\d+\z", "#0d9488"),
    ("lineref", r"^\d{1,2}[a-z]?\z", "#ea580c"), ("integer", r"^\d+\z", "#7c3aed"), ("text", "", "#94a3b8"),
)


def overlay(boxes: DataFrame, key: str, order: list[str], name: Column) -> DataFrame:
    """One document of coloured squares per key, a square for each box with a text: page_id, x, y (from the top), w, h, page_height and text."""
    pick = lambda value: F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(value(d, c))) for d, p, c in OVERLAY])
    rows = boxes.where(F.trim("text") != "").withColumns({"__kind": pick(lambda d, c: d), "__color": pick(lambda d, c: c)})
    html = lambda c: F.replace(escaped(c), F.lit("'"), F.lit("&#x27;"))
    rect = F.format_string("%.2f,%.2f,%.2f,%.2f", "x", F.col("page_height") - (F.col("y") + F.col("h")), F.col("x") + F.col("w"), F.col("page_height") - F.col("y"))
    text = [F.lit('<square page="'), F.col("page_id").cast("string"), F.lit('" rect="'), rect, F.lit('" color="'), F.col("__color"), F.lit('" interior-color="'), F.col("__color")]
    text += [F.lit('" opacity="0.30" width="0.75" title="'), F.col("__kind"), F.lit('"><contents>'), F.col("__kind"), F.lit(": "), html(F.substring("text", 1, 40)), F.lit("</contents></square>")]
    squares = F.array_sort(F.collect_list(F.struct(*order, F.concat(*text).alias("__a"))))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">\n<f href="'), escaped(name), F.lit('"/>\n<annots>\n'))
    return rows.groupBy(key).agg(F.concat(head, F.array_join(F.transform(squares, lambda r: r["__a"]), "\n"), F.lit("\n</annots>\n</xfdf>\n")).alias("xfdf"))
