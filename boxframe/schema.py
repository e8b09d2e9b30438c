"""Schemas of the five tables and key lists. Every table is keyed by doc_id; other ids are local to a document."""

from __future__ import annotations

DOC = "doc_id long, document_id int, source_type string, filename string, checksum string, page_count int"
PAGES = "doc_id long, page_id int, document_id int, page_number int, width double, height double"
FONTS = "doc_id long, font_id int, name string"
STYLES = "doc_id long, style_id int, font_id int, font_size double, color string, weight string, italic int, underline int"
BBOXES = "doc_id long, page_id int, style_id int, x double, y double, w double, h double, cell_type string, vnum double, vbool boolean, text string, formula string"

#: A box as the analytic operators take it: coordinates, reading order, text and resolved style.
BOX = "doc_id long, page_id int, ord long, x double, y double, w double, h double, text string, style_id int, weight string, font_size double, font_name string, color string"

PAGE_KEY = ["doc_id", "page_id"]
ROW_KEY = [*PAGE_KEY, "row_cluster"]
CELL_KEY = [*ROW_KEY, "cell_id"]
BLACK = "rgba(0,0,0,255)"
