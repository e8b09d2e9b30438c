"""SQL functions that a session can register: bodies are SQL, which Catalyst inlines into the calling query; nothing runs in Python.

Metadata comes as JSON text and is read as a variant: parsed once, with typed access by path.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The format of bytes by their first ones.
_DETECT = r"""CASE WHEN hex(substring(content, 1, 4)) = '25504446' THEN 'pdf'
  WHEN hex(substring(content, 1, 4)) = '504B0304' THEN IF(instr(decode(substring(content, 1, 4096), 'ISO-8859-1'), 'word/') > 0
    AND (instr(decode(substring(content, 1, 4096), 'ISO-8859-1'), 'xl/') = 0 OR instr(decode(substring(content, 1, 4096), 'ISO-8859-1'), 'word/') < instr(decode(substring(content, 1, 4096), 'ISO-8859-1'), 'xl/')), 'docx', 'xlsx')
  WHEN hex(substring(content, 1, 8)) = 'D0CF11E0A1B11AE1' THEN 'xls'
  WHEN decode(substring(content, 1, 4096), 'ISO-8859-1') RLIKE r'(?i)\A(\xEF\xBB\xBF)?[ \t\n\x0B\f\r]*(<!doctype[ \t\n\x0B\f\r]+html|<html(>|[ \t\n\x0B\f\r]|\z))' THEN 'html' ELSE 'text' END"""
#: Name: (parameters, result, body).
SCALARS: dict[str, tuple[str, str, str]] = {
    "bb_provenance": (
        "meta STRING", "STRING",
        """CASE WHEN try_variant_get(try_parse_json(meta), '$.core.creator', 'string') IS NULL THEN 'anonymous'
  WHEN try_variant_get(try_parse_json(meta), '$.core.creator', 'string') = try_variant_get(try_parse_json(meta), '$.core.lastModifiedBy', 'string') THEN 'single_author' ELSE 'several_authors' END""",
    ),
    "bb_temporal": (
        "meta STRING", "STRING",
        """CASE WHEN try_variant_get(try_parse_json(meta), '$.core.created', 'timestamp') IS NULL OR try_variant_get(try_parse_json(meta), '$.core.modified', 'timestamp') IS NULL THEN 'unknown'
  WHEN try_variant_get(try_parse_json(meta), '$.core.created', 'timestamp') > try_variant_get(try_parse_json(meta), '$.core.modified', 'timestamp') THEN 'inverted'
  WHEN try_variant_get(try_parse_json(meta), '$.core.created', 'timestamp') = try_variant_get(try_parse_json(meta), '$.core.modified', 'timestamp') THEN 'untouched' ELSE 'ordered' END""",
    ),
    "bb_consistency": (
        "meta STRING", "STRING",
        "CASE WHEN size(try_variant_get(try_parse_json(meta), '$.sheets', 'array<variant>')) = try_variant_get(try_parse_json(meta), '$.workbook.sheet_count', 'int') THEN 'consistent' ELSE 'inconsistent' END",
    ),
    "bb_corroboration": (
        "meta STRING, other STRING", "STRING",
        """CASE WHEN try_variant_get(try_parse_json(meta), '$.core.creator', 'string') <=> try_variant_get(try_parse_json(other), '$.core.creator', 'string')
  AND try_variant_get(try_parse_json(meta), '$.core.created', 'timestamp') <=> try_variant_get(try_parse_json(other), '$.core.created', 'timestamp') THEN 'corroborated' ELSE 'independent' END""",
    ),
    "bb_detect": ("content BINARY", "STRING", _DETECT),
    "bb_info": ("content BINARY", "STRING", f"to_json(named_struct('checksum', sha2(content, 256), 'document_id', 0, 'page_count', IF({_DETECT} IN ('text', 'html', 'docx'), 1, NULL), 'source_type', {_DETECT}))"),
    "bb_sha256": ("content BINARY", "STRING", "sha2(content, 256)"),
    "bb_text_doc_json": ("content BINARY", "STRING", "to_json(named_struct('checksum', sha2(content, 256), 'document_id', 0, 'page_count', 1, 'source_type', 'text'))"),
    "bb_text_pages_json": (
        "content BINARY", "STRING",
        """to_json(array(named_struct('document_id', 0, 'height', size(split(decode(content, 'UTF-8'), '\\n')), 'page_id', 0, 'page_number', 1, 'width', array_max(transform(split(decode(content, 'UTF-8'), '\\n'), l -> octet_length(l))))))""",
    ),
    "bb_text_json": (
        "content BINARY", "STRING",
        """to_json(filter(transform(split(decode(content, 'UTF-8'), '\\n'), (l, i) -> IF(l <> '', named_struct('cell_type', 'string', 'h', 1, 'page_id', 0, 'style_id', 0, 'text', l, 'w', octet_length(l), 'x', 1, 'y', i + 1), NULL)), b -> b IS NOT NULL))""",
    ),
}
#: Name: (parameters, columns, body).
TABLES: dict[str, tuple[str, str, str]] = {
    "bb_sheets": ("meta STRING", "pos INT, name STRING, n_rows INT", "SELECT pos, try_variant_get(value, '$.name', 'string'), try_variant_get(value, '$.rows', 'int') FROM variant_explode(try_variant_get(try_parse_json(meta), '$.sheets', 'variant'))"),
    "bb_properties": ("meta STRING", "name STRING, value STRING", "SELECT key, try_cast(value AS STRING) FROM variant_explode(try_variant_get(try_parse_json(meta), '$.core', 'variant'))"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all of them as temporary functions of the session; returns their names."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return [*SCALARS, *TABLES]
