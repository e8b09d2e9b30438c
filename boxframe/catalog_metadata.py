"""Registered queries over metadata in JSON, by SQL functions on variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, table
from .functions import registry


def workbooks(s: SparkSession, d: str) -> DataFrame:
    """doc_id, meta: a customer's orders as the metadata of a workbook with a sheet for each status."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("name"), F.col("o_orderdate").cast("date").alias("day"))
    sheets = o.groupBy("doc_id", "name").agg(F.count("*").alias("rows"), F.min("day").alias("first"), F.max("day").alias("last"))
    books = sheets.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "rows"))).alias("sheets"), F.min("first").alias("first"), F.max("last").alias("last"))
    c, swapped = F.col("doc_id"), F.col("doc_id") % 11 == 0
    core = F.struct(
        F.when(c % 5 != 0, F.concat(F.lit("u"), (c % 7).cast("string"))).alias("creator"), F.concat(F.lit("u"), (c % 3).cast("string")).alias("lastModifiedBy"),
        F.when(swapped, F.col("last")).otherwise(F.col("first")).cast("string").alias("created"), F.when(swapped, F.col("first")).otherwise(F.col("last")).cast("string").alias("modified"),
    )
    count = F.struct((F.size("sheets") + F.when(c % 4 == 0, 1).otherwise(0)).alias("sheet_count"))
    return books.select("doc_id", F.to_json(F.struct(core.alias("core"), count.alias("workbook"), "sheets")).alias("meta"))


_BOOKS = "(select o_custkey as doc_id, min(o_orderdate)::date as first, max(o_orderdate)::date as last, count(distinct o_orderstatus) as n, case when o_custkey % 5 <> 0 then 'u' || o_custkey % 7 end as creator, 'u' || o_custkey % 3 as editor from orders group by all)"
_TEMPORAL = "case when first = last then 'untouched' when doc_id % 11 = 0 then 'inverted' else 'ordered' end"


@query(f"select doc_id, case when creator is null then 'anonymous' when creator = editor then 'single_author' else 'several_authors' end as provenance, {_TEMPORAL} as temporal, case when doc_id % 4 = 0 then 'inconsistent' else 'consistent' end as consistency from {_BOOKS}")
def metadata_verdicts(s: SparkSession, d: str) -> DataFrame:
    registry.register(s)
    return workbooks(s, d).selectExpr("doc_id", "bb_provenance(meta) AS provenance", "bb_temporal(meta) AS temporal", "bb_consistency(meta) AS consistency")


@query("select o_custkey as doc_id, (row_number() over (partition by o_custkey order by o_orderstatus) - 1)::int as pos, o_orderstatus as name, count(*)::int as n_rows from orders group by o_custkey, o_orderstatus")
def metadata_sheets(s: SparkSession, d: str) -> DataFrame:
    registry.register(s)
    return s.sql("SELECT w.doc_id, t.pos, t.name, t.n_rows FROM {w} w, LATERAL bb_sheets(w.meta) t", w=workbooks(s, d))


@query(f"select name, value, count(*) as n from (select unnest([{{'name': 'creator', 'value': creator}}, {{'name': 'lastModifiedBy', 'value': editor}}, {{'name': 'created', 'value': (case when doc_id % 11 = 0 then last else first end)::varchar}}, {{'name': 'modified', 'value': (case when doc_id % 11 = 0 then first else last end)::varchar}}], recursive := true) from {_BOOKS}) where value is not null group by all")
def metadata_properties(s: SparkSession, d: str) -> DataFrame:
    """How often each core property has each value."""
    registry.register(s)
    return s.sql("SELECT t.name, t.value, count(*) AS n FROM {w} w, LATERAL bb_properties(w.meta) t GROUP BY ALL", w=workbooks(s, d))


@query(
    """select doc_id, to_json({'checksum': sha256(coalesce(text, '')), 'document_id': 0, 'page_count': 1, 'source_type': 'text'})::varchar as doc,
to_json([{'cell_type': 'string', 'h': 1, 'page_id': 0, 'style_id': 0, 'text': l, 'w': strlen(l), 'x': 1, 'y': i} for l, i in string_split(coalesce(text, ''), chr(10)) if l <> ''])::varchar as boxes from documents"""
)
def json_functions(s: SparkSession, d: str) -> DataFrame:
    """The JSON scalars of text documents, called from SQL on bytes."""
    registry.register(s)
    return table(s, d, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content")).selectExpr("doc_id", "bb_text_doc_json(content) AS doc", "bb_text_json(content) AS boxes")
