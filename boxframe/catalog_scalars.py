"""Registered queries of scalar forms: guarded casts, letters, days, colours, and the annotation overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, report, table
from .functions import casts
from .plans.oracle_ctes import sql
from .sinks import xfdf
from .sources import grid

_TEXTS = """select o_orderkey as k, unnest([cents, '-' || cents, cents || 'e2', ' +' || o_orderkey || ' ', o_orderkey || '_0', o_orderkey || '99999', o_orderkey || '.5', o_orderkey || 'd', day, replace(day, '-', '/') || ' 7:05', day || 'T10:30:15.25', replace(day, '-', ' ') || ' 23:59:59', day || ' 24:30', substr(day, 1, 7), o_orderpriority]) as t
from (select o_orderkey, o_orderpriority, o_orderdate::date::varchar as day, (round(o_totalprice * 100)::bigint // 100)::varchar || '.' || lpad((round(o_totalprice * 100)::bigint % 100)::varchar, 2, '0') as cents from orders)"""


@query(f"select k, t as text, try_cast(t as integer) as int_value, try_cast(t as bigint) as long_value, try_cast(t as timestamp)::varchar as moment from ({_TEXTS})")
def guarded_integers_and_times(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderdate").cast("date").cast("string").alias("day"), grid.cents(F.col("o_totalprice")).alias("c"))
    key, day, c = F.col("k").cast("string"), F.col("day"), F.col("c")
    texts = [c, F.concat(F.lit("-"), c), F.concat(c, F.lit("e2")), F.concat(F.lit(" +"), key, F.lit(" ")), F.concat(key, F.lit("_0")), F.concat(key, F.lit("99999")), F.concat(key, F.lit(".5")), F.concat(key, F.lit("d")), day]
    texts += [F.concat(F.replace(day, F.lit("-"), F.lit("/")), F.lit(" 7:05")), F.concat(day, F.lit("T10:30:15.25")), F.concat(F.replace(day, F.lit("-"), F.lit(" ")), F.lit(" 23:59:59")), F.concat(day, F.lit(" 24:30")), F.substring(day, 1, 7), F.col("p")]
    t = o.select("k", F.explode(F.array(*texts)).alias("text"))
    return t.select("k", "text", casts.try_integer(F.col("text"), "int").alias("int_value"), casts.try_integer(F.col("text")).alias("long_value"), casts.try_moment(F.col("text")).cast("string").alias("moment"))


@query(
    "select p_partkey as k, case when n >= 702 then chr((65 + (n - 702) // 676 % 26)::int) else '' end || case when n >= 26 then chr((65 + (n - 26) // 26 % 26)::int) else '' end || chr((65 + n % 26)::int) as letters, p_partkey::bigint as number,"
    " (date '1899-12-30' + p_size::int * 700)::varchar as day, printf('rgba(%d,%d,%d,255)', p_size, p_partkey % 256, 7) as color, base64(encode(p_name)) as coded from (select *, (p_partkey - 1)::bigint as n from part where p_partkey between 1 and 18278)"
)
def scalar_forms(s: SparkSession, d: str) -> DataFrame:
    """Column letters (A to ZZZ, their whole range) and back, serial days, colours and base64."""
    k = F.col("p_partkey")
    letters = casts.column_letters(k)
    p = table(s, d, "part").where(k.between(1, 18278))
    return p.select(k.alias("k"), letters.alias("letters"), casts.letters_column(letters).cast("long").alias("number"), casts.excel_day(F.col("p_size") * 700).cast("string").alias("day"), casts.rgba(F.col("p_size"), k % 256, F.lit(7), F.lit(255)).alias("color"), F.base64(F.col("p_name").cast("binary")).alias("coded"))


_PATTERNS = (r"^\d{4}$", r"^\d{2}-?\d{7}$", r"^\$[\d,]+(\.\d{2})?$", r"^[\d,]+\.\d+$", r"^\d{1,2}[a-z]?$", r"^\d+$")
_NAMES = ("year", "ein", "currency", "number", "lineref", "integer", "text")
_COLORS = ("#2563eb", "#dc2626", "#16a34a", "#0d9488", "#ea580c", "#7c3aed", "#94a3b8")
_kind = lambda values: "case " + " ".join(f"when regexp_matches(text, '{p}') then '{v}'" for p, v in zip(_PATTERNS, values, strict=False)) + f" else '{values[-1]}' end"
_HTML = """replace(replace(replace(replace(replace(substr(text, 1, 40), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query(
    sql(
        f"""select doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">' || chr(10) || '<f href="' || doc_id || '.pdf"/>' || chr(10) || '<annots>' || chr(10) || string_agg(a, chr(10) order by page_id, ord) || chr(10) || '</annots>' || chr(10) || '</xfdf>' || chr(10) as xfdf
from (select doc_id, page_id, ord, '<square page="' || page_id || '" rect="' || printf('%.2f,%.2f,%.2f,%.2f', x, 840 - (y + h), x + w, 840 - y) || '" color="' || color || '" interior-color="' || color || '" opacity="0.30" width="0.75" title="' || kind || '"><contents>' || kind || ': ' || {_HTML} || '</contents></square>' as a
from (select * exclude (color), {_kind(_NAMES)} as kind, {_kind(_COLORS)} as color from boxes where trim(text) <> '')) group by doc_id""",
        ["boxes"],
    )
)
def overlay_annotations(s: SparkSession, d: str) -> DataFrame:
    """The overlay of each report: a coloured square over every box, by what its text looks like."""
    b = report(s, d).withColumn("page_height", F.lit(840.0))
    return xfdf.overlay(b, "doc_id", ["page_id", "ord"], F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")))
