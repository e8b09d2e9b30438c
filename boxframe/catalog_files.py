"""Registered queries over Office files built from tables, fragment and column clustering, and two further join forms."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _MEMBERS, _TOKENS, docs, query, report, table, vocabulary
from .operators import containers, domains, geometry, sequential
from .plans.oracle_ctes import sql
from .plans.store import stored
from .schema import CELL_KEY
from .sources import elements, text

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_BOOK = {
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets><sheet name="Orders" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}"><si><t>Orders</t></si><si><r><t>Pri</t></r><r><t>ority</t></r></si></sst>',
}


def _packed(xml: Column, part: str, others: dict[str, str]) -> Column:
    """The zip archive of a part and constant others."""

    @F.pandas_udf("binary")
    def zipped(parts: pd.Series) -> pd.Series:
        def one(body: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in {**others, part: body}.items():
                    z.writestr(name, content)
            return out.getvalue()

        return parts.map(one)

    return zipped(xml)


def _per_customer(s: SparkSession, d: str, row: Column) -> DataFrame:
    """doc_id and rows, the XML of a customer's orders by key; ``row`` may use r, the order's 1-based place."""
    fields = F.struct("o_orderkey", "o_orderpriority", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    o = table(s, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(fields)).alias("o"))
    each = o.select("doc_id", F.posexplode("o").alias("i", "f")).select("doc_id", (F.col("i") + 1).alias("r"), "f.*")
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", row.alias("xml")))), lambda v: v.xml), "").alias("rows"))


_NUMBERED = "(select o_custkey as doc_id, row_number() over (partition by o_custkey order by o_orderkey) as r, o_orderkey, o_orderpriority, o_orderstatus, round(o_totalprice * 100)::bigint as cents from orders)"


@query(
    f"""select doc_id, x::double as x, y::double as y, w::double as w, 1.0::double as h, text from (
  select distinct doc_id, 1 as x, 1 as y, strlen('Customer ' || doc_id) as w, 'Customer ' || doc_id as text from {_NUMBERED} union all select distinct doc_id, 1, 2, 2, 'Orders' from {_NUMBERED} union all select distinct doc_id, 3, 2, 1, 'Priority' from {_NUMBERED}
  union all select doc_id, 1, r + 2, 1, o_orderkey::varchar from {_NUMBERED} union all select doc_id, 2, r + 2, 1, o_orderstatus || chr(10) || cents from {_NUMBERED} union all select doc_id, 3, r + 2, 1, o_orderpriority from {_NUMBERED} where r = 1
  union all select doc_id, 1, max(r) + 3, 3, 'a' || chr(9) || 'b' from {_NUMBERED} group by doc_id)"""
)
def docx_bboxes(s: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a document with a heading, a table of spanned and merged cells, an empty paragraph and a tab."""
    para = lambda t: F.concat(F.lit("<w:p><w:r><w:t>"), t, F.lit("</w:t></w:r></w:p>"))
    cell = lambda body, pr="": F.concat(F.lit(f"<w:tc><w:tcPr>{pr}</w:tcPr>"), body, F.lit("</w:tc>"))
    last = F.when(F.col("r") == 1, cell(para(F.col("o_orderpriority")), '<w:vMerge w:val="restart"/>')).otherwise(cell(para(F.lit("under")), "<w:vMerge/>"))
    row = F.concat(F.lit("<w:tr>"), cell(para(F.col("o_orderkey").cast("string"))), cell(F.concat(para(F.col("o_orderstatus")), para(F.col("cents").cast("string")))), last, F.lit("</w:tr>"))
    head = F.concat(F.lit("<w:tbl><w:tr>"), cell(para(F.lit("Orders")), '<w:gridSpan w:val="2"/>'), cell(para(F.lit("Priority"))), F.lit("</w:tr>"))
    body = F.concat(F.lit(f'<w:document xmlns:w="{_WORD}"><w:body>'), para(F.concat(F.lit("Customer "), F.col("doc_id"))), F.lit("<w:p/>"), head, F.col("rows"), F.lit("</w:tbl><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>"))
    files = _per_customer(s, d, row).select("doc_id", _packed(body, "word/document.xml", {}).alias("content"))
    return elements.docx_boxes(elements.docx(files)).select("doc_id", "x", "y", "w", "h", "text")


@query(
    f"""select doc_id, style_id, x::double as x, y::double as y, w::double as w, h::double as h, cell_type, vnum::double as vnum, vbool, text, formula from (
  select distinct doc_id, 0 as style_id, 1 as x, 1 as y, 2 as w, 1 as h, 'string' as cell_type, null as vnum, null::boolean as vbool, 'Orders' as text, null::varchar as formula from {_NUMBERED} union all select distinct doc_id, 0, 3, 1, 1, 1, 'string', null, null, 'Priority', null from {_NUMBERED}
  union all select doc_id, 0, 1, r + 1, 1, 1, 'number', o_orderkey, null, o_orderkey::varchar, null from {_NUMBERED} union all select doc_id, 2, 2, r + 1, 1, 1, 'number', cents, null, cents::varchar, null from {_NUMBERED}
  union all select doc_id, 0, 3, r + 1, 1, 1, 'string', null, null, o_orderpriority, null from {_NUMBERED} union all select doc_id, 0, 4, r + 1, 1, 1, 'bool', null, o_orderstatus = 'F', (o_orderstatus = 'F')::int::varchar, null from {_NUMBERED}
  union all select doc_id, 0, 5, r + 1, 1, 1, 'number', 2 * cents, null, (2 * cents)::varchar, '=B' || (r + 1) || '*2' from {_NUMBERED})"""
)
def xlsx_bboxes(s: SparkSession, d: str) -> DataFrame:
    """Cells of the workbooks."""
    return elements.xlsx_boxes(stored(elements.xlsx(workbooks(s, d)), "elements")).drop("page_id")


@query(f"select doc_id, 0 as page_id, 'Orders' as name, 5.0::double as width, (count(*) + 1)::double as height, 'A1:B1' as merges from {_NUMBERED} group by doc_id")
def xlsx_sheets(s: SparkSession, d: str) -> DataFrame:
    """Sheets of the workbooks with their extent and merged areas."""
    return elements.xlsx_sheets(elements.xlsx(workbooks(s, d))).withColumn("merges", F.array_join("merges", ","))


def workbooks(s: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a workbook: a merged title of shared strings, numbers, inline strings, booleans and formulas."""
    y = (F.col("r") + 1).cast("string")
    c = lambda col, attrs, body: F.concat(F.lit(f'<c r="{col}'), y, F.lit(f'"{attrs}>'), body, F.lit("</c>"))
    v = lambda x: F.concat(F.lit("<v>"), x.cast("string"), F.lit("</v>"))
    cells = [
        c("A", "", v(F.col("o_orderkey"))), c("B", ' s="2"', v(F.col("cents"))), c("C", ' t="inlineStr"', F.concat(F.lit("<is><t>"), F.col("o_orderpriority"), F.lit("</t></is>"))),
        c("D", ' t="b"', v((F.col("o_orderstatus") == "F").cast("int"))), c("E", "", F.concat(F.lit("<f>B"), y, F.lit("*2</f>"), v(2 * F.col("cents")))),
    ]
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>9</v></c><c r="C1" t="s"><v>1</v></c></row>'
    row = F.concat(F.lit("<row>"), *cells, F.lit("</row>"))
    body = F.concat(F.lit(f'<worksheet xmlns="{_MAIN}"><sheetData>{head}'), F.col("rows"), F.lit('</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'))
    return _per_customer(s, d, row).select("doc_id", _packed(body, "xl/worksheets/sheet1.xml", _BOOK).alias("content"))


_SPACED = "(select doc_id, page_id, (y / 12)::bigint as row_cluster, ord, x * 4 as x, w * 3 + case when w % 3 = 0 then w + 2 else 0 end as w, h, text from word_boxes)"


@query(
    sql(
        f"""select doc_id, page_id, row_cluster, cell_id::bigint as cell_id, min(x) as x, max(x + w) - min(x) as w, string_agg(case when first or gap <= h * 0.3 then text else ' ' || text end, '' order by x, ord) as text from (
  select *, gap is null or gap >= greatest(h * 0.8, 3) as first, sum(case when gap is null or gap >= greatest(h * 0.8, 3) then 1 else 0 end) over (partition by doc_id, page_id, row_cluster order by x, ord) as cell_id from (
    select *, x - lag(x + w) over (partition by doc_id, page_id, row_cluster order by x, ord) as gap from {_SPACED})) group by all""".replace("group by all", "group by doc_id, page_id, row_cluster, cell_id"),
        ["word_boxes"],
    )
)
def fragment_cells(s: SparkSession, d: str) -> DataFrame:
    """Words set apart by two to some units, so that some merge, some with a space, and some do not."""
    w = F.col("w") * 3 + F.when(F.col("w") % 3 == 0, F.col("w") + 2).otherwise(0)
    b = text.words(docs(s, d)).withColumns({"row_cluster": (F.col("y") / 12).cast("long"), "x": F.col("x") * 4, "w": w})
    return sequential.merged_fragments(b).select(*CELL_KEY, "x", "w", "text")


@query(
    sql(
        """select doc_id, page_id, ord, max(id) as col_cluster from boxes join (
  with recursive u as materialized (select distinct doc_id, page_id, x from boxes), g as (select *, x - lag(x) over (partition by doc_id, page_id order by x) as gap from u),
  t as materialized (select doc_id, page_id, min(x) as x0, coalesce(list_sort(list(gap) filter (gap is not null))[(count(gap) // 2 + 1)::int] * 0.3, 1.0) as tol from g group by all),
  s(doc_id, page_id, start, tol, id) as (select doc_id, page_id, x0, tol, 1 from t union all select s.doc_id, s.page_id, min(u.x), any_value(tol), any_value(id) + 1 from s join u on u.doc_id = s.doc_id and u.page_id = s.page_id and u.x > s.start + s.tol group by s.doc_id, s.page_id)
  select * from s) using (doc_id, page_id) where x >= start group by doc_id, page_id, ord""",
        ["boxes"],
    )
)
def column_clusters(s: SparkSession, d: str) -> DataFrame:
    return sequential.column_clusters(report(s, d)).select("doc_id", "page_id", "ord", "col_cluster")


_SCOPED_RULES = [("default", "base", 1), ("1-URGENT", "fast", 3), ("1-URGENT", "call", 2), ("5-LOW", "slow", -1)]


@query(f"select o_orderkey, rule, points from orders join (values {', '.join(map(str, _SCOPED_RULES))}) as r(scope, rule, points) on scope = 'default' or scope = o_orderpriority")
def join_disjunction(s: SparkSession, d: str) -> DataFrame:
    """A join on either of two conditions as one equi join: each row offers both keys, distinct ones once."""
    rules = s.createDataFrame(_SCOPED_RULES, "scope string, rule string, points int")
    o = table(s, d, "orders").select("o_orderkey", F.explode(F.array_distinct(F.array(F.lit("default"), "o_orderpriority"))).alias("scope"))
    return o.join(rules, "scope").select("o_orderkey", "rule", "points")


@query(sql(f"select doc_id, page_id, row_cluster, cell_id, t.token from {_TOKENS} t left join {_MEMBERS} m on t.token = m.token where m.token is null", ["cells"]))
def tokens_without_domain(s: SparkSession, d: str) -> DataFrame:
    """The negative space of the vocabularies: tokens that none of them has, with their cells."""
    return domains.unknown_tokens(geometry.document_cells(report(s, d)), CELL_KEY, vocabulary(s, d))


def _archive(inner: Column, note: Column, sheet: Column) -> Column:
    """An archive of an archive, a note, a folder and a workbook."""

    @F.pandas_udf("binary")
    def packed(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        def one(*contents: bytes | str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for name, content in zip(("deep/inner.zip", "note.xml", "book.xlsx", "deep/"), (*contents, b""), strict=True):
                    z.writestr(name, content)
            return out.getvalue()

        return pd.Series([one(*x) for x in zip(a, b, c, strict=True)])

    return packed(inner, note, sheet)


@query(
    """select doc_id, path, depth, dialect, size, sha256, member_count from (select o_custkey as doc_id, string_agg(o_orderkey || chr(10), '' order by o_orderkey) as body, '<?xml version="1.0"?><n>' || count(*) || '</n>' as note from orders group by o_custkey) o,
lateral (values ('', 0, 'zip', null, null, 4), ('/deep/inner.zip', 1, 'zip', null, null, 1), ('/deep/inner.zip/orders.txt', 2, 'other', strlen(body), sha256(body), null), ('/note.xml', 1, 'xml', strlen(note), sha256(note), null), ('/book.xlsx', 1, 'ooxml', null, null, 2)) as t(path, depth, dialect, size, sha256, member_count)"""
)
def container_tree(s: SparkSession, d: str) -> DataFrame:
    """Each customer's orders in archives within archives, and the tree of what is found in them. Archives are told without size and hash."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    body = F.array_join(F.transform("k", lambda k: F.concat(k.cast("string"), F.lit("\n"))), "")
    note = F.concat(F.lit('<?xml version="1.0"?><n>'), F.size("k").cast("string"), F.lit("</n>"))
    book = _packed(F.lit("<x/>"), "[Content_Types].xml", {"xl/other.xml": "<x/>"})
    files = o.select("doc_id", _archive(_packed(body, "orders.txt", {}), note, book).alias("content"))
    t = containers.walk(files)
    known = lambda c: F.when(F.col("dialect").isin("other", "xml"), F.col(c)).alias(c)
    return t.select("doc_id", "path", "depth", "dialect", known("size"), known("sha256"), "member_count")
