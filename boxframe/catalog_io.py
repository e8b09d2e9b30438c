"""Registered queries of readers, sinks, metadata, streams, evaluation and the relational forms of the host SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import docs, query, report, table
from .functions import casts
from .operators import containers, evaluate, geometry
from .plans.oracle_ctes import sql
from .plans.store import stored
from .schema import PAGE_KEY
from .sinks import json as json_sink
from .sinks import xfdf as xfdf_sink
from .sources import documents, elements, text
from .streaming import boxes as streams

# -- readers over bytes ---------------------------------------------------------------------------


def html_pages(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").cast("binary").alias("content"))
    return stored(documents.parse(p), "parsed")


# The pages have headings, list items and paragraphs, some cut off, but no tables: blocks are what stands between block tags.
_BLOCK = "p|li|h1|h2|h3|h4|h5|h6|ul|ol|nav|div|article|section|footer|header|body|html|head"
_HTML = rf"""with plain as (select page_id, regexp_replace(regexp_replace(html, '<(script|style|title)\b[^>]*>.*?</(script|style|title)>', '', 'gs'), '<!--.*?-->', '', 'gs') as t from pages),
pieces as (select page_id, i, p[i] as piece from (select page_id, p, unnest(range(2, len(p) + 1)) as i from (select page_id, string_split(regexp_replace(t, '<(/?({_BLOCK}))(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), chr(1)) as p from plain))),
blocks as (select page_id, i, split_part(piece, chr(2), 1) as tag, regexp_replace(split_part(piece, chr(2), 2), '<[^>]*>', '', 'g') as raw from pieces),
texts as (select page_id, i, tag, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '\u00A9'), '&amp;?', '&', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) as text from blocks where tag in ('p', 'li', 'h1'))
select page_id as doc_id, 0 as page_id, 0 as style_id, case when tag = 'li' then 2.0 else 1.0 end::double as x, (row_number() over (partition by texts.page_id order by i) - 1)::double as y, strlen(text)::double as w, 1.0::double as h, 'string' as cell_type, null::double as vnum, null::boolean as vbool, text, null::varchar as formula
from texts where text <> ''"""


@query(_HTML)
def html_bboxes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").cast("binary").alias("content"))
    return elements.html_boxes(elements.html(p))


@query(f"select -1 - doc_id as doc_id, x, y, w, text from ({_HTML}) h union all " + sql("select doc_id, 1.0::double, (i + 1)::double, strlen(line)::double, line from lines where line <> ''", ["lines"]).replace("with lines as materialized (", "select * from (with lines as materialized (", 1) + ") t")
def auto_bboxes(s: SparkSession, d: str) -> DataFrame:
    """Contents of two formats in one column, each read by its own reader."""
    pages = table(s, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").cast("binary").alias("content"))
    both = docs(s, d).select("doc_id", F.col("text").cast("binary").alias("content")).unionByName(pages)
    return elements.boxes(both).select("doc_id", "x", "y", "w", "text")


@query("select page_id as doc_id, 0 as document_id, 'html' as source_type, null::varchar as filename, sha256(html) as checksum, 1 as page_count from pages")
def html_doc(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").cast("binary").alias("content"))
    return elements.doc(p)


@query("select page_id as doc_id, 0 as style_id, 0 as font_id, 12.0::double as font_size, 'rgba(0,0,0,255)' as color, 'normal' as weight, 0 as italic, 0 as underline, 'default' as name from pages")
def html_styles(s: SparkSession, d: str) -> DataFrame:
    p = html_pages(s, d)
    return documents.table(p, "styles").join(documents.table(p, "fonts"), ["doc_id", "font_id"])


@query(sql("select doc_id, 0 as page_id, 0 as style_id, 1.0::double as x, (i + 1)::double as y, strlen(line)::double as w, 1.0::double as h, 'string' as cell_type, null::double as vnum, null::boolean as vbool, line as text, null::varchar as formula from lines where line <> ''", ["lines"]))
def text_bboxes_of_bytes(s: SparkSession, d: str) -> DataFrame:
    """The reader over bytes, whose result the built-in formulation must equal."""
    return documents.table(documents.parse(docs(s, d).select("doc_id", F.col("text").cast("binary").alias("content")), fmt="text"), "bboxes")


@query(sql("select doc_id, count(*) as boxes, sum(strlen(line))::bigint as bytes from lines where line <> '' group by doc_id", ["lines"]))
def text_boxes_lateral(s: SparkSession, d: str) -> DataFrame:
    """The table function bb_text called laterally: many blobs in one query."""
    documents.register(s)
    return s.sql("select d.doc_id, count(*) as boxes, cast(sum(b.w) as bigint) as bytes from {docs} d, lateral bb_text(cast(d.text as binary)) b group by d.doc_id", docs=docs(s, d))


@query("select doc_id, 'text' as dialect, sha256(text) as sha256, strlen(text)::bigint as size, 1 as page_count from documents where text <> '' union all select -1 - page_id, 'html', sha256(html), strlen(html), 1 from pages where html <> ''")
def document_headers(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").cast("binary").alias("content"))
    return elements.headers(docs(s, d).select("doc_id", F.col("text").cast("binary").alias("content")).unionByName(pages))


@query("select doc_id, '' as path, 0 as depth, 'other' as dialect, strlen(text)::bigint as size from documents where text <> ''")
def container_rows(s: SparkSession, d: str) -> DataFrame:
    return containers.walk(docs(s, d), "text").select("doc_id", "path", "depth", "dialect", "size")


# -- sinks ----------------------------------------------------------------------------------------


@query(sql("select doc_id, len(j) as n, j[1]->>'text' as first_text, (j[1]->>'y')::int as first_y, j[-1]->>'text' as last_text from (select doc_id, list(to_json(struct_pack(text := line, y := i + 1)) order by i) as j from lines where line <> '' group by doc_id)", ["lines"]))
def bboxes_json(s: SparkSession, d: str) -> DataFrame:
    j = json_sink.table(text.bboxes(docs(s, d)), "doc_id", ["page_id", "style_id", "x", "y", "w", "h", "cell_type", "text"], ["y"])
    a = j.withColumn("a", F.from_json("json", "array<struct<text:string,y:int>>"))
    return a.select("doc_id", F.size("a").alias("n"), F.col("a")[0].text.alias("first_text"), F.col("a")[0].y.alias("first_y"), F.element_at("a", -1).text.alias("last_text"))


@query(sql("select doc_id, page_id, x, y, w, h, text from boxes", ["boxes"]))
def columnar_json(s: SparkSession, d: str) -> DataFrame:
    """Round trip through columnar JSON."""
    b = report(s, d).withColumn("page", F.struct("doc_id", "page_id"))
    j = json_sink.columnar(b, "page", ("x", "y", "w", "h", "text"))
    return json_sink.from_columnar(j, {"x": "double", "y": "double", "w": "double", "h": "double", "text": "string"}).select("page.*", "x", "y", "w", "h", "text")


_E = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_XFDF = f"""select doc_id, '{xfdf_sink.HEAD}' || string_agg('<' || k || ' page="' || page_id || '" rect="' || printf('%.3f,%.3f,%.3f,%.3f', x, 800 - y - h, x + w, 800 - y) || '"' ||
  case when k = 'highlight' then ' coords="' || printf('%.3f,%.3f,%.3f,%.3f,%.3f,%.3f,%.3f,%.3f', x, 800 - y, x + w, 800 - y, x, 800 - y - h, x + w, 800 - y - h) || '"' else '' end || ' color="#FF0000" title="' || {_E} || '"><contents>' || {_E} || '</contents></' || k || '>', '' order by ord) || '{xfdf_sink.TAIL}' as xfdf
from (select *, case when weight = 'bold' then 'highlight' else 'square' end as k from boxes) group by doc_id"""


@query(sql(_XFDF, ["boxes"]))
def xfdf(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("weight") == "bold", "highlight").otherwise("other")
    a = report(s, d).select("doc_id", "ord", (F.col("page_id") + 1).alias("page"), "x", "y", "w", "h", F.lit(800.0).alias("page_height"), kind.alias("type"), F.lit("#FF0000").alias("color"), F.col("text").alias("title"), F.col("text").alias("contents"))
    return xfdf_sink.documents(a, "doc_id", ["ord"])


# -- streams --------------------------------------------------------------------------------------


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(s: SparkSession, d: str) -> DataFrame:
    return streams.tumbling_counts(events(s, d))


@query("select w as window_start, count(*) as n from (select unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as w from events) group by w")
def stream_sliding(s: SparkSession, d: str) -> DataFrame:
    return streams.sliding_counts(events(s, d))


@query(
    "select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from (select *, sum(case when g is null or g >= interval '30 minutes' then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as k"
    " from (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as g from events)) group by user_id, k"
)
def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    return streams.sessions(events(s, d))


# -- evaluation -----------------------------------------------------------------------------------


@query("select lang, round(corr(a, b), 6) as rho, count(*) as n from (select lang, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0::double as a, rank() over (partition by lang order by doc_id) as b from documents where n_chars is not null) group by lang")
def spearman(s: SparkSession, d: str) -> DataFrame:
    return evaluate.spearman(table(s, d, "documents"), ["lang"], "n_chars", "doc_id")


@query("select lang, sum(case when p > n_chars then 1 else 0 end)::bigint as inversions from (select lang, n_chars, lag(n_chars) over (partition by lang order by doc_id) as p from documents) group by lang")
def inversions(s: SparkSession, d: str) -> DataFrame:
    return evaluate.inversions(table(s, d, "documents"), ["lang"], "doc_id", "n_chars")


_NORM = r"regexp_replace(lower(trim(text)), '[^\p{L}\p{N}.%-]+', '', 'g')"


@query(
    sql(
        f"select doc_id, count(f) as found, count(g) as truth, sum(case when f = 1 and g = 1 then 1 else 0 end)::bigint as both, round(sum(case when f = 1 and g = 1 then 1 else 0 end) / nullif(count(f), 0), 4) as precision, round(sum(case when f = 1 and g = 1 then 1 else 0 end) / nullif(count(g), 0), 4) as recall"
        f" from (select distinct doc_id, {_NORM} as t, 1 as f from cells) a full join (select distinct doc_id, {_NORM} as t, 1 as g from boxes where style_id <> 2) b using (doc_id, t) where t <> '' group by doc_id",
        ["cells"],
    )
)
def text_agreement(s: SparkSession, d: str) -> DataFrame:
    """Cells against boxes without the header rows."""
    b = report(s, d)
    return evaluate.text_agreement(geometry.document_cells(b), b.where("style_id <> 2"), ["doc_id"])


# -- relational forms -----------------------------------------------------------------------------


@query("select c_custkey, c_name, o_orderkey, o_totalprice from customer left join orders on c_custkey = o_custkey")
def join_left(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def join_semi(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_anti(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(sql("select doc_id, page_id, a.ord as upper, b.ord as lower from (select *, unnest([y // 20, y // 20 + 1])::bigint as band from boxes) a join (select *, (y // 20)::bigint as band from boxes) b using (doc_id, page_id, band) where b.y > a.y and b.y <= a.y + 20 and a.x < b.x + b.w and a.x + a.w > b.x", ["boxes"]))
def join_interval_overlap(s: SparkSession, d: str) -> DataFrame:
    """Boxes and those in the next row below that overlap them; y is cut into bands, so a box meets its band and the next only."""
    a = report(s, d).select(*PAGE_KEY, F.col("ord").alias("upper"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("w").alias("aw"), F.explode(F.array(F.floor(F.col("y") / 20), F.floor(F.col("y") / 20) + 1)).alias("band"))
    b = report(s, d).select(*PAGE_KEY, F.col("ord").alias("lower"), "x", "y", "w", F.floor(F.col("y") / 20).alias("band"))
    hit = (F.col("y") > F.col("ay")) & (F.col("y") <= F.col("ay") + 20) & (F.col("ax") < F.col("x") + F.col("w")) & (F.col("ax") + F.col("aw") > F.col("x"))
    return a.join(b, [*PAGE_KEY, "band"]).where(hit).select(*PAGE_KEY, "upper", "lower")


@query("select o_orderkey, l_linenumber, l_extendedprice from orders join lineitem on l_orderkey = o_orderkey qualify row_number() over (partition by o_orderkey order by abs(l_extendedprice - o_totalprice), l_linenumber, l_extendedprice) = 1")
def join_nearest(s: SparkSession, d: str) -> DataFrame:
    """As-of-like: of each order's lines the one nearest in price, by one aggregate instead of a sort."""
    j = table(s, d, "orders").select("o_orderkey", "o_totalprice").join(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    best = F.min(F.struct(F.abs(F.col("l_extendedprice") - F.col("o_totalprice")).alias("gap"), "l_linenumber", "l_extendedprice"))
    return j.groupBy("o_orderkey").agg(best.alias("b")).select("o_orderkey", "b.l_linenumber", "b.l_extendedprice")


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct l_orderkey) as n_orders, count(*) as n from lineitem group by all having count(*) > 1")
def aggregate_grouped(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("l_orderkey").alias("n_orders"), F.count("*").alias("n")).where("n > 1")


@query("select o_orderpriority, quantile_cont(o_totalprice, 0.5) filter (o_totalprice > 1000) as median, first(o_orderstatus order by k desc, o_orderstatus) as mode from (select *, count(*) over (partition by o_orderpriority, o_orderstatus) as k from orders) group by o_orderpriority")
def aggregate_percentile_mode(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.expr("percentile(o_totalprice, 0.5) filter (where o_totalprice > 1000)").alias("median"), F.mode("o_orderstatus", True).alias("mode"))


@query("select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as orders, max(o_orderpriority) filter (o_totalprice > 1000) as top, bool_or(o_orderstatus = 'F') as any_f from orders group by o_custkey")
def aggregate_ordered(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_custkey").agg(F.expr("string_agg(cast(o_orderkey as string), ',') within group (order by o_orderkey)").alias("orders"), F.expr("max(o_orderpriority) filter (where o_totalprice > 1000)").alias("top"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"))


@query("select o_orderpriority, coalesce(sum(o_totalprice) filter (o_orderstatus = 'F'), 0) as f, coalesce(sum(o_totalprice) filter (o_orderstatus = 'O'), 0) as o, coalesce(sum(o_totalprice) filter (o_orderstatus = 'P'), 0) as p from orders group by o_orderpriority")
def pivot(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).sum("o_totalprice").fillna(0.0, ["F", "O", "P"]).toDF("o_orderpriority", "f", "o", "p")


@query("select s_suppkey, feature, val from (select s_suppkey, s_acctbal, s_nationkey::double as nation from supplier) unpivot (val for feature in (s_acctbal, nation))")
def unpivot(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("nation"))
    return t.unpivot("s_suppkey", ["s_acctbal", "nation"], "feature", "val").where("val is not null")


@query(
    "select conv_id, turn, role, ntile(4) over w as quarter, lag(role) over w as before, lead(role) over w as after, rank() over (partition by conv_id order by role) as r, sum(length(text)) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row)::bigint as chars from conversations window w as (partition by conv_id order by turn, role, text)"
)
def window_forms(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", "role", F.ntile(4).over(w).alias("quarter"), F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), F.rank().over(Window.partitionBy("conv_id").orderBy("role")).alias("r"), F.sum(F.length("text").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("chars"))


@query("select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as last_user_turn from conversations")
def scope_carry_forward(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("last_user_turn"))


@query("select l_orderkey from lineitem except select o_orderkey from orders where o_orderstatus = 'F'")
def set_except(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey").subtract(table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))


@query("select n_name as name from nation union all select r_name from region")
def set_union_all(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.col("n_name").alias("name")).union(table(s, d, "region").select("r_name"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top_k(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query(sql("select t as text, try_cast(t as double) as number, try_cast(t as date)::varchar as day from (select distinct text as t from cells union select * from (values ('1_000'), ('1e3'), ('abc'), ('24-01-15'), ('2024/01/15'), ('2024'), ('1d')) v(t))", ["cells"]))
def guarded_casts(s: SparkSession, d: str) -> DataFrame:
    odd = s.createDataFrame([(x,) for x in ("1_000", "1e3", "abc", "24-01-15", "2024/01/15", "2024", "1d")], "text string")
    t = geometry.document_cells(report(s, d)).select("text").unionByName(odd).distinct()
    return t.select("text", casts.try_number(F.col("text")).alias("number"), casts.try_day(F.col("text")).cast("string").alias("day"))
