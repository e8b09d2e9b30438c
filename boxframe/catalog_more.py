"""Registered queries of the sequential operators, label scopes, domain variants and nested grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _BODY, _MEMBERS, _PATTERN, _PROFILE, _TOKENS, KEY, docs, query, report, table, typed, vocabulary
from .operators import domains, evidence, geometry, scopes, sequential, sieve
from .plans.oracle_ctes import sql
from .plans.store import stored
from .schema import CELL_KEY, PAGE_KEY, ROW_KEY
from .sources import text


@query(sql("select doc_id, page_id, x * 6 as x, y, (length(text) * 6)::double as w, h, text, style_id from word_boxes", ["word_boxes"]))
def pdf_char_runs(s: SparkSession, d: str) -> DataFrame:
    """Characters of words, six units wide, coalesced to words again."""
    w = text.words(docs(s, d))
    c = w.select("doc_id", "page_id", "ord", "x", "y", "h", "style_id", "font_size", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("i", "ch"))
    c = c.select("doc_id", "page_id", (F.col("ord") + F.col("i")).alias("ord"), ((F.col("x") + F.col("i")) * 6).alias("x"), "y", F.lit(6.0).alias("w"), "h", "ch", "style_id", "font_size")
    return sequential.char_runs(c).drop("ord")


# A box's step depends on the one before: one step a round, for all pages at once.
_STEPS = """with recursive o as materialized (select doc_id, page_id, ord, mid, row_number() over (partition by doc_id, page_id order by mid, x, ord) as k, greatest(0.6 * quantile_cont(h, 0.5) over (partition by doc_id, page_id), 3.0) as tol
  from (select doc_id, page_id, ord, x, h, y + ord * 7 % 13 * 1.2 + h / 2 as mid from boxes)),
r as (select doc_id, page_id, ord, k, 1::bigint as row_cluster, mid as centre, 1 as n from o where k = 1 union all
  select o.doc_id, o.page_id, o.ord, o.k, case when abs(o.mid - centre) > tol then row_cluster + 1 else row_cluster end, case when abs(o.mid - centre) > tol then o.mid else centre + (o.mid - centre) / (n + 1) end, case when abs(o.mid - centre) > tol then 1 else n + 1 end
  from r join o on o.doc_id = r.doc_id and o.page_id = r.page_id and o.k = r.k + 1)"""


@query(sql(f"select * from ({_STEPS} select doc_id, page_id, ord, row_cluster from r)", ["boxes"]))
def centroid_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of boxes whose heights waver by more than half a line, so that the running mean drifts."""
    return sequential.centroid_rows(report(s, d).withColumn("y", F.col("y") + F.col("ord") * 7 % 13 * 1.2))


@query(sql("select doc_id, page_id, row_number() over (partition by doc_id, page_id order by start_row) as table_no, start_row, end_row, n_rows from (select doc_id, page_id, seg, min(row_cluster) as start_row, max(row_cluster) as end_row, count(*) as n_rows from (select *, sum(case when n_cells < 2 then 1 else 0 end) over (partition by doc_id, page_id order by row_cluster) as seg from stats) where n_cells >= 2 group by all having count(*) >= 2)", ["stats"]))
def drift_tables(s: SparkSession, d: str) -> DataFrame:
    return sequential.drift_tables(geometry.row_stats(typed(s, d)))


_MASK = f"""select {KEY}, text, coalesce(case when font_size > 1.3 * m and y < 0.15 * ym then 'page_title' when y > 0.9 * ym and regexp_matches(text, '^[0-9]{{1,5}}$') then 'page_number' end,
  case when try_cast(replace(replace(replace(text, ',', ''), '$', ''), ' ', '') as double) is not null then 'measure' when try_cast(text as date) is not null then 'date' when regexp_matches(text, '^\\$[\\d,.]+$') then 'currency' when regexp_matches(text, '^[\\d,.]+\\s*%$') then 'percentage' when regexp_matches(text, '^\\d{{5}}(-\\d{{4}})?$') then 'zip_code' when regexp_matches(text, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then 'iso_date' end,
  case when weight = 'bold' and x <= row_left + 5 and n_typed = 0 then 'section_label' when weight = 'bold' and x <= row_left + 5 then 'total_label' when x <= row_left + 5 and n_typed > 0 then 'row_label' end) as role
from (select *, max(y) over (partition by doc_id, page_id) as ym from typed) join stats using (doc_id, page_id, row_cluster) join (select doc_id, first(font_size order by n desc, font_size) as m from (select doc_id, font_size, count(*) as n from cells group by all) group by doc_id) using (doc_id)"""


def masked(s: SparkSession, d: str) -> DataFrame:
    t = typed(s, d)
    page = geometry.page_furniture(t).drop("text")
    rows = geometry.row_stats(t).select(*ROW_KEY, "row_left", "n_typed")
    c = t.join(rows, ROW_KEY).join(page, CELL_KEY, "left")
    return c.withColumn("role", sieve.masked_role(F.col("text"), F.col("page_role"), F.col("weight"), F.col("x") <= F.col("row_left") + 5, F.col("n_typed")))


@query(sql(_MASK, ["typed", "stats", "cells"]))
def masked_roles(s: SparkSession, d: str) -> DataFrame:
    return masked(s, d).select(*CELL_KEY, "text", "role")


_LABELS = f"(select doc_id, page_id, row_cluster, cell_id, x, text from ({_MASK}) join typed using ({KEY}, text) where role in ('section_label', 'row_label'))"
_SCOPES = f"""with b as materialized {_LABELS}, e as (select doc_id, x, sum(case when g is null or g > 5 then 1 else 0 end) over (partition by doc_id order by x) - 1 as level from (select doc_id, x, x - lag(x) over (partition by doc_id order by x) as g from (select distinct doc_id, x from b))),
v as (select doc_id, page_id, row_cluster, arg_min(text, cell_id) filter (level = 0) as t0, arg_min(text, cell_id) filter (level = 1) as t1, arg_min(text, cell_id) filter (level = 2) as t2 from b join e using (doc_id, x) group by all),
r as (select s.doc_id, s.page_id, s.row_cluster, last_value(t0 ignore nulls) over w as c0, last_value(t1 ignore nulls) over w as c1, last_value(t2 ignore nulls) over w as c2, max(case when t0 is not null then s.row_cluster end) over w as r0, max(case when t1 is not null then s.row_cluster end) over w as r1, max(case when t2 is not null then s.row_cluster end) over w as r2
  from stats s left join v using (doc_id, page_id, row_cluster) window w as (partition by s.doc_id, s.page_id order by s.row_cluster rows between unbounded preceding and current row))
select doc_id, page_id, row_cluster, case when r0 >= -1 then c0 end as l0, case when r1 >= coalesce(r0, -1) then c1 end as l1, case when r2 >= greatest(coalesce(r0, -1), coalesce(r1, -1)) then c2 end as l2 from r"""


@query(sql(f"select * from ({_SCOPES})", ["typed", "stats", "cells"]))
def label_scopes(s: SparkSession, d: str) -> DataFrame:
    m = stored(masked(s, d), "masked")
    return scopes.label_scopes(m, m.where("role in ('section_label', 'row_label')").select(*CELL_KEY, "x", "text"))


@query(sql(f"select {KEY}, header as col_header from (select t.doc_id, t.page_id, t.row_cluster, t.cell_id, h.text as header, row_number() over (partition by t.doc_id, t.page_id, t.row_cluster, t.cell_id order by h.row_cluster desc, abs(t.x + t.w / 2 - h.x - h.w / 2), h.x) as r from typed t join typed h on t.doc_id = h.doc_id and t.page_id = h.page_id and h.weight = 'bold' and h.row_cluster < t.row_cluster and t.x + t.w / 2 between h.x - 5 and h.x + h.w + 5) where r = 1", ["typed"]))
def nearest_header(s: SparkSession, d: str) -> DataFrame:
    t = stored(typed(s, d), "typed")
    return scopes.nearest_header(t, t.where("weight = 'bold'"))


@query(sql("select doc_id, page_id, coalesce(first(row_cluster order by n desc, row_cluster) filter (bold > 0.5 and num < 0.3 and n >= 2), min(row_cluster) filter (num = 0 and n >= 2), min(row_cluster)) as header_row from (select doc_id, page_id, row_cluster, count(*) as n, avg(coalesce(type = 'measure', false)::int) as num, avg((weight = 'bold')::int) as bold from typed group by all) group by doc_id, page_id", ["typed"]))
def header_rows(s: SparkSession, d: str) -> DataFrame:
    return scopes.header_rows(typed(s, d))


@query(sql("select r.doc_id, r.page_id, table_id, min(row_cluster) as header_row from regions r join stats s on r.doc_id = s.doc_id and r.page_id = s.page_id and row_cluster between start_row - 5 and end_row where n_typed = 0 and n_cells >= 2 group by all", ["regions", "stats"]))
def region_header_row(s: SparkSession, d: str) -> DataFrame:
    """The first row of texts with two cells in a region or the five rows above it."""
    stats = geometry.row_stats(typed(s, d))
    r = geometry.table_regions(stats).select(*PAGE_KEY, "table_id", "start_row", "end_row")
    j = stats.where("n_typed = 0 and n_cells >= 2").join(r, PAGE_KEY).where("row_cluster between start_row - 5 and end_row")
    return j.groupBy(*PAGE_KEY, "table_id").agg(F.min("row_cluster").alias("header_row"))


@query(sql(f"select {KEY}, ordinal, probe from cells, (values (1, 'year', '^\\d{{4}}$'), (3, 'currency', '^\\$[\\d,.]+$'), (4, 'percentage', '^[\\d,.]+\\s*%$'), (5, 'zip_code', '^\\d{{5}}(-\\d{{4}})?$'), (6, 'iso_date', '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), (8, 'negative', '^\\([\\d,.]+\\)$'), (9, 'em_dash', '^[\\x{{2014}}\\x{{2013}}\\-]$')) as r(ordinal, probe, pattern) where regexp_matches(text, pattern)", ["cells"]))
def registry_probes(s: SparkSession, d: str) -> DataFrame:
    return scopes.registry_probes(geometry.document_cells(report(s, d)), scopes.REGISTRY)


_DOMAIN = f"(select {KEY}, min(domain) as domain from (select {KEY}, domain from {_TOKENS} t join {_MEMBERS} m using (token) join (select {KEY}, count(*) as n from {_TOKENS} group by all) using ({KEY}) group by {KEY}, domain having count(*) = any_value(n)) group by all)"


@query(
    sql(
        f"""select {KEY}, text, case when b.body_row is null or c.row_cluster < b.body_row then 'header' else coalesce({_PATTERN}, case when try_cast(replace(replace(replace(text, ',', ''), '$', ''), ' ', '') as double) is not null then 'numeric' when try_cast(text as date) is not null then 'date'
  when domain is not null then 'domain:' || domain when weight = 'bold' then 'label' when regexp_matches(trim(text), '^[A-Za-z]{{1,3}}$') then 'code' else 'text' end) end as role from typed c left join {_BODY} left join {_DOMAIN} using ({KEY})""",
        ["typed", "cells"],
    )
)
def sieve_roles_with_domain(s: SparkSession, d: str) -> DataFrame:
    t = stored(typed(s, d), "typed")
    best = domains.contained(domains.scores(t, CELL_KEY, vocabulary(s, d)), CELL_KEY).select(*CELL_KEY, "domain")
    c = t.join(geometry.body_start(t), PAGE_KEY, "left").join(best, CELL_KEY, "left")
    before = F.col("body_row").isNull() | (F.col("row_cluster") < F.col("body_row"))
    return c.select(*CELL_KEY, "text", sieve.sieve_role_with_domain(F.col("text"), before, F.col("weight"), F.col("domain")).alias("role"))


@query(sql(f"select distinct doc_id, domain from {_TOKENS} join {_MEMBERS} using (token) join (select distinct doc_id, p from ({_PROFILE})) using (doc_id) join (values ('priority', 'tabular'), ('priority', 'form'), ('nation', 'narrative')) as g(domain, p) using (domain, p)", ["cells", "typed", "stats"]))
def profile_gated_domains(s: SparkSession, d: str) -> DataFrame:
    """Only the domains whose tags name the document's profile are probed."""
    t = stored(typed(s, d), "typed")
    tags = s.createDataFrame([("priority", "tabular"), ("priority", "form"), ("nation", "narrative")], "domain string, profile string")
    gated = evidence.profiles(t).join(tags, "profile").select("doc_id", "domain").distinct()
    return domains.present_domains(t, vocabulary(s, d)).join(gated, ["doc_id", "domain"], "left_semi")


@query("select doc_id, variant, count(*) as n from (select doc_id, unnest(list_distinct(list_filter([t, case when t like '%ing' and length(t) >= 6 then t[:-4] end, case when t like '%s' and length(t) >= 4 then t[:-2] end], lambda x: x is not null))) as variant from (select distinct doc_id, token, regexp_replace(regexp_replace(token, '^[!-/:-@\\[-`{-~]+', ''), '[!-/:-@\\[-`{-~]+$', '') as t from (select doc_id, unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\v\\f\\r]+')) as token from documents)) where t <> '' and t not in ('the', 'of')) group by all")
def domain_token_variants(s: SparkSession, d: str) -> DataFrame:
    t = domains.without_stop_words(domains.tokens(docs(s, d), ["doc_id"]), ["the", "of"])
    return domains.suffix_variants(t, ["ing", "s"]).groupBy("doc_id", "variant").agg(F.count("*").alias("n"))


@query("select n_regionkey as doc_id, 0 as page_id, c as x, (dense_rank() over (partition by n_regionkey order by n_nationkey) + 1)::int as y, 1 as w, 1 as h, case when c = 1 then n_nationkey::varchar else n_name end as text from nation, (values (1), (2)) as t(c) union all select distinct n_regionkey, 0, 1, 1, 2, 1, 'Nations' from nation")
def sheet_json_boxes(s: SparkSession, d: str) -> DataFrame:
    """Nested sheets of nations per region, with a merged title, to boxes."""
    cell = lambda c: F.struct(c.cast("string").alias("formattedValue"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.struct(F.array(cell(F.col("n_nationkey")), cell(F.col("n_name"))).alias("values")).alias("v"))))
    n = table(s, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(rows.alias("r"))
    title = F.array(F.struct(F.array(cell(F.lit("Nations")), cell(F.lit("hidden"))).alias("values")))
    merges = F.array(F.struct(F.lit(0).alias("r0"), F.lit(1).alias("r1"), F.lit(0).alias("c0"), F.lit(2).alias("c1")))
    j = n.select("doc_id", F.to_json(F.struct(F.concat(title, F.transform("r", lambda x: x.v)).alias("rowData"), merges.alias("merges"))).alias("json"))
    return scopes.sheet_boxes(j)


@query("select o_orderkey, round(price, 2) as price, case when price > 200000 then 'high' when price > 100000 then 'mid' else 'low' end as band, greatest(price, 1.0) as least_price, concat_ws(' / ', o_orderstatus, nullif(o_orderpriority, '')) as path from (select * exclude (o_custkey), o_totalprice as price from orders) where o_orderpriority ilike '%urgent%' and o_orderstatus in ('F', 'O') and o_totalprice between 1000 and 1e9")
def projection_forms(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").drop("o_custkey").withColumn("price", F.col("o_totalprice"))
    o = o.where(F.col("o_orderpriority").ilike("%urgent%") & F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 1e9))
    band = F.when(F.col("price") > 200000, "high").when(F.col("price") > 100000, "mid").otherwise("low")
    return o.select("o_orderkey", F.round("price", 2).alias("price"), band.alias("band"), F.greatest("price", F.lit(1.0)).alias("least_price"), F.concat_ws(" / ", "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit(""))).alias("path"))
