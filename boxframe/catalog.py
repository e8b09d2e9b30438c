"""The engine's registered queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import domains, evidence, geometry, hypotheses, scoring, sieve
from .functions import casts
from .plans.oracle_ctes import sql
from .schema import CELL_KEY, PAGE_KEY, ROW_KEY
from .sources import detect as detection
from .sources import grid, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEY = "doc_id, page_id, row_cluster, cell_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def report(s: SparkSession, d: str) -> DataFrame:
    return grid.order_boxes(table(s, d, "orders"))


def typed(s: SparkSession, d: str) -> DataFrame:
    return evidence.typed(geometry.document_cells(report(s, d)))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


# -- sources --------------------------------------------------------------------------------------


@query(sql("select doc_id, 0 as page_id, 0 as style_id, 1 as x, (i + 1)::int as y, strlen(line)::int as w, 1 as h, 'string' as cell_type, line as text from lines where line <> ''", ["lines"]))
def text_bboxes(s: SparkSession, d: str) -> DataFrame:
    return text.bboxes(docs(s, d))


@query(sql("select doc_id, 0 as page_id, 0 as document_id, 1 as page_number, max(strlen(line))::double as width, count(*)::double as height from lines group by doc_id", ["lines"]))
def text_pages(s: SparkSession, d: str) -> DataFrame:
    return text.pages(docs(s, d))


@query("select doc_id, 0 as document_id, 'text' as source_type, null::varchar as filename, sha256(text) as checksum, 1 as page_count from documents where text is not null")
def text_doc(s: SparkSession, d: str) -> DataFrame:
    return text.doc(docs(s, d))


@query("select doc_id, 0 as font_id, 'monospace' as name from documents where text is not null")
def text_fonts(s: SparkSession, d: str) -> DataFrame:
    return text.fonts(docs(s, d))


@query("select doc_id, 0 as style_id, 0 as font_id, 12.0::double as font_size, 'rgba(0,0,0,255)' as color, 'normal' as weight, 0 as italic, 0 as underline from documents where text is not null")
def text_styles(s: SparkSession, d: str) -> DataFrame:
    return text.styles(docs(s, d))


@query(
    r"select 'page' as kind, case when regexp_matches(html, '^(?i)\s*(<!doctype\s+html|<html(>|\s|$))') then 'html' else 'text' end as format, count(*) as n from pages group by all"
    r" union all select 'document', case when starts_with(text, '%PDF') then 'pdf' when regexp_matches(text, '^(?i)\s*(<!doctype\s+html|<html(>|\s|$))') then 'html' else 'text' end, count(*) from documents group by all"
)
def detect_format(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "pages").select(F.lit("page").alias("kind"), detection.detect(F.col("html").cast("binary")).alias("format"))
    b = docs(s, d).select(F.lit("document").alias("kind"), detection.detect(F.col("text").cast("binary")).alias("format"))
    return a.unionByName(b).groupBy("kind", "format").agg(F.count("*").alias("n"))


@query(sql("select doc_id, page_id, ord, x, y, w, h, text, style_id, weight, font_size from word_boxes", ["word_boxes"]))
def word_boxes(s: SparkSession, d: str) -> DataFrame:
    return text.words(docs(s, d)).drop("font_name", "color")


@query(sql("select * from report_boxes", ["report_boxes"]))
def report_boxes(s: SparkSession, d: str) -> DataFrame:
    return report(s, d)


# -- geometry -------------------------------------------------------------------------------------


@query(sql("select doc_id, ord, row_cluster from rows_", ["rows_"], "word_boxes"))
def row_clusters(s: SparkSession, d: str) -> DataFrame:
    return geometry.row_clusters(text.words(docs(s, d))).select("doc_id", "ord", "row_cluster")


@query(sql("select doc_id, ord, dense_rank() over (partition by doc_id, page_id order by round((y + h / 2) / greatest(h, 1.0))) as row_cluster from boxes", ["boxes"]))
def midline_rows(s: SparkSession, d: str) -> DataFrame:
    return geometry.midline_rows(report(s, d)).select("doc_id", "ord", "row_cluster")


@query(sql(f"select {KEY}, x, y, w, h, text, weight, font_size, style_id, n_fragments, style_rank, style_count from cells", ["cells"], "word_boxes"))
def cell_merge(s: SparkSession, d: str) -> DataFrame:
    return geometry.document_cells(text.words(docs(s, d))).select(*CELL_KEY, "x", "y", "w", "h", "text", "weight", "font_size", "style_id", "n_fragments", "style_rank", "style_count")


@query(sql(f"select {KEY}, x, y, w, h, text, weight, font_size, style_id, n_fragments, style_rank, style_count from cells", ["cells"]))
def report_cells(s: SparkSession, d: str) -> DataFrame:
    return geometry.document_cells(report(s, d)).select(*CELL_KEY, "x", "y", "w", "h", "text", "weight", "font_size", "style_id", "n_fragments", "style_rank", "style_count")


@query(
    sql(
        "select doc_id, page_id, row_cluster, sum(n) as cell_id, ord from (select *, sum(case when g is null or g > greatest(hl * 0.8, 3.0) then 1 else 0 end) over (partition by doc_id, page_id, row_cluster order by x, ord rows between unbounded preceding and current row) as n"
        " from (select *, x - lag(x + w) over q as g, lag(h) over q as hl from rows_ window q as (partition by doc_id, page_id, row_cluster order by x, ord))) group by all",
        ["rows_"],
        "word_boxes",
    )
)
def local_cell_merge(s: SparkSession, d: str) -> DataFrame:
    return geometry.local_fragments(geometry.row_clusters(text.words(docs(s, d)))).select(*CELL_KEY, "ord")


@query(sql("select * from hist", ["hist"]))
def style_histogram(s: SparkSession, d: str) -> DataFrame:
    return geometry.style_histogram(report(s, d))


@query(sql("select doc_id, count(distinct w) = 1 and min(w) = 1.0 as is_grid from boxes group by doc_id", ["boxes"]))
def grid_mode(s: SparkSession, d: str) -> DataFrame:
    return geometry.grid_mode(report(s, d))


@query(sql("select doc_id, page_id, table_id, start_row, end_row, n_data_rows, modal_cols, table_left, table_right, table_top, table_bottom from regions", ["regions"]))
def table_regions(s: SparkSession, d: str) -> DataFrame:
    return geometry.table_regions(geometry.row_stats(typed(s, d)))


@query(sql("select doc_id, page_id, start_row, end_row, n_rows, dense_rank() over (partition by doc_id, page_id order by grp) as region_id from ordinal", ["ordinal"]))
def ordinal_regions(s: SparkSession, d: str) -> DataFrame:
    return geometry.ordinal_regions(geometry.row_stats(typed(s, d)))


@query(sql("select doc_id, page_id, segment, min(row_cluster) as start_row, max(row_cluster) as end_row, count(*) as n_rows from (select *, sum(case when n_cells < 2 then 1 else 0 end) over (partition by doc_id, page_id order by row_cluster) as segment from stats) where n_cells >= 2 group by all having count(*) >= 3", ["stats"]))
def table_segments(s: SparkSession, d: str) -> DataFrame:
    return geometry.segments(geometry.row_stats(typed(s, d)))


@query(sql("select doc_id, page_id, table_id, col_id, col_left, col_right, round(col_center, 6) as col_center, n_measure_cells from columns_", ["columns_"]))
def putative_columns(s: SparkSession, d: str) -> DataFrame:
    t = typed(s, d)
    return rounded(geometry.putative_columns(t, geometry.table_regions(geometry.row_stats(t))), "col_center")


@query(sql("select doc_id, page_id, table_id, col_id, row_cluster as header_row, cell_id as header_cell, text as header_text from above qualify row_number() over (partition by doc_id, page_id, table_id, col_id order by row_cluster desc, cell_id) = 1", ["above"]))
def column_headers(s: SparkSession, d: str) -> DataFrame:
    t = typed(s, d)
    r = geometry.table_regions(geometry.row_stats(t))
    return geometry.column_headers(t, r, geometry.putative_columns(t, r))


@query(sql(f"select {KEY}, indent_level from (select {KEY}, round(x) as xr from cells) join indents using (doc_id, xr)", ["cells", "indents"]))
def indent_levels(s: SparkSession, d: str) -> DataFrame:
    return geometry.indent_levels(geometry.document_cells(report(s, d))).select(*CELL_KEY, "indent_level")


_BLOCKS = "(select *, sum(case when g is null or g > 2 * bh then 1 else 0 end) over (partition by doc_id, page_id order by row_top, row_cluster rows between unbounded preceding and current row) as block_id from (select s.*, bh, row_top - lag(row_bottom) over (partition by s.doc_id, page_id order by row_top, row_cluster) as g from stats s join heights using (doc_id)))"


@query(sql(f"select doc_id, page_id, block_id, sum(n) as n_rows, min(l) as block_left, max(r) as block_right, first(n_cells order by n desc, n_cells) as modal_cells from (select doc_id, page_id, block_id, n_cells, count(*) as n, min(row_left) as l, max(row_right) as r from {_BLOCKS} group by all) group by all", ["stats", "heights"]))
def blocks(s: SparkSession, d: str) -> DataFrame:
    b = report(s, d)
    return geometry.block_summary(geometry.blocks(geometry.row_stats(evidence.typed(geometry.document_cells(b))), geometry.body_height(b)))


@query(
    sql(
        """select doc_id, page_id, n_peaks, case when n_peaks = 0 then 'mixed' when n_peaks = 1 then 'single' when n_peaks = 2 and (hi - lo) * 0.05 > 0.3 then 'two_column' when n_peaks <= 3 then 'multi' else 'grid' end as layout from (
  select doc_id, page_id, sum(case when n > greatest(mid * 2, 3) then 1 else 0 end) as n_peaks, min(bin) filter (n > greatest(mid * 2, 3)) as lo, max(bin) filter (n > greatest(mid * 2, 3)) as hi from (
    select *, quantile_cont(n, 0.5) over (partition by doc_id, page_id) as mid from (select doc_id, page_id, floor(x / (width * 0.05)) as bin, count(*) as n from (
      select *, x - lag(x + w) over (partition by doc_id, page_id, row_cluster order by x, ord) as g, max(x + w) over (partition by doc_id, page_id) as width from rows_) where g is null or g > 0.1 * width group by all)) group by all)""",
        ["rows_"],
    )
)
def layout_class(s: SparkSession, d: str) -> DataFrame:
    return geometry.layout_class(geometry.row_clusters(report(s, d)))


@query(
    sql(
        "select doc_id, page_id, n_gaps, round(cv, 6) as cv, case when cv < 0.3 then 'regular' when cv > 0.7 then 'irregular' when cv is not null then 'mixed' end as spacing from (select doc_id, page_id, count(g) as n_gaps, stddev_samp(g) / nullif(avg(g), 0) as cv from (select *, row_top - lag(row_top) over (partition by doc_id, page_id order by row_top, row_cluster) as g from stats) group by all)",
        ["stats"],
    )
)
def row_regularity(s: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.row_regularity(geometry.row_stats(typed(s, d))), "cv")


@query(sql("select doc_id, page_id, min(row_cluster) as body_row from (select doc_id, page_id, row_cluster from typed group by all having count(*) >= 2 and coalesce(bool_or(type = 'measure'), false)) group by all", ["typed"]))
def body_start(s: SparkSession, d: str) -> DataFrame:
    return geometry.body_start(typed(s, d))


@query(
    sql(
        f"select {KEY}, text, case when font_size > 1.3 * m and y < 0.15 * ym then 'page_title' else 'page_number' end as page_role from (select *, max(y) over (partition by doc_id, page_id) as ym from cells) join (select doc_id, first(font_size order by n desc, font_size) as m from (select doc_id, font_size, count(*) as n from cells group by all) group by doc_id) using (doc_id) where font_size > 1.3 * m and y < 0.15 * ym or y > 0.9 * ym and regexp_matches(text, '^[0-9]{{1,5}}$')",
        ["cells"],
    )
)
def page_furniture(s: SparkSession, d: str) -> DataFrame:
    return geometry.page_furniture(geometry.document_cells(report(s, d)))


# -- sieve ----------------------------------------------------------------------------------------


@query(sql(f"select {KEY}, text, type from typed", ["typed"]))
def pass1_types(s: SparkSession, d: str) -> DataFrame:
    return typed(s, d).select(*CELL_KEY, "text", "type")


@query(sql("select doc_id, text, type, count(*) as n from typed group by all", ["typed"], "word_boxes"))
def pass1_types_of_words(s: SparkSession, d: str) -> DataFrame:
    return typed_words(s, d).groupBy("doc_id", "text", "type").agg(F.count("*").alias("n"))


def typed_words(s: SparkSession, d: str) -> DataFrame:
    return evidence.typed(geometry.document_cells(text.words(docs(s, d))))


_PATTERN = r"""case when regexp_matches(trim(text), '^([$€£¥]\s*[\d,.]+|[\d,.]+\s*(USD|EUR|GBP|JPY))$') then 'currency' when regexp_matches(trim(text), '^[\d,.]+\s*%$') then 'percentage'
  when regexp_matches(trim(text), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') then 'email' when regexp_matches(trim(text), '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') then 'uuid'
  when regexp_matches(trim(text), '^\d{4}-\d{2}-\d{2}$') then 'iso_date' when regexp_matches(trim(text), '^\d{5}(-\d{4})?$') then 'zip' when regexp_matches(trim(text), '^-?\d+$') then 'integer'
  when regexp_matches(trim(text), '^-?[\d,]*\.?\d+$') then 'number' when regexp_matches(trim(text), '^\+?[\d\s().-]{7,15}$') then 'phone' end"""
_ROLE = f"""case when b.body_row is null or c.row_cluster < b.body_row then 'header' when weight = 'bold' then 'label' else coalesce({_PATTERN},
  case when try_cast(replace(replace(replace(text, ',', ''), '$', ''), ' ', '') as double) is not null then 'numeric' when try_cast(text as date) is not null then 'date' when regexp_matches(trim(text), '^[A-Za-z]{{1,3}}$') then 'code' else 'text' end) end"""
_BODY = "(select doc_id, page_id, min(row_cluster) as body_row from (select doc_id, page_id, row_cluster from typed group by all having count(*) >= 2 and coalesce(bool_or(type = 'measure'), false)) group by all) b using (doc_id, page_id)"


def sieved(s: SparkSession, d: str) -> DataFrame:
    t = typed(s, d)
    c = t.join(geometry.body_start(t), PAGE_KEY, "left")
    before = F.col("body_row").isNull() | (F.col("row_cluster") < F.col("body_row"))
    return c.withColumn("role", sieve.sieve_role(F.col("text"), before, F.col("weight")))


@query(sql(f"select {KEY}, text, {_ROLE} as role from typed c left join {_BODY}", ["typed"]))
def sieve_roles(s: SparkSession, d: str) -> DataFrame:
    return sieved(s, d).select(*CELL_KEY, "text", "role")


@query(sql(f"select role, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 1) as pct from (select {_ROLE} as role from typed c left join {_BODY}) group by role", ["typed"]))
def role_distribution(s: SparkSession, d: str) -> DataFrame:
    return sieve.role_distribution(sieved(s, d), [])


@query(sql("select text, " + _PATTERN + " as pattern, length(regexp_replace(text, '[^0-9]', '', 'g')) as n_digits, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n_letters, length(text) as n_chars from (select distinct text from cells)", ["cells"]))
def sieve_patterns(s: SparkSession, d: str) -> DataFrame:
    c = geometry.document_cells(report(s, d)).select("text").distinct()
    return c.select("text", sieve.pattern(F.col("text")).alias("pattern"), *sieve.char_classes(F.col("text")))


@query(
    sql(
        r"select distinct text, case when regexp_matches(trim(text), '^(19|20)\d{2}$') then 'year' when regexp_matches(trim(text), '^\d{2}-\d{7}$') then 'ein' when regexp_matches(trim(text), '^\$[\d,.]+$') then 'currency' when regexp_matches(trim(text), '^-?[\d,]+\.\d+$') then 'number' when regexp_matches(trim(text), '^\d{1,2}[a-z]$') then 'lineref' when regexp_matches(trim(text), '^-?[\d,]+$') then 'integer' else 'text' end as kind from cells",
        ["cells"],
    )
)
def overlay_domains(s: SparkSession, d: str) -> DataFrame:
    return geometry.document_cells(report(s, d)).select("text", sieve.overlay_domain(F.col("text")).alias("kind")).distinct()


@query(
    sql(
        f"select {KEY}, coalesce(case when {{}} end, case when weight = 'bold' then 'structural_bold' when style_rank >= 3 then 'structural_rare' end) as type from cells".replace(
            "case when {} end", "case when try_cast(replace(replace(replace(text, ',', ''), '$', ''), ' ', '') as double) is not null then 'measure' when try_cast(text as date) is not null then 'date' when regexp_matches(text, '^\\$[\\d,.]+$') then 'currency' when regexp_matches(text, '^[\\d,.]+\\s*%$') then 'percentage' when regexp_matches(text, '^\\d{5}(-\\d{4})?$') then 'zip_code' when regexp_matches(text, '^\\d{4}-\\d{2}-\\d{2}') then 'iso_date' end"
        ),
        ["cells"],
    )
)
def structural_types(s: SparkSession, d: str) -> DataFrame:
    c = geometry.document_cells(report(s, d))
    return c.select(*CELL_KEY, sieve.structural_type(F.col("text"), F.col("weight"), F.col("style_rank")).alias("type"))


@query("select token, count(*) as n from (select unnest(regexp_extract_all(text, '[^\\s]+')) as token from documents) where length(token) between 4 and 30 and try_cast(token as double) is null and not regexp_matches(token, '^[0-9!-/:-@\\[-`{-~]') and length(regexp_replace(token, '[^A-Za-z]', '', 'g')) > 0.8 * length(token) group by token")
def clean_tokens(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d).select(F.explode(F.split("text", r"\s+")).alias("token"))
    return t.where(sieve.clean_token(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


# -- evidence -------------------------------------------------------------------------------------


def wide(s: SparkSession, d: str) -> DataFrame:
    return evidence.wide(typed(s, d))


@query(sql(f"select {KEY}, round(x_frac, 6) as x_frac, round(y_frac, 6) as y_frac, round(w_frac, 6) as w_frac, y < y0 + (y1 - y0) * 0.1 as is_top_10pct, y + h > y1 - (y1 - y0) * 0.1 as is_bottom_10pct from pos", ["pos"]))
def page_position(s: SparkSession, d: str) -> DataFrame:
    return rounded(evidence.with_position(typed(s, d)), "x_frac", "y_frac", "w_frac").select(*CELL_KEY, "x_frac", "y_frac", "w_frac", "is_top_10pct", "is_bottom_10pct")


@query(sql(f"select {KEY}, color <> m as color_outlier from cells left join (select doc_id, first(color order by n desc, color) as m from (select doc_id, color, count(*) as n from cells where style_rank = 1 group by all) group by doc_id) using (doc_id)", ["cells"]))
def color_outliers(s: SparkSession, d: str) -> DataFrame:
    return evidence.with_color_outlier(typed(s, d)).select(*CELL_KEY, "color_outlier")


@query(sql("select doc_id, text, b * 5 as band, n_pages from cross_", ["cross_"]))
def cross_page_repeats(s: SparkSession, d: str) -> DataFrame:
    c = evidence.with_cross_page(typed(s, d)).where("n_pages is not null")
    return c.select("doc_id", "text", (F.floor(F.col("y") / 5) * 5).alias("band"), "n_pages").distinct()


@query(sql("select doc_id, page_id, row_cluster, n_cells, n_typed, row_left, row_right, n_typed >= 2 as is_data_row from stats", ["stats"]))
def row_geometry(s: SparkSession, d: str) -> DataFrame:
    return geometry.row_stats(typed(s, d)).select(*ROW_KEY, "n_cells", "n_typed", "row_left", "row_right", (F.col("n_typed") >= 2).alias("is_data_row"))


@query(sql(f"select {KEY}, col_id, round(col_center, 6) as col_center, alignment from aligned", ["aligned"]))
def alignment(s: SparkSession, d: str) -> DataFrame:
    return rounded(evidence.column_alignment(typed(s, d)), "col_center").select(*CELL_KEY, "col_id", "col_center", "alignment")


@query(sql("select * from near", ["near"]))
def table_membership(s: SparkSession, d: str) -> DataFrame:
    return evidence.with_tables(typed(s, d)).select(*ROW_KEY, "in_table", "in_data_rows", "above_data").distinct()


@query(sql(f"select {KEY}, is_section_label, indent_level, scope_l0 from scoped", ["scoped"]))
def section_scope(s: SparkSession, d: str) -> DataFrame:
    return wide(s, d).select(*CELL_KEY, "is_section_label", "indent_level", "scope_l0")


_PROFILE = """select doc_id, n_cells, n_pages, unnest(case when len(p) = 0 then [{'p': 'general', 'c': 0.5::double}] else p end, recursive := true) from (select doc_id, n_cells, n_pages, list_filter([case when m > 0.3 and ny > 0 then {'p': 'financial', 'c': 0.8::double} end, case when m > 0.2 then {'p': 'tabular', 'c': 0.6::double} end,
  case when kv > 0.3 and m < 0.2 then {'p': 'form', 'c': 0.7::double} end, case when ns >= 4 and kv > 0.1 and m > 0.05 then {'p': 'product', 'c': 0.6::double} end, case when m < 0.1 and b < 0.1 then {'p': 'narrative', 'c': 0.7::double} end], lambda x: x is not null) as p
from (select doc_id, count(*) as n_cells, count(distinct page_id) as n_pages, count(distinct style_id) as ns, avg((weight = 'bold')::int) as b, avg(coalesce(type in ('measure', 'currency'), false)::int) as m, count(*) filter (type = 'year') as ny from typed group by doc_id)
join (select doc_id, avg((n_cells = 2)::int) as kv from stats group by doc_id) using (doc_id))"""


@query(sql(f"select doc_id, n_cells, n_pages, p as profile, c as confidence from ({_PROFILE})", ["typed", "stats"]))
def doc_profile(s: SparkSession, d: str) -> DataFrame:
    return evidence.profiles(typed(s, d))


@query(sql(f"select doc_id, n_cells, n_pages, p as profile, c as confidence from ({_PROFILE})", ["typed", "stats"], "word_boxes"))
def doc_profile_of_texts(s: SparkSession, d: str) -> DataFrame:
    return evidence.profiles(typed_words(s, d))


_PROBES = {
    0: "try_cast(replace(replace(replace(text, ',', ''), '$', ''), ' ', '') as double) is not null", 1: r"regexp_matches(trim(text), '^\d{4}$') and try_cast(trim(text) as integer) between 1900 and 2099", 2: "try_cast(text as date) is not null",
    3: r"regexp_matches(trim(text), '^\$[\d,.]+$')", 4: r"regexp_matches(trim(text), '^[\d,.]+\s*%$')", 5: r"regexp_matches(trim(text), '^\d{5}(-\d{4})?$')", 6: r"regexp_matches(trim(text), '^\d{4}-\d{2}-\d{2}')",
    7: "try_cast(replace(text, ',', '') as bigint) is not null", 8: r"regexp_matches(trim(text), '^\([\d,.]+\)$')", 9: r"regexp_matches(trim(text), '^[\x{2014}\x{2013}\-]$')",
    100: "is_bold", 101: "font_name ilike '%italic%'", 102: "is_dominant", 103: "is_rare", 104: "color <> mode(color) filter (style_rank = 1) over (partition by doc_id)", 200: "is_top_10pct", 201: "is_bottom_10pct", 202: "is_leftmost", 203: "in_table", 204: "above_data", 205: "subtends_column", 206: "in_data_rows", 300: "n_pages > 1",
}
_PROBE_LIST = "list_filter([" + ", ".join(f"case when {c} then {i} end" for i, c in _PROBES.items()) + "], lambda x: x is not null)"


# -- domains --------------------------------------------------------------------------------------

_VOCABULARY = "(select 'priority' as domain, o_orderpriority as member from orders union select 'segment', c_mktsegment from customer union select 'nation', n_name from nation union select 'region', r_name from region union select 'brand', p_brand from part)"


def vocabulary(s: SparkSession, d: str) -> DataFrame:
    pick = lambda name, t, c: table(s, d, t).select(F.lit(name).alias("domain"), F.col(c).alias("member")).distinct()
    out = pick("priority", "orders", "o_orderpriority")
    for x in (("segment", "customer", "c_mktsegment"), ("nation", "nation", "n_name"), ("region", "region", "r_name"), ("brand", "part", "p_brand")):
        out = out.unionByName(pick(*x))
    return out


_MEMBERS = f"(select distinct domain, unnest(string_split(lower(trim(regexp_replace(member, '\\s+', ' ', 'g'))), ' ')) as token from {_VOCABULARY})"
_TOKENS = "(select distinct doc_id, page_id, row_cluster, cell_id, unnest(regexp_extract_all(lower(text), '[^\\s]+')) as token from cells)"


@query(sql(f"select {KEY}, domain, round(count(*) / any_value(n), 3) as score from {_TOKENS} join (select {KEY}, count(*) as n from {_TOKENS} group by all) using ({KEY}) join {_MEMBERS} using (token) group by {KEY}, domain", ["cells"]))
def domain_scores(s: SparkSession, d: str) -> DataFrame:
    return domains.scores(geometry.document_cells(report(s, d)), CELL_KEY, vocabulary(s, d))


@query(sql(f"select {KEY}, domain, 1.0::double as score from (select {KEY}, domain from {_TOKENS} t join {_MEMBERS} m using (token) join (select {KEY}, count(*) as n from {_TOKENS} group by all) using ({KEY}) group by {KEY}, domain having count(*) = any_value(n)) qualify row_number() over (partition by {KEY} order by domain) = 1", ["cells"]))
def domain_contained(s: SparkSession, d: str) -> DataFrame:
    return domains.contained(domains.scores(geometry.document_cells(report(s, d)), CELL_KEY, vocabulary(s, d)), CELL_KEY)


@query(sql(f"select {KEY}, domain from cells c join {_VOCABULARY} v on lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(v.member, '\\s+', ' ', 'g')))", ["cells"]))
def domain_cell_probe(s: SparkSession, d: str) -> DataFrame:
    return domains.cell_probe(geometry.document_cells(report(s, d)), CELL_KEY, vocabulary(s, d))


@query(sql(f"select distinct doc_id, domain from {_TOKENS} join {_MEMBERS} using (token)", ["cells"]))
def domain_screen(s: SparkSession, d: str) -> DataFrame:
    return domains.present_domains(geometry.document_cells(report(s, d)), vocabulary(s, d))


@query(sql(f"select doc_id, page_id, col_id, domain, count(*) as hits, round(count(*) / any_value(n), 3) as fraction from aligned join {_VOCABULARY} v on lower(text) = lower(member) join (select doc_id, page_id, col_id, count(*) as n from aligned group by all) using (doc_id, page_id, col_id) group by doc_id, page_id, col_id, domain having count(*) >= 2", ["aligned"]))
def column_domains(s: SparkSession, d: str) -> DataFrame:
    return domains.column_domains(evidence.column_alignment(typed(s, d)), [*PAGE_KEY, "col_id"], vocabulary(s, d))


@query(sql(f"select domain, count(*) as members, round(count(k) / count(*), 3) as coverage, round(coalesce(sum(k), 0) / (select count(*) from cells), 6) as purity from {_VOCABULARY} v left join (select lower(text) as t, count(*) as k from cells group by all) on lower(member) = t group by domain", ["cells"]))
def domain_coverage(s: SparkSession, d: str) -> DataFrame:
    return domains.coverage(geometry.document_cells(report(s, d)), vocabulary(s, d))


@query("select n_name as text, list_reduce(list_prepend(2166136261::ubigint, [ascii(c)::ubigint for c in string_split(n_name, '')]), lambda h, b: (xor(h, b) * 16777619::ubigint) % 4294967296::ubigint)::bigint as hash from nation")
def fnv1a(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.col("n_name").alias("text"), casts.fnv1a(F.col("n_name")).alias("hash"))


# -- scoring and resolution -----------------------------------------------------------------------


def featured(s: SparkSession, d: str) -> DataFrame:
    return scoring.features(typed(s, d))


@query(sql(f"select {KEY}, {', '.join(scoring.FEATURES)} from features", ["features"]))
def role_features(s: SparkSession, d: str) -> DataFrame:
    return featured(s, d).select(*CELL_KEY, *scoring.FEATURES)


@query(sql("select doc_id, active_tag, role, round(sum(score), 4) as score, count(*) as n from scores group by all", ["scores"]))
def role_scores(s: SparkSession, d: str) -> DataFrame:
    return scoring.document_scores(featured(s, d))


@query(sql("select * from win", ["win"]))
def winning_tag(s: SparkSession, d: str) -> DataFrame:
    return scoring.document_tags(featured(s, d))


@query(
    sql(
        f"select {KEY}, winning_tag, case when f_pattern_match then type when best = s1 then 'col_header' when best = s2 then 'section_label' when best = s3 then 'row_label' when best = s4 then 'dimension' else 'prose' end as role, round(best - list_max(list_filter([s1, s2, s3, s4, s5], lambda v: v < best)), 6) as confidence from wide_scores",
        ["wide_scores"],
    )
)
def role_argmax(s: SparkSession, d: str) -> DataFrame:
    return scoring.assigned(featured(s, d)).select(*CELL_KEY, "winning_tag", "role", "confidence")


_HAS = lambda i: f"list_contains(p, {i})"
_I = lambda i: f"list_contains(p, {i})::int"
_HYP = f"""(with c as materialized (select *, {_PROBE_LIST} as p, count(*) over (partition by doc_id, page_id, row_cluster) as n_row, row_number() over (partition by doc_id, page_id, row_cluster order by x, cell_id) as i_row, lag(text) over (partition by doc_id, page_id, row_cluster order by x, cell_id) as before from scoped),
h as (select * from c where len(p) > 0), a as materialized (select {KEY}, col_id from aligned), a1 as (select {KEY}, min(col_id) as col_id from a group by all)
select {KEY}, 'chrome' as hypothesis, text as detail, 3 * {_I(300)} + {_I(103)} + {_I(200)} + {_I(201)} as support, {_I(203)} as against from h where ({_HAS(300)} or {_HAS(103)} and ({_HAS(200)} or {_HAS(201)})) and 3 * {_I(300)} + {_I(103)} + {_I(200)} + {_I(201)} > {_I(203)}
union all select {KEY}, 'col_header', a.col_id::varchar, 2 + 1 - {_I(0)}, {_I(0)} from h join a using ({KEY}) where {_HAS(205)} and {_HAS(204)}
union all select {KEY}, 'section_label', indent_level::varchar, {_I(100)} + {_I(103)} + {_I(202)}, {_I(0)} + {_I(206)} from h where ({_HAS(100)} or {_HAS(103)}) and {_HAS(202)} and not {_HAS(0)}
union all select {KEY}, 'total_label', null, 3, 0 from h where {_HAS(100)} and {_HAS(202)} and {_HAS(206)} and not {_HAS(0)}
union all select {KEY}, 'row_label', null, 2, 0 from h where {_HAS(202)} and {_HAS(206)} and not {_HAS(0)}
union all select {KEY}, 'measure', type, {_I(0)} + {_I(203)} + {_I(205)}, 0 from h where {_HAS(0)}
union all select {KEY}, 'dimension', a1.col_id::varchar, {_I(203)} + {_I(205)} + 1, {_I(202)} + {_I(100)} from h left join a1 using ({KEY}) where {_HAS(203)} and {_HAS(206)} and not {_HAS(0)} and not {_HAS(202)}
union all select {KEY}, case when i_row = 1 then 'field_label' else 'field_value' end, case when i_row = 2 then before end, 2 + 1 - {_I(203)}, 2 * {_I(206)} from h where n_row = 2
union all select {KEY}, 'prose', null, 1 + {_I(102)} + 1 - {_I(0)}, {_I(0)} + {_I(206)} from h)"""


@query(sql(f"select * from {_HYP}", ["scoped", "aligned"]))
def role_hypotheses(s: SparkSession, d: str) -> DataFrame:
    return hypotheses.generate(wide(s, d))


_ONE_HEADER = "(select *, row_number() over (partition by doc_id, page_id, detail order by support - against desc, row_cluster desc, cell_id) as r from {0} where hypothesis = 'col_header' and detail is not null) where r > 1"
_EXCLUDED = f"""select {KEY}, h.hypothesis, h.detail, 'measure_not_header' as rule from {{0}} h join (select {KEY}, support - against as m from {{0}} where hypothesis = 'measure') using ({KEY}) where h.hypothesis = 'col_header' and m >= h.support - h.against
  union all select {KEY}, h.hypothesis, h.detail, 'measure_not_header' from {{0}} h join (select {KEY}, max(support - against) as m from {{0}} where hypothesis = 'col_header' group by all) using ({KEY}) where h.hypothesis = 'measure' and m > h.support - h.against
  union all select {KEY}, h.hypothesis, h.detail, 'section_not_in_data' from {{0}} h where h.hypothesis = 'section_label' and against > 0
  union all select {KEY}, h.hypothesis, h.detail, 'header_implies_column' from {{0}} h where h.hypothesis = 'col_header' and detail is null"""
_BAD = f"""hy as materialized (select * from {_HYP}), bad as materialized (select {KEY}, hypothesis, detail, 'one_header_per_column' as rule from {_ONE_HEADER.format("hy")} union all {_EXCLUDED.format("hy")})"""
_ORDER = "[" + ", ".join(f"'{p}'" for p in hypotheses.PRIORITY) + "]"
_ROLES = f"""ro as materialized (select {KEY}, c.x, c.y, c.text, coalesce(b.hypothesis, 'unresolved') as role, b.detail, b.net from cells c left join (select {KEY}, hypothesis, detail, support - against as net from hy where support > against
  and not exists (select 1 from bad where bad.doc_id = hy.doc_id and bad.page_id = hy.page_id and bad.row_cluster = hy.row_cluster and bad.cell_id = hy.cell_id and bad.hypothesis = hy.hypothesis and bad.detail is not distinct from hy.detail)
  qualify row_number() over (partition by {KEY} order by support - against desc, list_position({_ORDER}, hypothesis), detail nulls first) = 1) b using ({KEY}))"""


@query(sql(f"select {KEY}, hypothesis, detail, rule as constraint_name from (with {_BAD} select * from bad)", ["scoped", "aligned"]))
def constraint_violations(s: SparkSession, d: str) -> DataFrame:
    return hypotheses.violations(hypotheses.generate(wide(s, d))).withColumnRenamed("constraint", "constraint_name")


@query(sql(f"select {KEY}, x, y, text, role, detail, net from (with {_BAD}, {_ROLES} select * from ro)", ["scoped", "aligned", "cells"]))
def roles_greedy(s: SparkSession, d: str) -> DataFrame:
    return hypotheses.resolved(hypotheses.generate(wide(s, d), ("x", "y", "text"), every=True))


@query(
    sql(
        f"""select * from (with {_BAD}, {_ROLES} select {KEY}, role, ro.text, concat_ws(' / ', case when role <> 'chrome' then nullif(title, '') end, case when role <> 'section_label' then nullif(scope_l0, '') end, case when role <> 'row_label' then nullif(row_label, '') end, case when role <> 'col_header' then nullif(col_header, '') end) as path
from ro join (select {KEY}, scope_l0 from scoped) using ({KEY}) left join (select {KEY}, min(col_id) as col_id from aligned group by all) using ({KEY}) left join (select doc_id, arg_min(text, (page_id, y, x)) as title from ro where role = 'chrome' group by all) using (doc_id)
left join (select doc_id, page_id, row_cluster, arg_min(text, x) as row_label from ro where role in ('row_label', 'total_label') group by all) using (doc_id, page_id, row_cluster) left join (select doc_id, page_id, detail::bigint as col_id, arg_max(text, (row_cluster, -cell_id)) as col_header from ro where role = 'col_header' group by all) using (doc_id, page_id, col_id))""",
        ["scoped", "aligned", "cells"],
    )
)
def treemap_paths(s: SparkSession, d: str) -> DataFrame:
    keep = ("scope_l0", "col_ids")
    return hypotheses.paths(hypotheses.resolved(hypotheses.generate(wide(s, d), ("x", "y", "text", *keep), every=True), keep))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of boxes to cells, their sieve roles and the roles' distribution."""
    return QUERIES["role_distribution"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


from . import catalog_evaluation, catalog_evidence, catalog_files, catalog_io, catalog_metadata, catalog_more, catalog_scalars, catalog_streams  # noqa: E402, F401  register their queries
