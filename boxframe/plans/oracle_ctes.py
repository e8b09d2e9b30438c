"""Building blocks of the DuckDB oracles: common table expressions by name, with what each needs."""

from __future__ import annotations

_TYPED = "('measure', 'currency', 'percentage', 'date', 'iso_date', 'year')"


def type_case(c: str) -> str:
    return f"""case when regexp_matches(trim({c}), '^\\d{{4}}$') and try_cast(trim({c}) as integer) between 1900 and 2099 then 'year'
  when try_cast(replace(replace(replace({c}, ',', ''), '$', ''), ' ', '') as double) is not null then 'measure'
  when try_cast({c} as date) is not null then 'date'
  when regexp_matches({c}, '^\\$[\\d,.]+$') then 'currency'
  when regexp_matches({c}, '^[\\d,.]+\\s*%$') then 'percentage'
  when regexp_matches({c}, '^\\d{{5}}(-\\d{{4}})?$') then 'zip_code'
  when regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then 'iso_date' end"""


CTES: dict[str, tuple[list[str], str]] = {
    "lines": ([], "select doc_id, i - 1 as i, l[i] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))"),
    "word_boxes": (
        ["lines"],
        """select doc_id, 0 as page_id, i::bigint * 1000000 + off as ord, (off + 1)::double as x, ((i + 1) * 12)::double as y, strlen(w)::double as w, 10.0::double as h, w as text,
  case when i = 0 then 1 else 0 end as style_id, case when i = 0 then 'bold' else 'normal' end as weight, case when i = 0 then 14.0 else 10.0 end::double as font_size, 'monospace' as font_name, 'rgba(0,0,0,255)' as color
from (select doc_id, i, t[k] as w, coalesce(list_sum([strlen(x) + 1 for x in t[1:k - 1]]), 0)::bigint as off from (select doc_id, i, t, unnest(range(1, len(t) + 1)) as k from (select doc_id, i, string_split(line, ' ') as t from lines where line <> '')))
where w <> ''""",
    ),
    "report_rows": (
        [],
        """select doc_id, status, kind, texts, row_number() over (partition by doc_id order by status, kind, k) - 1 as r from (
  select o_custkey as doc_id, o_orderstatus as status, 2 as kind, o_orderkey as k,
    [o_orderkey::varchar, '$' || (round(o_totalprice * 100)::bigint // 100)::varchar || '.' || lpad((round(o_totalprice * 100)::bigint % 100)::varchar, 2, '0'), o_orderdate::date::varchar, o_orderpriority, year(o_orderdate)::varchar] as texts from orders
  union all select distinct o_custkey, o_orderstatus, 0, 0, ['Status ' || o_orderstatus] from orders
  union all select distinct o_custkey, o_orderstatus, 1, 0, ['Order', 'Total', 'Date', 'Priority', 'Year'] from orders
  union all select distinct o_custkey, '', -1, 0, ['Orders of customer ' || o_custkey] from orders)""",
    ),
    "report_boxes": (
        ["report_rows"],
        """select doc_id, (r // 40)::int as page_id, r * 10 + c - 1 as ord, (40 + case when kind > 0 then 8 else 0 end + (c - 1) * 110)::double as x, ((r % 40 + 1) * 20)::double as y, (length(texts[c]) * 6)::double as w,
  case when kind = -1 then 16.0 else 10.0 end::double as h, texts[c] as text, kind + 1 as style_id, case when kind < 2 then 'bold' else 'normal' end as weight, case when kind = -1 then 16.0 else 10.0 end::double as font_size,
  'Helvetica' as font_name, case when kind = 0 then 'rgba(0,0,128,255)' else 'rgba(0,0,0,255)' end as color
from (select *, unnest(range(1, len(texts) + 1)) as c from report_rows)""",
    ),
    "heights": (["boxes"], "select doc_id, greatest(quantile_cont(h, 0.5) filter (h > 2), 4.0) as bh from boxes group by doc_id"),
    "row_starts": (
        ["boxes", "heights"],
        "select *, sum(case when yl is null or pl <> page_id or y - yl > bh then 1 else 0 end) over (partition by doc_id order by page_id, y, x, ord rows between unbounded preceding and current row) as r0 from (select b.*, bh, lag(y) over (partition by b.doc_id order by page_id, y, x, ord) as yl, lag(page_id) over (partition by b.doc_id order by page_id, y, x, ord) as pl from boxes b join heights using (doc_id))",
    ),
    "rows_": (["row_starts"], "select * exclude (yl, pl, r0), (case when max(y) over (partition by doc_id, page_id, r0) - min(y) over (partition by doc_id, page_id, r0) > 2 * bh then r0 * 1000 + floor((y - min(y) over (partition by doc_id, page_id, r0)) / bh) else r0 end)::bigint as row_cluster from row_starts"),
    "gaps": (["rows_"], "select *, x - lag(x + w) over (partition by doc_id, page_id, row_cluster order by x, ord) as gap from rows_"),
    "thresholds": (["gaps"], "select doc_id, greatest(coalesce(quantile_cont(gap, 0.75) filter (gap > 0.5 and gap < 3 * bh), max(bh)) * 2, max(bh)) as thr from gaps group by doc_id"),
    "frags": (["gaps", "thresholds"], "select g.*, sum(case when gap is null or gap > thr then 1 else 0 end) over (partition by g.doc_id, page_id, row_cluster order by x) as cell_id from gaps g join thresholds using (doc_id)"),
    "tagged": (
        ["frags"],
        """select *, regexp_matches(text, '^[,.:;]+$') or coalesce(regexp_matches(lag(text) over (partition by doc_id, page_id, row_cluster, cell_id order by x, ord), '^[,.:;]+$'), false) as glued,
  count(*) over (partition by doc_id, page_id, row_cluster, cell_id, style_id) as n_style from frags""",
    ),
    "hist": (["boxes"], "select doc_id, style_id, n as style_count, rank() over (partition by doc_id order by n desc) as style_rank from (select doc_id, style_id, count(*) as n from boxes group by all)"),
    "cells": (
        ["tagged", "hist"],
        """select m.*, style_count, style_rank from (select doc_id, page_id, row_cluster, cell_id, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(h) as h,
  trim(regexp_replace(string_agg(case when glued then text else ' ' || text end, '' order by x, ord), '\\s+', ' ', 'g')) as text, first(weight order by n_style desc, style_id) as weight, first(font_size order by n_style desc, style_id) as font_size,
  first(font_name order by n_style desc, style_id) as font_name, first(color order by n_style desc, style_id) as color, first(style_id order by n_style desc, style_id) as style_id, count(*) as n_fragments
  from tagged group by doc_id, page_id, row_cluster, cell_id) m left join hist using (doc_id, style_id)""",
    ),
    "typed": (["cells"], f"select *, {type_case('text')} as type from cells"),
    "stats": (["typed"], f"select doc_id, page_id, row_cluster, count(*) as n_cells, sum(case when type in {_TYPED} then 1 else 0 end) as n_typed, min(x) as row_left, max(x + w) as row_right, min(y) as row_top, max(y + h) as row_bottom from typed group by all"),
    "islands": (["stats"], "select *, row_cluster - row_number() over (partition by doc_id, page_id order by row_cluster) as table_id from stats where n_typed >= 2"),
    "modal": (["islands"], "select doc_id, page_id, table_id, first(n_cells order by k desc, n_cells) as modal_cols from (select doc_id, page_id, table_id, n_cells, count(*) as k from islands group by all) group by all"),
    "regions": (["islands", "modal"], "select doc_id, page_id, table_id, min(row_cluster) as start_row, max(row_cluster) as end_row, count(*) as n_data_rows, max(modal_cols) as modal_cols, min(row_left) as table_left, max(row_right) as table_right, min(row_top) as table_top, max(row_bottom) as table_bottom from islands join modal using (doc_id, page_id, table_id) group by doc_id, page_id, table_id having count(*) >= 2"),
    "inside": (["typed", "regions"], f"select t.*, table_id, t.x + t.w / 2 as xc from typed t join regions r on t.doc_id = r.doc_id and t.page_id = r.page_id and row_cluster between start_row and end_row where type in {_TYPED}"),
    "bins": (["inside"], "select *, sum(case when g is null or g > 20 then 1 else 0 end) over (partition by doc_id, page_id, table_id order by bin) as col_id from (select doc_id, page_id, table_id, xc as bin, xc - lag(xc) over (partition by doc_id, page_id, table_id order by xc) as g from (select distinct doc_id, page_id, table_id, xc from inside))"),
    "columns_": (["bins", "inside"], "select doc_id, page_id, table_id, col_id, min(x) as col_left, max(x + w) as col_right, avg(xc) as col_center, count(*) as n_measure_cells from bins join inside using (doc_id, page_id, table_id) where abs(xc - bin) < 20 group by doc_id, page_id, table_id, col_id"),
    "above": (
        ["typed", "regions", "columns_"],
        "select t.*, c.table_id, c.col_id from typed t join regions r on t.doc_id = r.doc_id and t.page_id = r.page_id and row_cluster >= greatest(start_row - 5, 1) and row_cluster < start_row join columns_ c on c.doc_id = t.doc_id and c.page_id = t.page_id and c.table_id = r.table_id where type is null and x < col_right and x + w > col_left",
    ),
    "mine": (["typed", "regions"], "select t.doc_id, t.page_id, row_cluster, cell_id, table_id, start_row, end_row, modal_cols from typed t join regions r on t.doc_id = r.doc_id and t.page_id = r.page_id and row_cluster between greatest(start_row - 5, 1) and end_row qualify row_number() over (partition by t.doc_id, t.page_id, row_cluster, cell_id order by table_id) = 1"),
    "features": (
        ["typed", "stats", "mine", "above"],
        """select t.*, type is not null and type <> 'year' as f_pattern_match, table_id is not null as f_in_table, s.cell_id is not null as f_subtends_col, t.row_cluster = start_row - 1 as f_row_above_data, t.row_cluster between start_row and end_row as f_in_data_region,
  weight = 'bold' as f_bold, style_rank >= 3 as f_rare_style, x <= row_left + 5 as f_leftmost, n_typed = 0 as f_no_measures_in_row, coalesce(abs(n_cells - modal_cols), 99) <= 2 and table_id is not null as f_cell_count_match,
  font_size / nullif(med, 0) > 1.2 as f_large_font, type = 'year' as f_year_text
from typed t join stats using (doc_id, page_id, row_cluster) left join mine m using (doc_id, page_id, row_cluster, cell_id)
left join (select distinct doc_id, page_id, row_cluster, cell_id from above) s using (doc_id, page_id, row_cluster, cell_id) join (select doc_id, quantile_cont(font_size, 0.5) as med from typed group by doc_id) using (doc_id)""",
    ),
    "long": (["features"], "select doc_id, page_id, row_cluster, cell_id, feature, val from features unpivot (val for feature in (f_pattern_match, f_in_table, f_subtends_col, f_row_above_data, f_in_data_region, f_bold, f_rare_style, f_leftmost, f_no_measures_in_row, f_cell_count_match, f_large_font, f_year_text))"),
    "scores": (["long", "weights"], "select l.doc_id, page_id, row_cluster, cell_id, t.tag as active_tag, role, round(sum(weight), 6) as score from long l join weights w on l.feature = w.feature and l.val = w.val join (select distinct tag from weights) t on w.tag = 'default' or w.tag = t.tag group by all"),
    "win": (["scores"], "select doc_id, active_tag, mean_score from (select doc_id, active_tag, floor((sum(round(b * 10)::bigint) * 20 + count(*))::double / (count(*) * 2)) / 100 as mean_score from (select doc_id, page_id, row_cluster, cell_id, active_tag, max(score) as b from scores group by all) group by all) qualify row_number() over (partition by doc_id order by mean_score desc, active_tag) = 1"),
    "wide_scores": (
        ["features", "scores", "win"],
        """select f.*, a.active_tag as winning_tag, coalesce(s1, 0) as s1, coalesce(s2, 0) as s2, coalesce(s3, 0) as s3, coalesce(s4, 0) as s4, coalesce(s5, 0) as s5, greatest(coalesce(s1, 0), coalesce(s2, 0), coalesce(s3, 0), coalesce(s4, 0), coalesce(s5, 0)) as best
from features f left join win a using (doc_id) left join (select doc_id, page_id, row_cluster, cell_id, sum(score) filter (role = 'col_header') as s1, sum(score) filter (role = 'section_label') as s2, sum(score) filter (role = 'row_label') as s3,
  sum(score) filter (role = 'dimension') as s4, sum(score) filter (role = 'prose') as s5 from scores join win using (doc_id, active_tag) group by doc_id, page_id, row_cluster, cell_id) using (doc_id, page_id, row_cluster, cell_id)""",
    ),
    # evidence
    "pos": (["typed"], "select *, (x - x0) / nullif(x1 - x0, 0) as x_frac, (y - y0) / nullif(y1 - y0, 0) as y_frac, w / nullif(x1 - x0, 0) as w_frac from (select *, min(x) over p as x0, min(y) over p as y0, max(x + w) over p as x1, max(y + h) over p as y1 from typed window p as (partition by doc_id, page_id))"),
    "cross_": (["cells"], "select doc_id, text, floor(y / 5)::bigint as b, count(distinct page_id) as n_pages from cells group by all having count(distinct page_id) > 1"),
    "page_bins": (["typed"], "select *, sum(case when g is null or g > 20 then 1 else 0 end) over (partition by doc_id, page_id order by bin) as col_id from (select doc_id, page_id, xc as bin, xc - lag(xc) over (partition by doc_id, page_id order by xc) as g from (select distinct doc_id, page_id, x + w / 2 as xc from typed where type is not null))"),
    "page_columns": (["page_bins", "typed"], "select b.doc_id, b.page_id, col_id, min(x) as col_left, max(x + w) as col_right, avg(x + w / 2) as col_center from page_bins b join typed t on b.doc_id = t.doc_id and b.page_id = t.page_id and type is not null and abs(x + w / 2 - bin) < 20 group by all"),
    "aligned": (["typed", "page_columns"], "select t.*, col_id, col_center, case when w < 30 and abs(x + w / 2 - col_center) < 5 then 'center' when abs(x + w - col_center) < abs(x - col_center) then 'right' else 'left' end as alignment from typed t join page_columns c on t.doc_id = c.doc_id and t.page_id = c.page_id and x < col_right and x + w > col_left"),
    "ordinal": (["stats"], "select doc_id, page_id, min(row_cluster) as start_row, max(row_cluster) as end_row, count(*) as n_rows, grp from (select *, ro - row_number() over (partition by doc_id, page_id order by ro) as grp from (select *, row_number() over (partition by doc_id, page_id order by row_cluster) as ro from stats) where n_typed >= 2) group by doc_id, page_id, grp"),
    "near": (["stats", "ordinal"], "select s.doc_id, s.page_id, row_cluster, bool_or(o.grp is not null) as in_table, coalesce(bool_or(row_cluster between start_row and end_row), false) as in_data_rows, coalesce(bool_or(row_cluster >= start_row - 5 and row_cluster < start_row), false) as above_data from stats s left join ordinal o on s.doc_id = o.doc_id and s.page_id = o.page_id and row_cluster between start_row - 5 and end_row group by all"),
    "indents": (["cells"], "select doc_id, xr, sum(case when g is null or g > 10 then 1 else 0 end) over (partition by doc_id order by xr) - 1 as indent_level from (select doc_id, xr, xr - lag(xr) over (partition by doc_id order by xr) as g from (select distinct doc_id, round(x) as xr from (select *, min(x) over (partition by doc_id, page_id, row_cluster) as x0 from cells) where weight = 'bold' or style_rank >= 2 or x <= x0 + 5))"),
    "evid": (
        ["pos", "stats", "cross_", "aligned", "near", "indents"],
        """select p.*, weight = 'bold' as is_bold, style_rank >= 3 as is_rare, style_rank = 1 as is_dominant, p.y < y0 + (y1 - y0) * 0.1 as is_top_10pct, p.y + p.h > y1 - (y1 - y0) * 0.1 as is_bottom_10pct, n_pages, s.n_cells as row_n_cells, s.n_typed as row_n_typed, s.row_left, x <= s.row_left + 5 as is_leftmost, s.n_typed >= 2 as is_data_row,
  a.cell_id is not null as subtends_column, in_table, in_data_rows, above_data, indent_level, (weight = 'bold' or style_rank >= 2) and x <= s.row_left + 10 and s.n_typed <= 1 as is_section_label
from pos p join stats s using (doc_id, page_id, row_cluster) left join cross_ c on p.doc_id = c.doc_id and p.text = c.text and floor(p.y / 5)::bigint = c.b left join (select distinct doc_id, page_id, row_cluster, cell_id from aligned) a using (doc_id, page_id, row_cluster, cell_id)
join near using (doc_id, page_id, row_cluster) left join indents i on p.doc_id = i.doc_id and round(p.x) = i.xr""",
    ),
    "scoped": (
        ["evid"],
        """select e.*, last_value(label ignore nulls) over (partition by e.doc_id, e.page_id order by e.row_cluster range between unbounded preceding and current row) as scope_l0
from evid e left join (select doc_id, page_id, row_cluster, arg_min(text, cell_id) as label from evid where is_section_label and coalesce(indent_level, 0) = 0 group by all) using (doc_id, page_id, row_cluster)""",
    ),
}


# What a feature's value adds to col_header, section_label, row_label, dimension and prose, by tag; a dot is nothing.
WEIGHTS = """
default              f_pattern_match       true   -5.0  -5.0  -5.0  -5.0  -3.0
default              f_pattern_match       false   0.5     .     .   0.5   0.5
default              f_subtends_col        true    2.0  -1.0     .     .     .
default              f_subtends_col        false  -1.5     .     .     .     .
default              f_row_above_data      true    2.5  -1.0     .     .     .
default              f_row_above_data      false  -1.0     .     .     .     .
default              f_in_data_region      true      .     .   1.5   1.5  -1.0
default              f_in_data_region      false     .     .  -1.0  -2.0     .
default              f_in_table            true      .     .     .   1.0  -1.0
default              f_in_table            false     .     .     .  -1.0   2.0
default              f_bold                true    0.3   1.5   0.3     .     .
default              f_bold                false     .  -0.5     .     .   0.5
default              f_rare_style          true      .   1.0     .     .  -0.5
default              f_rare_style          false     .     .     .     .   0.3
default              f_leftmost            true      .   1.0   2.0     .     .
default              f_leftmost            false     .  -1.0  -2.0   0.5     .
default              f_no_measures_in_row  true      .   1.5     .     .   0.5
default              f_no_measures_in_row  false     .  -2.0   0.5     .  -0.5
default              f_cell_count_match    true    1.0     .     .     .     .
default              f_cell_count_match    false  -0.5     .     .     .     .
default              f_large_font          true      .   1.5     .     .     .
default              f_large_font          false     .   0.0     .     .     .
default              f_year_text           true    2.0  -2.0  -1.0   1.0  -3.0
financial_statement  f_bold                true      .   0.5  -0.5     .     .
financial_statement  f_leftmost            true      .   0.5     .     .     .
financial_statement  f_no_measures_in_row  true      .   0.5     .     .     .
financial_statement  f_no_measures_in_row  false     .     .   0.5     .     .
tax_form             f_bold                true    0.5     .     .     .     .
tax_form             f_rare_style          true    0.5     .     .     .     .
tax_form             f_subtends_col        true    0.5     .     .     .     .
tax_form             f_subtends_col        false  -2.0     .     .     .     .
journal_paper        f_in_table            false     .     .     .     .   1.0
journal_paper        f_rare_style          true      .   0.5     .     .     .
journal_paper        f_large_font          true      .   1.0     .     .     .
"""


def weights_cte() -> str:
    rows = []
    for line in WEIGHTS.strip().splitlines():
        tag, feature, value, *weights = line.split()
        rows += [f"('{tag}', '{feature}', {value}, '{role}', {w}::double)" for role, w in zip(("col_header", "section_label", "row_label", "dimension", "prose"), weights, strict=True) if w != "."]
    return f"select * from (values {', '.join(rows)}) as t(tag, feature, val, role, weight)"


def sql(select: str, needs: list[str], boxes: str = "report_boxes") -> str:
    """A query over the named blocks; ``boxes`` is the box source that the blocks start from."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        if name == "boxes":
            add(boxes)
            done[name] = f"select * from {boxes}"
        elif name == "weights":
            done[name] = weights_cte()
        else:
            before, body = CTES[name]
            for b in before:
                add(b)
            done[name] = body

    for n in needs:
        add(n)
    return "with " + ",\n".join(f"{k} as materialized ({v})" for k, v in done.items()) + "\n" + select
