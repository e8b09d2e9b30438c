"""Evidence passes on one wide frame of cells, and the entity-attribute-value view of it.

The wide frame is the working form: each pass adds typed columns with windows partitioned by document. Only ``evidence_rows``
turns them into text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import is_number, try_day, try_number
from ..schema import CELL_KEY, PAGE_KEY, ROW_KEY
from ..plans.ranks import numbered
from ..plans.store import stored
from . import domains
from . import geometry as g
from . import sieve

# Thresholds of the document profiles.
PROFILES = ("financial", "tabular", "form", "product", "narrative")


def typed(cells: DataFrame) -> DataFrame:
    """Adds type, the pattern of the text."""
    return cells.withColumn("type", sieve.pass1_type(F.col("text")))


def with_style(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"is_bold": F.col("weight") == "bold", "is_rare": F.col("style_rank") >= 3, "is_dominant": F.col("style_rank") == 1})


def with_position(cells: DataFrame) -> DataFrame:
    """Fractions of the page's content bounds."""
    page = Window.partitionBy(*PAGE_KEY)
    x0, y0 = F.min("x").over(page), F.min("y").over(page)
    width, height = F.max(F.col("x") + F.col("w")).over(page) - x0, F.max(F.col("y") + F.col("h")).over(page) - y0
    c = cells.withColumns({"x_frac": F.try_divide(F.col("x") - x0, width), "y_frac": F.try_divide(F.col("y") - y0, height), "w_frac": F.try_divide(F.col("w"), width), "__top": y0, "__height": height})
    top, tenth = F.col("__top"), F.col("__height") * 0.1
    return c.withColumns({"is_top_10pct": F.col("y") < top + tenth, "is_bottom_10pct": F.col("y") + F.col("h") > top + F.col("__height") - tenth}).drop("__top", "__height")


def with_color_outlier(cells: DataFrame) -> DataFrame:
    """Colour differs from the most frequent colour of the document's dominant style."""
    modal = F.mode(F.when(F.col("style_rank") == 1, F.col("color")), True).over(Window.partitionBy("doc_id"))
    return cells.withColumn("__modal", modal).withColumn("color_outlier", F.col("color") != F.col("__modal")).drop("__modal")


def with_cross_page(cells: DataFrame) -> DataFrame:
    """n_pages: on how many pages the text stands at the same height, to 5 units; null for one."""
    c = cells.withColumn("__at", F.floor(F.col("y") / 5).cast("long"))
    n = F.size(F.collect_set("page_id").over(Window.partitionBy("doc_id", "text", "__at"))).cast("long")
    return c.withColumn("n_pages", n).withColumn("n_pages", F.when((F.col("n_pages") > 1) & F.col("text").isNotNull() & F.col("__at").isNotNull(), F.col("n_pages"))).drop("__at")


def with_rows(cells: DataFrame) -> DataFrame:
    row = Window.partitionBy(*ROW_KEY)
    kinds = F.when(F.col("type").isin(*g.TYPED), 1).otherwise(0)
    c = cells.withColumns({"row_n_cells": F.count("*").over(row), "row_n_typed": F.sum(kinds).over(row), "row_left": F.min("x").over(row), "row_right": F.max(F.col("x") + F.col("w")).over(row)})
    return c.withColumns({"is_data_row": F.col("row_n_typed") >= 2, "row_width": F.col("row_right") - F.col("row_left"), "is_leftmost": F.col("x") <= F.col("row_left") + 5})


def columns_of_pages(cells: DataFrame, gap: float = 20.0) -> DataFrame:
    """Columns of a page from the centres of all typed cells: col_id, bounds, centre and number of cells.

    Cells are counted by their position first. A column takes all within ``gap`` of any of its centres, which bands of that
    width find by an equi-join; a position near several centres counts for each.
    """
    order = Window.partitionBy(*PAGE_KEY).orderBy("xc")
    at = cells.where("type is not null").groupBy(*PAGE_KEY, "x", "w").agg(F.count("*").alias("n")).withColumn("xc", F.col("x") + F.col("w") / 2)
    at = at.withColumn("__g", F.col("xc") - F.lag("xc").over(order))
    at = at.withColumns({"col_id": F.sum(F.when(F.col("__g").isNull() | (F.col("__g") > gap), 1).otherwise(0)).over(order), "__band": F.floor(F.col("xc") / gap)})
    bands = F.array(*[F.col("__band") + k for k in (-1, 0, 1)])
    bins = at.select(*PAGE_KEY, "col_id", F.col("xc").alias("bin"), bands.alias("__bands")).distinct().withColumn("__band", F.explode("__bands"))
    near = bins.drop("__bands").join(at.drop("col_id", "__g"), [*PAGE_KEY, "__band"]).where(F.abs(F.col("xc") - F.col("bin")) < gap)
    return near.groupBy(*PAGE_KEY, "col_id").agg(F.min("x").alias("col_left"), F.max(F.col("x") + F.col("w")).alias("col_right"), (F.sum(F.col("xc") * F.col("n")) / F.sum("n")).alias("col_center"), F.sum("n").alias("n_col_cells"))


def column_alignment(cells: DataFrame) -> DataFrame:
    """One row per cell and overlapped column, with alignment: centre of narrow cells, else the nearer edge."""
    c = cells.join(columns_of_pages(cells), PAGE_KEY).where("x < col_right and x + w > col_left")
    off = F.abs(F.col("x") + F.col("w") / 2 - F.col("col_center"))
    right = F.abs(F.col("x") + F.col("w") - F.col("col_center")) < F.abs(F.col("x") - F.col("col_center"))
    return c.withColumn("alignment", F.when((F.col("w") < 30) & (off < 5), "center").when(right, "right").otherwise("left"))


def with_subtends(cells: DataFrame, gap: float = 20.0) -> DataFrame:
    """col_ids, the sorted columns of columns_of_pages that a cell overlaps (null for none), and whether there are any.

    Centres of different columns are more than ``gap`` apart, so a column's bounds are those of its own cells. A page's columns come to its cells
    as one array, so cells are neither multiplied nor shuffled.
    """
    centre = F.when(F.col("type").isNotNull(), F.col("x") + F.col("w") / 2)
    order = Window.partitionBy(*PAGE_KEY).orderBy("__xc")
    c = cells.withColumn("__xc", centre).withColumn("__g", F.col("__xc") - F.lag("__xc").over(order))
    starts = F.when(F.col("__xc").isNotNull() & (F.col("__g").isNull() | (F.col("__g") > gap)), 1).otherwise(0)
    c = c.withColumn("__col", F.sum(starts).over(order))
    column = Window.partitionBy(*PAGE_KEY, "__col").orderBy("__xc")
    whole = column.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bounds = F.struct(F.col("__col").alias("col_id"), F.min("x").over(whole).alias("left"), F.max(F.col("x") + F.col("w")).over(whole).alias("right"))
    c = c.withColumn("__column", F.when(F.col("__xc").isNotNull() & (F.row_number().over(column) == 1), bounds))
    c = c.withColumn("__columns", F.collect_list("__column").over(Window.partitionBy(*PAGE_KEY)))
    over = F.array_sort(F.transform(F.filter("__columns", lambda k: (F.col("x") < k.right) & (F.col("x") + F.col("w") > k.left)), lambda k: k.col_id))
    c = c.withColumn("__over", over).drop("__xc", "__g", "__col", "__column", "__columns")
    c = c.withColumn("col_ids", F.when(F.size("__over") > 0, F.col("__over"))).drop("__over")
    return c.withColumn("subtends_column", F.col("col_ids").isNotNull())


def with_tables(cells: DataFrame) -> DataFrame:
    """Per cell whether any of the page's ordinal regions has its row near (in its rows or at most five cluster ids above), in its data rows, or above.

    Regions are runs of data rows without another row between, so a row lies in one if it is a data row, and is above one if one starts in the next five ids.
    """
    c = cells if "row_n_typed" in cells.columns else with_rows(cells)
    data = F.col("row_n_typed") >= 2
    page = Window.partitionBy(*PAGE_KEY).orderBy("row_cluster")
    before = F.last(data).over(page.rangeBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("__start", data & ~F.coalesce(before, F.lit(False)))
    c = c.withColumn("above_data", F.coalesce(F.max("__start").over(page.rangeBetween(1, 5)), F.lit(False)))
    return c.withColumns({"in_data_rows": data, "in_table": data | F.col("above_data")}).drop("__start")


def with_indents(cells: DataFrame, gap: float = 10.0) -> DataFrame:
    """indent_level of geometry.indent_edges for the cells whose rounded left edge is one of them, else null. cells have row_left."""
    order = Window.partitionBy("doc_id").orderBy("__xr")
    edge = F.coalesce((F.col("weight") == "bold") | (F.col("style_rank") >= 2) | (F.col("x") <= F.col("row_left") + 5), F.lit(False))
    c = cells.withColumns({"__xr": F.round("x"), "__edge": edge})
    before = F.last(F.when(F.col("__edge"), F.col("__xr")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumns({"__before": before, "__at_edge": F.max("__edge").over(order.rangeBetween(0, 0))})
    new = F.when(F.col("__edge") & (F.col("__before").isNull() | (F.col("__xr") - F.col("__before") > gap)), 1).otherwise(0)
    c = c.withColumn("__level", F.sum(new).over(order) - 1)
    return c.withColumn("indent_level", F.when(F.col("__at_edge") & F.col("__xr").isNotNull(), F.col("__level"))).drop("__xr", "__edge", "__before", "__at_edge", "__level")


def with_sections(cells: DataFrame) -> DataFrame:
    """is_section_label: bold or rare, near its row's left edge, at most one typed cell in the row; scope_l0 carries the last one at indent 0 down."""
    c = cells.withColumn("is_section_label", (F.col("is_bold") | (F.col("style_rank") >= 2)) & (F.col("x") <= F.col("row_left") + 10) & (F.col("row_n_typed") <= 1))
    c = with_indents(c)
    # The order is the one that hypotheses take a row's cells in, so that these are sorted once.
    row = Window.partitionBy(*ROW_KEY).orderBy("x", "cell_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = F.col("is_section_label") & (F.coalesce("indent_level", F.lit(0)) == 0)
    c = c.withColumn("__label", F.min_by(F.when(counts, F.col("text")), F.when(counts, F.col("cell_id"))).over(row))
    order = Window.partitionBy(*PAGE_KEY).orderBy("row_cluster").rangeBetween(Window.unboundedPreceding, 0)
    return c.withColumn("scope_l0", F.last("__label", ignorenulls=True).over(order)).drop("__label")


def profiles(typed_cells: DataFrame) -> DataFrame:
    """Profiles of each document with confidence; a document may have several."""
    row = typed_cells.groupBy(*ROW_KEY).agg(F.count("*").alias("n"))
    kv = row.groupBy("doc_id").agg((F.sum(F.when(F.col("n") == 2, 1).otherwise(0)) / F.count("*")).alias("kv"))
    s = typed_cells.groupBy("doc_id").agg(
        F.count("*").alias("n_cells"), F.count_distinct("page_id").alias("n_pages"), F.count_distinct("style_id").alias("n_styles"), F.avg((F.col("weight") == "bold").cast("double")).alias("bold"),
        F.avg(F.coalesce(F.col("type").isin("measure", "currency"), F.lit(False)).cast("double")).alias("measure"), F.sum(F.when(F.col("type") == "year", 1).otherwise(0)).alias("n_years"),
    ).join(kv, "doc_id")
    m, k = F.col("measure"), F.col("kv")
    tests = [("financial", 0.8, (m > 0.3) & (F.col("n_years") > 0)), ("tabular", 0.6, m > 0.2), ("form", 0.7, (k > 0.3) & (m < 0.2)), ("product", 0.6, (F.col("n_styles") >= 4) & (k > 0.1) & (m > 0.05)), ("narrative", 0.7, (m < 0.1) & (F.col("bold") < 0.1))]
    hit = F.filter(F.array(*[F.when(t, F.struct(F.lit(n).alias("profile"), F.lit(c).alias("confidence"))) for n, c, t in tests]), lambda p: p.isNotNull())
    general = F.array(F.struct(F.lit("general").alias("profile"), F.lit(0.5).alias("confidence")))
    return s.select("doc_id", "n_cells", "n_pages", F.inline(F.when(F.size(hit) == 0, general).otherwise(hit)))


def wide(cells: DataFrame) -> DataFrame:
    """All passes in order: cells with typed evidence columns.

    Every pass is a window within the document, so cells that are dealt by doc_id need no exchange and none is joined; passes that share an order stand together.
    """
    c = cells if "type" in cells.columns else typed(cells)
    c = with_color_outlier(with_tables(with_position(with_rows(with_style(c)))))
    return with_sections(with_cross_page(with_subtends(c)))


# Sources and keys of the evidence rows, with the columns that hold them.
CELL_EVIDENCE = {
    "style": {"style_rank": "style_rank", "style_count": "style_count", "is_bold": "is_bold", "is_rare": "is_rare", "is_dominant": "is_dominant"},
    "pattern": {"type": "type"},
    "position": {"x_frac": "x_frac", "y_frac": "y_frac", "w_frac": "w_frac", "is_top_10pct": "is_top_10pct", "is_bottom_10pct": "is_bottom_10pct"},
    "color": {"is_color_outlier": "color_outlier"},
    "cross_page": {"repeated_text_pages": "n_pages"},
    "row_geom": {"is_leftmost": "is_leftmost"},
    "column_align": {"subtends_column": "subtends_column"},
    "table_region": {"in_table": "in_table", "in_data_rows": "in_data_rows", "above_data": "above_data"},
    "indent": {"indent_level": "indent_level"},
    "section": {"is_section_label": "__section", "scope_l0": "scope_l0"},
}
ROW_EVIDENCE = {"row_geom": {"n_cells": "n_cells", "n_typed": "n_typed", "is_data_row": "is_data_row", "row_left": "row_left", "row_right": "row_right", "row_width": "row_width"}}
BLOCK_EVIDENCE = {"block": {"block_id": "block_id", "block_n_rows": "n_rows", "block_left": "block_left", "block_right": "block_right", "block_modal_cells": "modal_cells"}}
EVIDENCE_KEY = ["doc_id", "page_id", "row_cluster", "cell_id"]
#: What separates tokens of a cell for token-wise domain evidence.
TOKEN_BREAK = r"[\s,;:()\[\]/]+"


def _stacked(rows: DataFrame, evidence: dict[str, dict[str, str]], key: list[str]) -> DataFrame:
    """Evidence rows of columns: one inline without a shuffle; nulls have no row. Levels below the key are null."""
    each = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for s, keys in evidence.items() for k, c in keys.items()])
    return _levels(rows.select(*key, F.inline(F.filter(each, lambda e: e.value.isNotNull()))), key)


def _levels(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in key else F.lit(None).cast("long").alias(c) for c in EVIDENCE_KEY], "source", "key", "value")


def token_domains(cells: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per cell and domain the share of the cell's tokens (of two letters and more, repeats counted) that are members."""
    long = cells.where(F.char_length(F.trim("text")) > 1)
    parts = F.filter(F.split(F.trim("text"), TOKEN_BREAK), lambda t: F.char_length(t) > 1)
    tok = long.select(*CELL_KEY, F.size(parts).alias("n_tokens"), F.explode(parts).alias("token")).groupBy(*CELL_KEY, "n_tokens", domains.normalised(F.col("token")).alias("token")).agg(F.count("*").alias("times"))
    members = vocabulary.select("domain", domains.normalised(F.col("member")).alias("token")).distinct()
    hit = tok.join(members, "token").groupBy(*CELL_KEY, "n_tokens", "domain").agg(F.sum("times").alias("hits"))
    return hit.select(*CELL_KEY, "domain", F.round(F.col("hits") / F.col("n_tokens"), 3).alias("share"))


def evidence_rows(wide_cells: DataFrame, vocabulary: DataFrame, heights: DataFrame) -> DataFrame:
    """doc_id, page_id, row_cluster, cell_id, source, key, value of every pass; row, page and document evidence has nulls below its level.

    wide_cells is a stored table; heights has the body height of each document.
    """
    cell = _stacked(wide_cells.withColumn("__section", F.when(F.col("is_section_label"), F.lit(True))), CELL_EVIDENCE, CELL_KEY)
    aligned = column_alignment(wide_cells)
    columns = _stacked(aligned, {"column_align": {"col_id": "col_id", "col_center": "col_center"}, "alignment": {"type": "alignment"}}, CELL_KEY)
    tokens = token_domains(wide_cells, vocabulary)
    token = _levels(tokens.select(*CELL_KEY, F.lit("token_domain").alias("source"), F.col("domain").alias("key"), F.col("share").cast("string").alias("value")), CELL_KEY)
    stats = g.row_stats(wide_cells)
    rows = _stacked(stats.withColumns({"is_data_row": F.col("n_typed") >= 2, "row_width": F.col("row_right") - F.col("row_left")}), ROW_EVIDENCE, ROW_KEY)
    blocks = g.blocks(stats, heights)
    block = _stacked(blocks.select(*ROW_KEY, "block_id").join(g.block_summary(blocks), [*PAGE_KEY, "block_id"]), BLOCK_EVIDENCE, ROW_KEY)
    placed = aligned.select(*CELL_KEY, "col_id").distinct()
    n_columns = placed.groupBy(*PAGE_KEY).agg(F.count_distinct("col_id").alias("n_columns"))
    page = _stacked(n_columns, {"column_align": {"n_columns": "n_columns"}}, PAGE_KEY)
    hits = placed.join(tokens, CELL_KEY).groupBy(*PAGE_KEY, "col_id", "domain").agg(F.count("*").alias("hits")).where("hits >= 2")
    hits = hits.join(placed.groupBy(*PAGE_KEY, "col_id").agg(F.count("*").alias("n")), [*PAGE_KEY, "col_id"])
    name = F.concat(F.lit("col_"), F.col("col_id").cast("string"), F.lit(":"), F.col("domain"))
    col_domain = _levels(hits.select(*PAGE_KEY, F.lit("col_domain").alias("source"), name.alias("key"), F.round(F.col("hits") / F.col("n"), 3).cast("string").alias("value")), PAGE_KEY)
    kinds = profiles(wide_cells)
    each = F.array(F.struct(F.lit("profile").alias("key"), F.col("profile").alias("value")), F.struct(F.concat("profile", F.lit("_confidence")).alias("key"), F.col("confidence").cast("string").alias("value")))
    profile = _levels(kinds.select("doc_id", F.lit("doc_profile").alias("source"), F.inline(each)), ["doc_id"])
    pages = _stacked(wide_cells.groupBy("doc_id").agg(F.count_distinct("page_id").alias("n")), {"doc_info": {"n_pages": "n"}}, ["doc_id"])
    out = cell
    for more in (columns, token, rows, block, page, col_domain, profile, pages):
        out = out.unionByName(more)
    return out


def registry(wide_cells: DataFrame) -> list[tuple[int, Column]]:
    """Ordinal and condition of every probe of the fixed registry."""
    trimmed, whole = F.trim("text"), F.replace(F.col("text"), F.lit(","), F.lit(""))
    year = trimmed.rlike(sieve.YEAR) & F.coalesce(trimmed.try_cast("int").between(1900, 2099), F.lit(False))
    # A cast to an integer rounds, so any number in its range passes.
    integer = is_number(whole) & F.coalesce(F.abs(try_number(whole)) < 2.0**63, F.lit(False))
    italic = F.lower("font_name").contains("italic") if "font_name" in wide_cells.columns else F.lit(False)
    return [
        (0, is_number(sieve.stripped(F.col("text")))), (1, year), (2, try_day(F.col("text")).isNotNull()), (3, trimmed.rlike(sieve.CURRENCY)), (4, trimmed.rlike(sieve.PERCENTAGE)),
        (5, trimmed.rlike(sieve.ZIP_CODE)), (6, trimmed.rlike(sieve.ISO_DATE)), (7, integer), (8, trimmed.rlike(r"^\([\d,.]+\)\z")), (9, trimmed.rlike(r"^[\u2014\u2013-]\z")),
        (100, F.col("is_bold")), (101, italic), (102, F.col("is_dominant")), (103, F.col("is_rare")), (104, F.col("color_outlier")),
        (200, F.col("is_top_10pct")), (201, F.col("is_bottom_10pct")), (202, F.col("is_leftmost")), (203, F.col("in_table")), (204, F.col("above_data")), (205, F.col("subtends_column")), (206, F.col("in_data_rows")),
        (300, F.col("n_pages") > 1),
    ]


def probes(wide_cells: DataFrame) -> DataFrame:
    """Sorted ordinals of the probes that hit a cell; cells without a hit have no row."""
    found = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in registry(wide_cells)]), lambda p: p.isNotNull())
    return wide_cells.withColumn("probes", found).where(F.size("probes") > 0)


FIRST_DOMAIN = 1_000
#: Distinct members that may be broadcast to the cells.
MEMBERS = 100_000


def domain_ordinals(vocabulary: DataFrame) -> DataFrame:
    """domain, ordinal: the probes of domains are numbered from FIRST_DOMAIN by name."""
    return numbered(vocabulary.select("domain").distinct(), ["domain"], "ordinal", FIRST_DOMAIN)


def with_ordinals(wide_cells: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Cells with ordinals, those of every probe that hits, sorted: the fixed registry, and from FIRST_DOMAIN on the domains of which the whole text is a member.

    Members bring their domains' ordinals as one array for each text, so cells are not multiplied; they are broadcast if they are few, as counted.
    Cells without a hit have no row.
    """
    members = vocabulary.join(domain_ordinals(vocabulary), "domain").groupBy(domains.normalised(F.col("member")).alias("__m"))
    members = stored(members.agg(F.collect_set(F.col("ordinal").cast("int")).alias("__named")), "members")
    members = F.broadcast(members) if members.limit(MEMBERS + 1).count() <= MEMBERS else members
    fixed = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in registry(wide_cells)]), lambda p: p.isNotNull())
    c = wide_cells.withColumns({"__fixed": fixed, "__m": F.when(F.char_length(F.trim("text")) > 1, domains.normalised(F.col("text")))}).join(members, "__m", "left")
    c = c.withColumn("ordinals", F.array_sort(F.concat("__fixed", F.coalesce("__named", F.array().cast("array<int>"))))).drop("__fixed", "__named", "__m")
    return c.where(F.size("ordinals") > 0)


def probe_hits(wide_cells: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Cell key and ordinal of every probe that hits."""
    return with_ordinals(wide_cells, vocabulary).select(*CELL_KEY, F.explode("ordinals").alias("ordinal"))
