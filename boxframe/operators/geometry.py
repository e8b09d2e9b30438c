"""Row clustering, cell merging and table recovery over boxes, per document.

All windows are partitioned by doc_id (and page), so one exchange on doc_id serves them; no step collects or crosses
documents. Ties in position are broken by the reading order ``ord``, except where equal x shares a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import CELL_KEY, PAGE_KEY, ROW_KEY

TYPED = ("measure", "currency", "percentage", "date", "iso_date", "year")
PUNCT = r"^[,.:;]+\z"
STYLE = ("weight", "font_size", "font_name", "color", "style_id")


def body_height(boxes: DataFrame) -> DataFrame:
    """bh: the median height above 2 of a document, at least 4."""
    return boxes.groupBy("doc_id").agg(F.greatest(F.expr("percentile(h, 0.5) filter (where h > 2)"), F.lit(4.0)).alias("bh"))


def row_clusters(boxes: DataFrame) -> DataFrame:
    """Adds bh and row_cluster: a new row at a page's start or a vertical gap above bh; taller rows are cut into bands of bh.

    Rows are numbered through the document; bands are numbered row * 1000 + band.
    """
    order = Window.partitionBy("doc_id").orderBy("page_id", "y", "x", "ord")
    tall_enough = F.when(F.col("h") > 2, F.col("h"))
    b = boxes.withColumn("bh", F.greatest(F.percentile(tall_enough, F.lit(0.5)).over(Window.partitionBy("doc_id")), F.lit(4.0)))
    starts = F.lag("y").over(order).isNull() | (F.lag("page_id").over(order) != F.col("page_id")) | (F.col("y") - F.lag("y").over(order) > F.col("bh"))
    b = b.withColumn("__new", starts.cast("int")).withColumn("__row", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    row = Window.partitionBy("doc_id", "page_id", "__row")
    tall = F.max("y").over(row) - F.min("y").over(row) > 2 * F.col("bh")
    band = F.col("__row") * 1000 + F.floor((F.col("y") - F.min("y").over(row)) / F.col("bh"))
    return b.withColumn("row_cluster", F.when(tall, band).otherwise(F.col("__row")).cast("long")).drop("__new", "__row")


def midline_rows(boxes: DataFrame) -> DataFrame:
    """The other clustering: dense rank of rounded midlines in a page."""
    mid = F.round((F.col("y") + F.col("h") / 2) / F.greatest("h", F.lit(1.0)))
    return boxes.withColumn("row_cluster", F.dense_rank().over(Window.partitionBy(*PAGE_KEY).orderBy(mid)).cast("long"))


def gap_threshold(document: WindowSpec) -> Column:
    """Twice the 75th percentile of a document's word gaps, at least bh."""
    between = F.when((F.col("gap") > 0.5) & (F.col("gap") < 3 * F.col("bh")), F.col("gap"))
    p75 = F.percentile(between, F.lit(0.75)).over(document)
    return F.greatest(F.coalesce(p75, F.max("bh").over(document)) * 2, F.max("bh").over(document))


def fragments(rows: DataFrame) -> DataFrame:
    """Adds cell_id: a new cell where the gap to the left exceeds the document's threshold; equal x shares a cell."""
    order = Window.partitionBy(*ROW_KEY).orderBy("x", "ord")
    g = rows.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)).withColumn("thr", gap_threshold(Window.partitionBy("doc_id")))
    new = F.when(F.col("gap").isNull() | (F.col("gap") > F.col("thr")), 1).otherwise(0)
    return g.withColumn("__new", new).withColumn("cell_id", F.sum("__new").over(Window.partitionBy(*ROW_KEY).orderBy("x"))).drop("__new", "gap", "thr")


def local_fragments(rows: DataFrame, factor: float = 0.8, least: float = 3.0) -> DataFrame:
    """The other merge: a gap above greatest(previous height * factor, least) starts a cell."""
    order = Window.partitionBy(*ROW_KEY).orderBy("x", "ord")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)
    new = F.when(gap.isNull() | (gap > F.greatest(F.lag("h").over(order) * factor, F.lit(least))), 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("cell_id", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def cells(frags: DataFrame) -> DataFrame:
    """One row per cell: extent, text joined with punctuation glued to its neighbours, most frequent style (ties: lowest).

    A cell's fragments are gathered once, in order, by a window that fragments() has sorted for already but for the cell. If frags has the rank and
    count of the boxes' styles, a cell has those of its style.
    """
    order = Window.partitionBy(*CELL_KEY).orderBy("x", "ord")
    cell = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranks = [c for c in ("style_rank", "style_count") if c in frags.columns]
    parts = F.collect_list(F.struct("text", *STYLE, *ranks)).over(cell)
    punct = lambda c: F.coalesce(c.rlike(PUNCT), F.lit(False))
    f = frags.withColumns({
        "__i": F.row_number().over(order), "__parts": parts, "__x": F.min("x").over(cell), "__y": F.min("y").over(cell), "__right": F.max(F.col("x") + F.col("w")).over(cell), "__h": F.max("h").over(cell),
        **{f"__{k}_{c}": f(c).over(cell) for c in STYLE for k, f in (("a", F.min), ("z", F.max))},
    }).where("__i = 1")
    texts = F.col("__parts.text")
    glued = lambda t, i: F.when(punct(t) | ((i > 0) & punct(F.get(texts, i - 1))), t).otherwise(F.concat(F.lit(" "), t))
    joined = F.when(F.size("__parts") == 1, F.col("text")).otherwise(F.array_join(F.transform(texts, glued), ""))

    def mode(c: str) -> Column:
        known = F.filter(F.col(f"__parts.{c}"), lambda v: v.isNotNull())
        counted = F.transform(F.array_distinct(known), lambda v: F.struct((-F.size(F.filter(known, lambda u: u == v))).alias("n"), v.alias("v")))
        return F.when(F.col(f"__a_{c}") == F.col(f"__z_{c}"), F.col(f"__a_{c}")).otherwise(F.array_min(counted)["v"])

    out = f.select(
        *CELL_KEY, F.col("__x").alias("x"), F.col("__y").alias("y"), (F.col("__right") - F.col("__x")).alias("w"), F.col("__h").alias("h"), F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"),
        *[mode(c).alias(c) for c in STYLE], F.size("__parts").cast("long").alias("n_fragments"), "__parts",
    )
    own = F.get(F.filter("__parts", lambda p: p.style_id == F.col("style_id")), F.lit(0))
    return out.select(*[c for c in out.columns if c != "__parts"], *[own[c].alias(c) for c in ranks])


def style_histogram(boxes: DataFrame) -> DataFrame:
    """style_count and style_rank (ties share) of each style of a document."""
    n = boxes.groupBy("doc_id", "style_id").agg(F.count("*").alias("style_count"))
    return n.withColumn("style_rank", F.rank().over(Window.partitionBy("doc_id").orderBy(F.col("style_count").desc())))


def with_style_ranks(boxes: DataFrame) -> DataFrame:
    """Boxes with the style_count and style_rank of their style (null without one), as style_histogram has them, by windows of the document."""
    style = Window.partitionBy("doc_id", "style_id").orderBy("ord")
    whole = style.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = boxes.withColumns({"style_count": F.when(F.col("style_id").isNotNull(), F.count("*").over(whole)), "__n": F.count("*").over(whole), "__i": F.row_number().over(style)})
    counts = F.collect_list(F.when(F.col("__i") == 1, F.col("__n"))).over(Window.partitionBy("doc_id"))
    b = b.withColumn("__counts", counts)
    return b.withColumn("style_rank", F.when(F.col("style_id").isNotNull(), F.size(F.filter("__counts", lambda n: n > F.col("__n"))) + 1)).drop("__n", "__i", "__counts")


def document_cells(boxes: DataFrame) -> DataFrame:
    """Boxes to cells with their style's rank and count. Every step is a window of the document: one exchange by doc_id, or none if the boxes are dealt so."""
    return cells(fragments(row_clusters(with_style_ranks(boxes))))


def grid_mode(boxes: DataFrame) -> DataFrame:
    """Documents all of whose boxes are one wide: each box is a cell."""
    return boxes.groupBy("doc_id").agg(((F.count_distinct("w") == 1) & (F.min("w") == 1.0)).alias("is_grid"))


def row_stats(typed: DataFrame) -> DataFrame:
    """Per row of typed cells: counts and extent."""
    return typed.groupBy(*ROW_KEY).agg(
        F.count("*").alias("n_cells"), F.sum(F.when(F.col("type").isin(*TYPED), 1).otherwise(0)).alias("n_typed"),
        F.min("x").alias("row_left"), F.max(F.col("x") + F.col("w")).alias("row_right"), F.min("y").alias("row_top"), F.max(F.col("y") + F.col("h")).alias("row_bottom"),
    )


def table_regions(stats: DataFrame, least: int = 2) -> DataFrame:
    """Islands of consecutive data rows (two typed cells or more) with at least ``least`` rows."""
    island = F.col("row_cluster") - F.row_number().over(Window.partitionBy(*PAGE_KEY).orderBy("row_cluster"))
    runs = stats.where("n_typed >= 2").withColumn("table_id", island)
    return runs.groupBy(*PAGE_KEY, "table_id").agg(
        F.min("row_cluster").alias("start_row"), F.max("row_cluster").alias("end_row"), F.count("*").alias("n_data_rows"), F.mode("n_cells", True).alias("modal_cols"),
        F.min("row_left").alias("table_left"), F.max("row_right").alias("table_right"), F.min("row_top").alias("table_top"), F.max("row_bottom").alias("table_bottom"),
    ).where(F.col("n_data_rows") >= least)


def ordinal_regions(stats: DataFrame) -> DataFrame:
    """Islands over the rows' ordinals instead of their cluster ids; a single data row is a region."""
    order = Window.partitionBy(*PAGE_KEY).orderBy("row_cluster")
    rows = stats.withColumn("row_ord", F.row_number().over(order)).where("n_typed >= 2")
    runs = rows.withColumn("__g", F.col("row_ord") - F.row_number().over(Window.partitionBy(*PAGE_KEY).orderBy("row_ord")))
    regions = runs.groupBy(*PAGE_KEY, "__g").agg(F.min("row_cluster").alias("start_row"), F.max("row_cluster").alias("end_row"), F.count("*").alias("n_rows"))
    return regions.withColumn("region_id", F.dense_rank().over(Window.partitionBy(*PAGE_KEY).orderBy("__g"))).drop("__g")


def segments(stats: DataFrame, least: int = 3) -> DataFrame:
    """Stretches of rows with two cells or more, at least ``least`` long."""
    order = Window.partitionBy(*PAGE_KEY).orderBy("row_cluster")
    s = stats.withColumn("segment", F.sum(F.when(F.col("n_cells") < 2, 1).otherwise(0)).over(order)).where("n_cells >= 2")
    return s.groupBy(*PAGE_KEY, "segment").agg(F.min("row_cluster").alias("start_row"), F.max("row_cluster").alias("end_row"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)


def putative_columns(typed: DataFrame, regions: DataFrame, gap: float = 20.0) -> DataFrame:
    """Columns of each region from the centres of its typed cells: a gap above 20 starts a column.

    A column's extent takes all cells within 20 of any of its centres, so neighbours may share cells.
    """
    r = regions.select(*PAGE_KEY, "table_id", "start_row", "end_row")
    inside = typed.where(F.col("type").isin(*TYPED)).join(r, PAGE_KEY).where("row_cluster between start_row and end_row").withColumn("xc", F.col("x") + F.col("w") / 2)
    key = [*PAGE_KEY, "table_id"]
    order = Window.partitionBy(*key).orderBy("xc")
    bins = inside.select(*key, "xc").distinct().withColumn("__g", F.col("xc") - F.lag("xc").over(order))
    bins = bins.withColumn("col_id", F.sum(F.when(F.col("__g").isNull() | (F.col("__g") > gap), 1).otherwise(0)).over(order)).withColumnRenamed("xc", "bin").drop("__g")
    near = bins.join(inside, key).where(F.abs(F.col("xc") - F.col("bin")) < gap)
    return near.groupBy(*key, "col_id").agg(F.min("x").alias("col_left"), F.max(F.col("x") + F.col("w")).alias("col_right"), F.avg("xc").alias("col_center"), F.count("*").alias("n_measure_cells"))


def column_headers(typed: DataFrame, regions: DataFrame, columns: DataFrame) -> DataFrame:
    """The untyped cell closest above a region, at most five rows, that overlaps a column; of equals the leftmost."""
    r = regions.select(*PAGE_KEY, "table_id", "start_row")
    cand = typed.where("type is null").join(r, PAGE_KEY).where("row_cluster >= greatest(start_row - 5, 1) and row_cluster < start_row")
    c = cand.join(columns, [*PAGE_KEY, "table_id"]).where("x < col_right and x + w > col_left")
    best = F.max_by(F.struct("row_cluster", "cell_id", "text"), F.struct("row_cluster", -F.col("cell_id")))
    return c.groupBy(*PAGE_KEY, "table_id", "col_id").agg(best.alias("b")).select(*PAGE_KEY, "table_id", "col_id", F.col("b.row_cluster").alias("header_row"), F.col("b.cell_id").alias("header_cell"), F.col("b.text").alias("header_text"))


def indent_edges(cells: DataFrame, gap: float = 10.0) -> DataFrame:
    """indent_level of the rounded left edges xr of a document's bold, rare or leftmost cells: edges more than 10 apart are levels."""
    first = F.min("x").over(Window.partitionBy(*ROW_KEY))
    c = cells.withColumn("__first", first).withColumn("xr", F.round("x"))
    edges = c.where((F.col("weight") == "bold") | (F.col("style_rank") >= 2) | (F.col("x") <= F.col("__first") + 5)).select("doc_id", "xr").distinct()
    order = Window.partitionBy("doc_id").orderBy("xr")
    edges = edges.withColumn("__g", F.col("xr") - F.lag("xr").over(order))
    return edges.withColumn("indent_level", F.sum(F.when(F.col("__g").isNull() | (F.col("__g") > gap), 1).otherwise(0)).over(order) - 1).drop("__g")


def indent_levels(cells: DataFrame, gap: float = 10.0) -> DataFrame:
    """The cells whose left edge has an indent_level."""
    return cells.withColumn("xr", F.round("x")).join(indent_edges(cells, gap), ["doc_id", "xr"]).drop("xr")


def blocks(stats: DataFrame, heights: DataFrame) -> DataFrame:
    """block_id per row: a white gap above 2 * bh between a row's bottom and the next one's top starts a block."""
    order = Window.partitionBy(*PAGE_KEY).orderBy("row_top", "row_cluster")
    s = stats.join(heights, "doc_id").withColumn("__g", F.col("row_top") - F.lag("row_bottom").over(order))
    return s.withColumn("block_id", F.sum(F.when(F.col("__g").isNull() | (F.col("__g") > 2 * F.col("bh")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__g", "bh")


def block_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*PAGE_KEY, "block_id").agg(F.count("*").alias("n_rows"), F.min("row_left").alias("block_left"), F.max("row_right").alias("block_right"), F.mode("n_cells", True).alias("modal_cells"))


def layout_class(rows: DataFrame) -> DataFrame:
    """Class of a page by the histogram of where its segments of words start.

    A segment starts a row or follows a gap above a tenth of the page's width; bins are a twentieth of it; a bin above
    greatest(2 * median, 3) is a peak.
    """
    page = rows.groupBy(*PAGE_KEY).agg(F.max(F.col("x") + F.col("w")).alias("width"))
    order = Window.partitionBy(*ROW_KEY).orderBy("x", "ord")
    s = rows.join(page, PAGE_KEY).withColumn("__g", F.col("x") - F.lag(F.col("x") + F.col("w")).over(order))
    s = s.where(F.col("__g").isNull() | (F.col("__g") > 0.1 * F.col("width"))).withColumn("bin", F.floor(F.col("x") / (F.col("width") * 0.05)))
    n = s.groupBy(*PAGE_KEY, "bin").agg(F.count("*").alias("n"), F.max("width").alias("width"))
    mid = n.groupBy(*PAGE_KEY).agg(F.expr("percentile(n, 0.5)").alias("mid"))
    peak = n.join(mid, PAGE_KEY).withColumn("peak", F.col("n") > F.greatest(F.col("mid") * 2, F.lit(3.0)))
    p = peak.groupBy(*PAGE_KEY).agg(F.sum(F.col("peak").cast("int")).alias("n_peaks"), F.min(F.when(F.col("peak"), F.col("bin"))).alias("lo"), F.max(F.when(F.col("peak"), F.col("bin"))).alias("hi"))
    kind = (
        F.when(F.col("n_peaks") == 0, "mixed").when(F.col("n_peaks") == 1, "single").when((F.col("n_peaks") == 2) & ((F.col("hi") - F.col("lo")) * 0.05 > 0.3), "two_column")
        .when(F.col("n_peaks") <= 3, "multi").otherwise("grid")
    )
    return p.select(*PAGE_KEY, "n_peaks", kind.alias("layout"))


def row_regularity(stats: DataFrame) -> DataFrame:
    """Coefficient of variation of the gaps between rows: below .3 regular, above .7 irregular."""
    order = Window.partitionBy(*PAGE_KEY).orderBy("row_top", "row_cluster")
    g = stats.withColumn("g", F.col("row_top") - F.lag("row_top").over(order))
    a = g.groupBy(*PAGE_KEY).agg(F.count("g").alias("n_gaps"), (F.stddev_samp("g") / F.nullif(F.avg("g"), F.lit(0.0))).alias("cv"))
    return a.withColumn("spacing", F.when(F.col("cv") < 0.3, "regular").when(F.col("cv") > 0.7, "irregular").when(F.col("cv").isNotNull(), "mixed"))


def body_start(typed: DataFrame) -> DataFrame:
    """The first row of a page with a number and two cells or more."""
    n = typed.groupBy(*ROW_KEY).agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("type") == "measure", F.lit(False))).alias("numeric"))
    return n.where("numeric and n >= 2").groupBy(*PAGE_KEY).agg(F.min("row_cluster").alias("body_row"))


def page_furniture(cells: DataFrame) -> DataFrame:
    """page_title (larger than 1.3 of the modal size, in the top 15 %) and page_number (an integer of up to 5 digits in the bottom 10 %)."""
    size = cells.groupBy("doc_id").agg(F.mode("font_size", True).alias("modal"))
    bottom = Window.partitionBy(*PAGE_KEY)
    c = cells.join(size, "doc_id").withColumn("ymax", F.max("y").over(bottom))
    role = F.when((F.col("font_size") > 1.3 * F.col("modal")) & (F.col("y") < 0.15 * F.col("ymax")), "page_title").when((F.col("y") > 0.9 * F.col("ymax")) & F.col("text").rlike(r"^[0-9]{1,5}\z"), "page_number")
    return c.select(*CELL_KEY, "text", role.alias("page_role")).where("page_role is not null")
