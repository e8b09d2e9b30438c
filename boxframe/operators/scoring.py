"""Log-likelihood role scores over boolean features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CELL_KEY, PAGE_KEY
from . import geometry as g

ROLES = ("col_header", "section_label", "row_label", "dimension", "prose")
FEATURES = ("f_pattern_match", "f_in_table", "f_subtends_col", "f_row_above_data", "f_in_data_region", "f_bold", "f_rare_style", "f_leftmost", "f_no_measures_in_row", "f_cell_count_match", "f_large_font", "f_year_text")

# Fixed values: (tag, feature, value, weights by role).
WEIGHTS = (
    ("default", "f_pattern_match", True, {"col_header": -5.0, "section_label": -5.0, "row_label": -5.0, "dimension": -5.0, "prose": -3.0}),
    ("default", "f_pattern_match", False, {"col_header": 0.5, "dimension": 0.5, "prose": 0.5}),
    ("default", "f_subtends_col", True, {"col_header": 2.0, "section_label": -1.0}),
    ("default", "f_subtends_col", False, {"col_header": -1.5}),
    ("default", "f_row_above_data", True, {"col_header": 2.5, "section_label": -1.0}),
    ("default", "f_row_above_data", False, {"col_header": -1.0}),
    ("default", "f_in_data_region", True, {"row_label": 1.5, "dimension": 1.5, "prose": -1.0}),
    ("default", "f_in_data_region", False, {"row_label": -1.0, "dimension": -2.0}),
    ("default", "f_in_table", True, {"dimension": 1.0, "prose": -1.0}),
    ("default", "f_in_table", False, {"dimension": -1.0, "prose": 2.0}),
    ("default", "f_bold", True, {"section_label": 1.5, "col_header": 0.3, "row_label": 0.3}),
    ("default", "f_bold", False, {"section_label": -0.5, "prose": 0.5}),
    ("default", "f_rare_style", True, {"section_label": 1.0, "prose": -0.5}),
    ("default", "f_rare_style", False, {"prose": 0.3}),
    ("default", "f_leftmost", True, {"section_label": 1.0, "row_label": 2.0}),
    ("default", "f_leftmost", False, {"section_label": -1.0, "row_label": -2.0, "dimension": 0.5}),
    ("default", "f_no_measures_in_row", True, {"section_label": 1.5, "prose": 0.5}),
    ("default", "f_no_measures_in_row", False, {"section_label": -2.0, "row_label": 0.5, "prose": -0.5}),
    ("default", "f_cell_count_match", True, {"col_header": 1.0}),
    ("default", "f_cell_count_match", False, {"col_header": -0.5}),
    ("default", "f_large_font", True, {"section_label": 1.5}),
    ("default", "f_large_font", False, {"section_label": 0.0}),
    ("default", "f_year_text", True, {"col_header": 2.0, "dimension": 1.0, "section_label": -2.0, "prose": -3.0, "row_label": -1.0}),
    ("financial_statement", "f_bold", True, {"section_label": 0.5, "row_label": -0.5}),
    ("financial_statement", "f_leftmost", True, {"section_label": 0.5}),
    ("financial_statement", "f_no_measures_in_row", True, {"section_label": 0.5}),
    ("financial_statement", "f_no_measures_in_row", False, {"row_label": 0.5}),
    ("tax_form", "f_bold", True, {"col_header": 0.5}),
    ("tax_form", "f_rare_style", True, {"col_header": 0.5}),
    ("tax_form", "f_subtends_col", True, {"col_header": 0.5}),
    ("tax_form", "f_subtends_col", False, {"col_header": -2.0}),
    ("journal_paper", "f_in_table", False, {"prose": 1.0}),
    ("journal_paper", "f_rare_style", True, {"section_label": 0.5}),
    ("journal_paper", "f_large_font", True, {"section_label": 1.0}),
)
TAGS = ("default", "financial_statement", "tax_form", "journal_paper")


def weight_rows() -> list[tuple[str, str, bool, str, float]]:
    return [(t, f, v, r, w) for t, f, v, roles in WEIGHTS for r, w in roles.items()]


def features(typed: DataFrame) -> DataFrame:
    """Cells with the twelve boolean features, null where a cell has no table.

    Regions and their columns (geometry's table_regions and putative_columns) come from windows of the page and reach its cells as one array, so cells are
    neither joined nor shuffled if they are dealt by doc_id. Centres of different columns are more than 20 apart: a column's bounds are those of its own cells.
    """
    row, whole = Window.partitionBy(*g.ROW_KEY).orderBy("cell_id"), (Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = F.col("type").isin(*g.TYPED)
    c = typed.withColumns({"__n": F.count("*").over(row.rowsBetween(*whole)), "__m": F.sum(F.when(kinds, 1).otherwise(0)).over(row.rowsBetween(*whole)), "__left": F.min("x").over(row.rowsBetween(*whole)), "__i": F.row_number().over(row)})
    data, first = F.col("__m") >= 2, F.col("__i") == 1
    so_far = F.sum(F.when(data & first, 1).otherwise(0)).over(Window.partitionBy(*PAGE_KEY).orderBy("row_cluster"))
    c = c.withColumn("__t", so_far).withColumns({"__t": F.when(data, F.col("row_cluster") - F.col("__t")), "__xc": F.when(data & kinds, F.col("x") + F.col("w") / 2)})
    table = Window.partitionBy(*PAGE_KEY, "__t").orderBy("__xc")
    c = c.withColumns({
        "__g": F.col("__xc") - F.lag("__xc").over(table), "__start": F.min("row_cluster").over(table.rowsBetween(*whole)), "__end": F.max("row_cluster").over(table.rowsBetween(*whole)),
        "__modal": F.mode(F.when(first, F.col("__n")), True).over(table.rowsBetween(*whole)),
    })
    c = c.withColumn("__col", F.sum(F.when(F.col("__xc").isNotNull() & (F.col("__g").isNull() | (F.col("__g") > 20.0)), 1).otherwise(0)).over(table))
    column = Window.partitionBy(*PAGE_KEY, "__t", "__col").orderBy("__xc")
    mine = F.struct(F.col("__t").alias("t"), F.col("__start").alias("start"), F.col("__end").alias("end"), F.col("__modal").alias("modal"))
    bounds = F.struct(mine.alias("region"), F.min("x").over(column.rowsBetween(*whole)).alias("left"), F.max(F.col("x") + F.col("w")).over(column.rowsBetween(*whole)).alias("right"))
    # A region has data rows with consecutive ids, two at least.
    c = c.withColumn("__column", F.when(F.col("__xc").isNotNull() & (F.row_number().over(column) == 1) & (F.col("__end") > F.col("__start")), bounds))
    c = c.withColumns({"__columns": F.collect_list("__column").over(Window.partitionBy(*PAGE_KEY))})
    near = lambda k: (F.col("row_cluster") >= F.greatest(k.region.start - 5, F.lit(1))) & (F.col("row_cluster") <= k.region.end)
    below = lambda k: near(k) & (F.col("row_cluster") < k.region.start) & (F.col("x") < k.right) & (F.col("x") + F.col("w") > k.left)
    # Several regions may reach a cell; the one with the least id counts.
    c = c.withColumns({"__region": F.array_min(F.transform(F.filter("__columns", near), lambda k: k.region)), "__s": F.col("type").isNull() & F.exists("__columns", below)}).drop("__columns")
    c = c.withColumn("__size", F.percentile("font_size", F.lit(0.5)).over(Window.partitionBy("doc_id")))
    f = {
        "f_pattern_match": F.col("type").isNotNull() & (F.col("type") != "year"), "f_in_table": F.col("__region").isNotNull(), "f_subtends_col": F.col("__s"), "f_row_above_data": F.col("row_cluster") == F.col("__region.start") - 1,
        "f_in_data_region": F.col("row_cluster").between(F.col("__region.start"), F.col("__region.end")), "f_bold": F.col("weight") == "bold", "f_rare_style": F.col("style_rank") >= 3, "f_leftmost": F.col("x") <= F.col("__left") + 5,
        "f_no_measures_in_row": F.col("__m") == 0, "f_cell_count_match": F.col("__region").isNotNull() & (F.coalesce(F.abs(F.col("__n") - F.col("__region.modal")), F.lit(99)) <= 2),
        "f_large_font": F.try_divide(F.col("font_size"), F.col("__size")) > 1.2, "f_year_text": F.col("type") == "year",
    }
    return c.withColumns(f).select(*typed.columns, *f)


#: The columns of with_scores: a score for each tag and role.
SCORES = {(t, r): f"__{t}_{r}" for t in TAGS for r in ROLES}


def with_scores(featured: DataFrame) -> DataFrame:
    """Cells with a score for each tag and role, the sum of its features' weights; null if no feature has one. A tag's own weights add to the default's."""

    def terms(tag: str, role: str) -> list[Column]:
        by: dict[str, dict[bool, float]] = {}
        for t, f, v, r, w in weight_rows():
            if (t, r) == (tag, role):
                by.setdefault(f, {})[v] = w
        return [F.when(F.col(f) == next(iter(x)), F.lit(next(iter(x.values())))) if len(x) == 1 else F.when(F.col(f), F.lit(x[True])).when(~F.col(f), F.lit(x[False])) for f, x in by.items()]

    total = lambda t: reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in t], F.lit(0.0))
    some = lambda t: F.coalesce(*t).isNotNull() if t else F.lit(False)
    c = featured.withColumns({f"__sum_{r}": F.when(some(terms("default", r)), total(terms("default", r))) for r in ROLES})
    own = {(t, r): [] if t == "default" else terms(t, r) for t, r in SCORES}
    score = lambda k: F.when(F.col(f"__sum_{k[1]}").isNotNull() | some(own[k]), F.round(F.coalesce(f"__sum_{k[1]}", F.lit(0.0)) + total(own[k]), 6))
    return c.withColumns({name: score(k) for k, name in SCORES.items()}).drop(*[f"__sum_{r}" for r in ROLES])


def role_scores(featured: DataFrame) -> DataFrame:
    """score per cell, tag and role: one inline without a shuffle."""
    each = F.array(*[F.struct(F.lit(t).alias("active_tag"), F.lit(r).alias("role"), F.col(c).alias("score")) for (t, r), c in SCORES.items()])
    return with_scores(featured).select(*CELL_KEY, F.inline(F.filter(each, lambda s: s.score.isNotNull())))


def document_scores(featured: DataFrame) -> DataFrame:
    """Per document, tag and role the sum of its cells' scores and their number."""
    sums = with_scores(featured).groupBy("doc_id").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in SCORES.values() for f in (F.sum, F.count)])
    each = [F.struct(F.lit(t).alias("active_tag"), F.lit(r).alias("role"), F.round(f"{c}_sum", 4).alias("score"), F.col(f"{c}_count").alias("n")) for (t, r), c in SCORES.items()]
    return sums.select("doc_id", F.inline(F.filter(F.array(*each), lambda s: s.n > 0)))


def _best(tag: str) -> Column:
    return F.greatest(*[SCORES[tag, r] for r in ROLES])


def _mean(tenths: Column, n: Column) -> Column:
    """The mean to two decimals. Weights are tenths: sums of tenths are exact, so that equal means are equal in any order of addition."""
    return F.floor((tenths * 20 + n) / (n * 2)) / 100


def _tenths(best: Column) -> Column:
    return F.sum(F.round(best * 10).cast("long"))


def document_tags(featured: DataFrame) -> DataFrame:
    """winning_tags of the features' scores, summed within each document."""
    s = with_scores(featured).groupBy("doc_id").agg(*[x for t in TAGS for x in (_tenths(_best(t)).alias(f"{t}_sum"), F.count(_best(t)).alias(f"{t}_n"))])
    each = [F.when(F.col(f"{t}_n") > 0, F.struct((-_mean(F.col(f"{t}_sum"), F.col(f"{t}_n"))).alias("m"), F.lit(t).alias("active_tag"))) for t in TAGS]
    return s.select("doc_id", F.least(*each).alias("b")).where("b is not null").select("doc_id", "b.active_tag", (-F.col("b.m")).alias("mean_score"))


def winning_tags(scores: DataFrame) -> DataFrame:
    """Per document the tag with the highest mean best score, to two decimals; of equals the first by name."""
    best = scores.groupBy(*CELL_KEY, "active_tag").agg(F.max("score").alias("best"))
    mean = best.groupBy("doc_id", "active_tag").agg(_mean(_tenths(F.col("best")), F.count("*")).alias("mean_score"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("mean_score").desc(), "active_tag"))
    return mean.withColumn("__r", first).where("__r = 1").drop("__r")


def assign(featured: DataFrame, scores: DataFrame) -> DataFrame:
    """role and confidence (best minus the next lower score) of each cell under its document's winning tag, by scores as role_scores has them."""
    win = winning_tags(scores)
    wide = scores.join(win.select("doc_id", "active_tag"), ["doc_id", "active_tag"]).groupBy(*CELL_KEY).pivot("role", list(ROLES)).agg(F.sum("score"))
    return _assigned(featured.join(wide, CELL_KEY, "left").join(win.select("doc_id", F.col("active_tag").alias("winning_tag")), "doc_id", "left"))


def assigned(featured: DataFrame) -> DataFrame:
    """assign() by the features' own scores, with the tags' means as windows of the document."""
    doc = Window.partitionBy("doc_id")
    c = with_scores(featured)
    c = c.withColumns({k: v for t in TAGS for k, v in ((f"__{t}", _tenths(_best(t)).over(doc)), (f"__{t}_n", F.count(_best(t)).over(doc)))})
    each = [F.when(F.col(f"__{t}_n") > 0, F.struct((-_mean(F.col(f"__{t}"), F.col(f"__{t}_n"))).alias("m"), F.lit(t).alias("t"))) for t in TAGS]
    c = c.withColumn("winning_tag", F.least(*each)["t"])
    return _assigned(c.withColumns({r: F.coalesce(*[F.when(F.col("winning_tag") == t, F.col(SCORES[t, r])) for t in TAGS]) for r in ROLES})).drop(*SCORES.values(), *[x for t in TAGS for x in (f"__{t}", f"__{t}_n")])


def _assigned(c: DataFrame) -> DataFrame:
    c = c.fillna(0.0, list(ROLES))
    best = F.greatest(*ROLES)
    role: Column = F.when(F.col("f_pattern_match"), F.col("type"))
    for r in ROLES[:-1]:
        role = role.when(best == F.col(r), r)
    steps = F.array_sort(F.array_distinct(F.array(*ROLES)))
    gap = F.when(F.size(steps) > 1, best - F.get(steps, F.size(steps) - 2))
    return c.withColumns({"role": role.otherwise("prose"), "confidence": F.round(gap, 6)})
