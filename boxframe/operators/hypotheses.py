"""Role hypotheses from evidence, constraints among them, and their greedy resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import stored
from ..schema import CELL_KEY, PAGE_KEY, ROW_KEY
from .evidence import registry

# Priorities of the roles, most specific first.
PRIORITY = ("chrome", "col_header", "section_label", "total_label", "row_label", "measure", "dimension", "field_label", "field_value", "prose")


def _n(*flags: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])


def _hypothesis(name: str, where: Column, support: Column, against: Column, detail: Column) -> Column:
    return F.when(where, F.struct(F.lit(name).alias("hypothesis"), detail.cast("string").alias("detail"), support.cast("int").alias("support"), against.cast("int").alias("against")))


def generate(wide: DataFrame, keep: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """All hypotheses of all cells with a probe hit: support and against count the evidence.

    A cell's hypotheses are built in one projection and exploded, so the cells are read once. keep names columns of the cells that their hypotheses
    have too; with every, cells without hypotheses have a row of nulls.
    """
    row = Window.partitionBy(*ROW_KEY)
    order = row.orderBy("x", "cell_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = {i: F.coalesce(c, F.lit(False)) for i, c in registry(wide)}
    # The tests of texts come last: most cells have been hit before.
    hit = reduce(lambda a, b: a | b, [found[i] for i in sorted(found, reverse=True)])
    c = wide.withColumns({"__numeric": found[0], "__hit": hit})
    c = c.withColumns({"__n": F.count("*").over(whole), "__i": F.row_number().over(order), "__label": F.lag("text").over(order)})
    c = c if every else c.where("__hit")
    numeric, bold, rare, dominant = F.col("__numeric"), found[100], found[103], found[102]
    top, bottom, left, table, above, subtends, data, repeated = (found[i] for i in (200, 201, 202, 203, 204, 205, 206, 300))
    none, null = F.lit(0), F.lit(None)
    column = F.get("col_ids", F.lit(0))
    chrome_for, chrome_against = _n(repeated) * 3 + _n(rare, top, bottom), _n(table)
    fields = F.col("__n") == 2
    field = 2 + _n(~table), _n(data) * 2
    single = F.array(
        _hypothesis("chrome", (repeated | (rare & (top | bottom))) & (chrome_for > chrome_against), chrome_for, chrome_against, F.col("text")),
        _hypothesis("section_label", (bold | rare) & left & ~numeric, _n(bold, rare, left), _n(numeric, data), F.col("indent_level")),
        _hypothesis("total_label", bold & left & data & ~numeric, F.lit(3), none, null),
        _hypothesis("row_label", left & data & ~numeric, F.lit(2), none, null),
        _hypothesis("measure", numeric, _n(numeric, table, subtends), none, F.col("type")),
        _hypothesis("dimension", table & data & ~numeric & ~left, _n(table, subtends) + 1, _n(left, bold), column),
        _hypothesis("field_label", fields & (F.col("__i") == 1), *field, null),
        _hypothesis("field_value", fields & (F.col("__i") == 2), *field, F.col("__label")),
        _hypothesis("prose", F.lit(True), 1 + _n(dominant, ~numeric), _n(numeric, data), null),
    )
    header = F.transform(F.coalesce("col_ids", F.array().cast("array<bigint>")), lambda k: _hypothesis("col_header", subtends & above, 2 + _n(~numeric), _n(numeric), k))
    found_ = F.filter(F.concat(single, header), lambda h: h.isNotNull())
    return c.select(*CELL_KEY, *keep, F.inline_outer(F.when(F.col("__hit"), found_)) if every else F.inline(found_))


_HYPOTHESIS = [*CELL_KEY, "hypothesis", "detail"]


def _net() -> Column:
    return F.col("support") - F.col("against")


def _of(name: str) -> Column:
    return F.col("hypothesis") == name


def _best(which: Column) -> Column:
    """The most net support that a cell has for such hypotheses."""
    return F.max(F.when(which, _net())).over(Window.partitionBy(*CELL_KEY))


def _broken(tests: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]), lambda b: b.isNotNull())


def _exclusions(hyp: DataFrame) -> DataFrame:
    """hyp with broken: no measure is a header (the weaker one goes), no section in data rows, no header without a column."""
    rows = hyp.withColumns({"__m": _best(_of("measure")), "__h": _best(_of("col_header"))})
    tests = {
        "measure_not_header": (_of("col_header") & (F.col("__m") >= _net())) | (_of("measure") & (F.col("__h") > _net())), "section_not_in_data": _of("section_label") & (F.col("against") > 0),
        "header_implies_column": _of("col_header") & F.col("detail").isNull(),
    }
    return rows.withColumn("broken", _broken(tests)).drop("__m", "__h")


def _one_header(hyp: DataFrame) -> DataFrame:
    """hyp with second: of the headers of a column the best by net support stays, of equals the lowest on the page."""
    order = Window.partitionBy(*PAGE_KEY, "hypothesis", "detail").orderBy(_net().desc(), F.col("row_cluster").desc(), "cell_id")
    return hyp.withColumn("second", F.coalesce(_of("col_header") & F.col("detail").isNotNull() & (F.row_number().over(order) > 1), F.lit(False)))


def applied(hyp: DataFrame) -> DataFrame:
    """hyp with broken, the applied constraints that rule a hypothesis out: windows of cells and pages, whose rows are not joined with what rules them out."""
    rows = _one_header(_exclusions(hyp))
    return rows.withColumn("broken", F.when(F.col("second"), F.concat(F.array(F.lit("one_header_per_column")), F.col("broken"))).otherwise(F.col("broken"))).drop("second")


def violations(hyp: DataFrame) -> DataFrame:
    """Hypotheses that an applied constraint rules out: the constraint and the hypothesis' key. Only three kinds bear on these."""
    return applied(hyp.where(F.col("hypothesis").isin("col_header", "measure", "section_label"))).select(*_HYPOTHESIS, F.explode("broken").alias("constraint"))


#: What data is, for the constraint that chrome is none.
DATA_ROLES = ("measure", "row_label", "dimension")


def with_lone(wide: DataFrame) -> DataFrame:
    """Cells with lone: whether their row is no data row but the page's rows before and after it are."""
    order, row = Window.partitionBy(*PAGE_KEY).orderBy("row_cluster", "x", "cell_id"), Window.partitionBy(*ROW_KEY)
    data = F.col("row_n_typed") >= 2
    beside = lambda step: F.when(step("row_cluster").over(order) != F.col("row_cluster"), step(data).over(order))
    c = wide.withColumns({"__up": beside(F.lag), "__down": beside(F.lead)})
    c = c.withColumns({"__up": F.max("__up").over(row), "__down": F.max("__down").over(row)})
    return c.withColumn("lone", F.coalesce(~data & F.col("__up") & F.col("__down"), F.lit(False))).drop("__up", "__down")


def _chrome_not_data(hyp: DataFrame) -> DataFrame:
    """hyp with broken: a cell is chrome or data, whichever has more net support, chrome if equal; a lone row starts no section."""
    is_data = F.col("hypothesis").isin(*DATA_ROLES)
    rows = hyp.withColumns({"__c": _best(_of("chrome")), "__d": _best(is_data)})
    tests = {"chrome_not_data": (is_data & (F.col("__c") >= F.col("__d"))) | (_of("chrome") & (F.col("__d") > F.col("__c"))), "data_rows_contiguous": _of("section_label") & F.col("lone")}
    return rows.withColumn("broken", _broken(tests)).drop("__c", "__d")


def _one_title(hyp: DataFrame) -> DataFrame:
    """hyp with second: of a page's chrome the topmost stays."""
    top = Window.partitionBy(*PAGE_KEY, "hypothesis").orderBy("y", "x", "row_cluster", "cell_id")
    return hyp.withColumn("second", _of("chrome") & (F.row_number().over(top) > 1))


def declared_violations(hyp: DataFrame) -> DataFrame:
    """What the declared constraints rule out that the resolver does not apply.

    chrome_not_data: a cell is chrome or data, whichever has more net support, chrome if equal. one_page_title: of a page's chrome the topmost
    is its title. data_rows_contiguous: a lone row without data between two data rows is a sub-header or a total, so it
    starts no section. hyp has x and y of its cells, and lone of with_lone.
    """
    rows = hyp.where(F.col("hypothesis").isin("chrome", "section_label", *DATA_ROLES))
    rows = _one_title(_chrome_not_data(rows))
    broken = F.when(F.col("second"), F.concat(F.col("broken"), F.array(F.lit("one_page_title")))).otherwise(F.col("broken"))
    return rows.select(*_HYPOTHESIS, F.explode(broken).alias("constraint"))


def survivors(hyp: DataFrame) -> DataFrame:
    """hyp (as for declared_violations) with round: the round in which it was ruled out, null for what stands when nothing more goes.

    A round first rules out what excludes each other within cells and rows; only when that has ended do the survivors compete for columns
    and titles, so what is impossible itself displaces nothing. Each round shrinks what is left, to a fixed point. Kinds that no constraint names
    take no part in the rounds.
    """
    named = F.col("hypothesis").isin("chrome", "section_label", "col_header", *DATA_ROLES)
    left, out, n = hyp.where(named), hyp.where(~named).select(*_HYPOTHESIS, F.lit(None).cast("int").alias("round")), 0
    while True:
        n += 1
        first = _exclusions(left).withColumn("gone", F.size("broken") > 0).drop("broken")
        first = _chrome_not_data(first).withColumn("gone", F.col("gone") | (F.size("broken") > 0)).drop("broken")
        judged = stored(first, "judged")
        if judged.where("gone").isEmpty():
            second = _one_header(judged.drop("gone")).withColumnRenamed("second", "gone")
            judged = stored(_one_title(second).withColumn("gone", F.col("gone") | F.col("second")).drop("second"), "judged")
            if judged.where("gone").isEmpty():
                break
        out = out.unionByName(judged.where("gone").select(*_HYPOTHESIS, F.lit(n).alias("round")))
        left = judged.where("not gone").drop("gone")
    return out.unionByName(judged.select(*_HYPOTHESIS, F.lit(None).cast("int").alias("round")))


def resolve(hyp: DataFrame, cells: DataFrame) -> DataFrame:
    """One role per cell: of hypotheses with support above against and no violation the best net, then by priority; else unresolved."""
    return resolved(cells.select(*CELL_KEY, "x", "y", "text").join(hyp, CELL_KEY, "left"))


def resolved(hyp: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """resolve() for hypotheses that have x, y and text of their cells, and a row of nulls for cells without any; keep names further columns of the cells."""
    stands = (F.col("support") > F.col("against")) & (F.size("broken") == 0)
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("hypothesis"))
    best = F.min(F.when(stands, F.struct((F.col("against") - F.col("support")).alias("n"), rank.alias("p"), "hypothesis", "detail")))
    own = ("x", "y", "text", *keep)
    out = applied(hyp).groupBy(*CELL_KEY).agg(best.alias("b"), *[F.first(c).alias(c) for c in own])
    return out.select(*CELL_KEY, *own, F.coalesce("b.hypothesis", F.lit("unresolved")).alias("role"), F.col("b.detail").alias("detail"), (-F.col("b.n")).alias("net"))


def paths(roles: DataFrame) -> DataFrame:
    """Treemap paths: title / scope / row label / column header, of what there is, for every cell. roles have scope_l0 and col_ids of their cells.

    Titles, labels and the one header of each column come to the cells by windows of document, row and page.
    """
    of = lambda name, c: F.when(F.col("role").isin(*name), c)
    at = F.struct("page_id", "y", "x")
    r = roles.withColumn("row_label", F.min_by(of(("row_label", "total_label"), F.col("text")), of(("row_label", "total_label"), F.col("x"))).over(Window.partitionBy(*ROW_KEY)))
    heads = F.collect_list(of(("col_header",), F.struct(F.col("detail").cast("long").alias("col_id"), "row_cluster", (-F.col("cell_id")).alias("c"), "text"))).over(Window.partitionBy(*PAGE_KEY))
    r = r.withColumn("__heads", heads)
    mine = F.filter("__heads", lambda h: h.col_id == F.get("col_ids", F.lit(0)))
    r = r.withColumn("col_header", F.array_max(F.transform(mine, lambda h: F.struct(h["row_cluster"].alias("r"), h["c"].alias("c"), h["text"].alias("t"))))["t"]).drop("__heads")
    r = r.withColumn("title", F.min_by(of(("chrome",), F.col("text")), of(("chrome",), at)).over(Window.partitionBy("doc_id")))
    own = lambda name, role: F.when(F.col("role") != role, F.nullif(F.col(name), F.lit("")))
    path = F.concat_ws(" / ", own("title", "chrome"), own("scope_l0", "section_label"), own("row_label", "row_label"), own("col_header", "col_header"))
    return r.select(*CELL_KEY, "role", "text", path.alias("path"))
