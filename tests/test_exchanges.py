"""Queries over documents deal the orders by customer once: what follows stays within a document, so nothing as large as the cells is shuffled or stored."""

import os

import pytest

from boxframe import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", ["report_cells", "section_scope", "role_hypotheses", "constraint_violations", "declared_constraints", "roles_greedy", "treemap_paths", "role_features", "role_scores", "winning_tag", "role_argmax"])
def test_one_exchange_and_no_stored_table(spark, name, monkeypatch):
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda *a, **b: pytest.fail("a table is stored"))
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 1 and "Join" not in plan


def test_probes_shuffle_no_cells(spark):
    plan = catalog.QUERIES["cell_probes"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # The members come as a broadcast; a second deal would be one of cells.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
