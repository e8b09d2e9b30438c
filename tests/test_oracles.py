"""Every registered query with an oracle gives the oracle's rows, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from boxframe import catalog, catalog_evidence

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def one_evidence_chain():
    """The wide frame of evidence is stored once for all queries on it."""
    build, kept = catalog.wide, {}
    with pytest.MonkeyPatch.context() as m:
        for module in (catalog, catalog_evidence):
            m.setattr(module, "wide", lambda s, d: kept.get(d) or kept.setdefault(d, build(s, d)))
        yield


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.9g}" if hasattr(v, "as_integer_ratio") else str(v)


def rows(found) -> Counter:
    return Counter(tuple(map(plain, r)) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    oracle = catalog.ORACLES[name]
    assert sorted(con.sql(oracle).columns) == columns
    expected = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({oracle}) q").fetchall()
    assert rows(df.select(*columns).collect()) == rows(expected)
