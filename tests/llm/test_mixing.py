from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxframe.llm import mixing

from .helpers import docs, empty, rows, space_words


def water(sizes):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full) or 1
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] >= 3 * sizes[s]}
        if not over:
            return target
        full |= over


def check(data, got):
    sizes = defaultdict(int)
    for d in data:
        sizes[d[3]] += len(space_words(d[1]))
    target, taken = water(sizes), defaultdict(int)
    for x in got:
        assert x["size"] == len(space_words(x.text)) and x.source_size == sizes[x.source]
        assert x.target == pytest.approx(target[x.source]) and 0 <= x.taken <= 3 * x["size"]
        taken[x.source] += x.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 5


def test_targets_and_epochs(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == len(rows())
    check(rows(), got)
    by = defaultdict(set)
    for x in got:  # complete epochs precede fractional selection: within a source the counts differ by one epoch at most
        if x["size"]:
            by[x.source].add(x.taken // x["size"])
    assert all(max(v) - min(v) <= 1 for v in by.values())


def test_capped_sources(spark):
    data = [(i, "w " * (2 if i < 3 else 500), None, s, 0, "", "", "") for i, s in enumerate(["c", "b", "a", "z", None, "z"])]
    df = spark.createDataFrame(data, docs(spark).schema)
    check(data, mixing.mix(df).collect())


def test_reruns_and_layout_agree(spark):
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "taken").collect()))
    assert key(mixing.mix(docs(spark))) == key(mixing.mix(docs(spark).repartition(7)))


def test_many_bins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MIN_BINS", 1)
    one = sorted(map(str, mixing.mix(docs(spark)).select("doc_id", "text", "taken").collect()))
    monkeypatch.setattr(mixing, "MIN_BINS", 1 << 16)
    assert one == sorted(map(str, mixing.mix(docs(spark)).select("doc_id", "text", "taken").collect()))


def test_empty_table(spark):
    assert mixing.mix(empty(spark)).count() == 0


def test_bins_stay_small_whatever_the_weights(spark):
    """Low weights push keys up; no bin may hold more than its share of them."""
    for weight in (0.2, 1.0):
        key = -F.log(mixing.uniform(F.col("id"), 5)) / weight
        most = spark.range(50_000).groupBy(mixing.key_bin(key, 64).alias("b")).count().agg(F.max("count")).first()[0]
        assert most < 1.3 * 50_000 / (2.718 * 64)


def test_clashing_columns_stay(spark):
    extra = ["epochs", "rest", "bin", "before", "n", "m", "upto", "key", "w", "cap", "level", "total"]
    d = docs(spark).selectExpr("doc_id", "text", "source", *[f"'own' as {c}" for c in extra])
    got = mixing.mix(d)
    assert set(got.columns) == {*d.columns, "size", "source_size", "target", "taken"} and all(x[c] == "own" for x in got.collect() for c in extra)
