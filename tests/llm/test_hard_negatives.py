import math
import random

import numpy as np
import pytest

from boxframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q string, cell int, score double"


def table(n=330, width=6, seed=4):
    """Clusters, one vector that many rows share, ties, nulls, NaN, infinities, repeated rows, short, empty and huge vectors."""
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    out = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)], r.randrange(3)) for i in range(n)]
    out += [(1000 + i, [0.5] * width, r.randrange(2)) for i in range(60)]
    out += [(2000, None, 1), (2010, [0.1] * width, None), (2020, [None, *[0.1] * (width - 1)], 1), (2030, [math.nan] * width, 1), (2040, [math.inf] * width, 2)]
    out += [(2050, [0.3, 0.4], 1), (2060, [], 0), (2070, [1e30] * width, 1), (None, [0.5] * width, 1), (None, out[3][1], 2), out[0], out[0], (0, out[7][1], 1)]
    return [(*x, "c", "q", 1, 0.5) for x in out]


def brute(rows, every=10, positives=5, negatives=10):
    seen = {}
    width = max(len(x[1] or []) for x in rows)
    for i, e, label, *_ in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in e]
        if all(abs(256 * float(np.float32(x))) < hn.LARGEST for x in e):
            seen[(hn.NO_ID if i is None else i, label, tuple(q))] = np.array(q + [0] * (width - len(q)), object)
    rows = [(i, label, q) for (i, label, _), q in seen.items()]
    known = lambda i: None if i == hn.NO_ID else i
    out = []
    for i, label, q in rows:
        if i == hn.NO_ID or i % every:
            continue
        scored = sorted((-int(q @ x), j, m) for j, m, x in rows if j != i)
        # Of candidates with equal label and vector only the first count, which changes nothing here but for rows without an id.
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(t, k) for t, k, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, known(j), n, known(k), -s, -t) for n, (t, k) in enumerate(fits, 1)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    got = hn.mine(spark.createDataFrame(rows, SCHEMA), anchor=hn.F.col("id") % 10 == 0, **more)
    return sorted((tuple(x) for x in got.collect()), key=str)


@pytest.mark.parametrize(("pivot", "group", "block"), [(512, 1024, 16384), (4, 3, 90)])
def test_against_brute_force(spark, monkeypatch, pivot, group, block):
    monkeypatch.setattr(hn, "PER_PIVOT", pivot)
    monkeypatch.setattr(hn, "GROUP", group)
    monkeypatch.setattr(hn, "BLOCK", block)
    rows = table()
    want = brute(rows)
    assert len(want) > 300 and found(spark, rows) == want
    few = found(spark, rows, positives=2, negatives=3)
    assert few == brute(rows, positives=2, negatives=3)


def test_bounds_keep_candidates_away(spark):
    """Far clusters are replicated to few groups, and nothing is lost by it."""
    r = random.Random(5)
    rows = [(i, [100.0 * (i % 8 == k) + r.gauss(0, 0.5) for k in range(8)], r.randrange(2), "", "", 0, 0.0) for i in range(400)]
    assert found(spark, rows) == brute(rows)
    vectors = hn.vectors(spark.createDataFrame(rows, SCHEMA))
    q = np.array([x.q for x in vectors.collect()])
    space = hn.Space(q, 8, int(abs(q).max()), float((q * q).sum(1).max()), 8)
    near, far = hn.located(vectors, space, False), hn.located(vectors.where("id % 10 = 0"), space, True)
    groups = hn._grouped(far, False).withColumns({"lo": hn.F.lit(0.3 * 25600.0**2), "hi": hn.F.lit(hn.FAR)})
    ends = groups.groupBy("g").agg(*[hn.F.first(c) for c in ("cell", "kind")], *[hn.F.max(c) for c in ("away", "n2")], hn.F.min("n2"), hn.F.min("lo"), hn.F.max("hi")).toPandas()
    sent = hn._route(near, space, ends, 1, False, False).count() + hn._route(near, space, ends, 1, False, True).count()
    assert sent < 0.5 * len(rows) * len(ends)


def test_wide_components_are_exact(spark):
    r = random.Random(6)
    rows = [(i, [r.uniform(-60000, 60000) for _ in range(40)], i % 2, "", "", 0, 0.0) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(10, [1.0], 1, "", "", 0, 0.0), (20, [1.0], 1, "", "", 0, 0.0)]) == []
