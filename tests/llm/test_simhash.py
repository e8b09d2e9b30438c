import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from boxframe.llm import simhash

from .helpers import LOWER, docs, empty, rows, space_words, table


def fingerprint(t):
    w = space_words((t or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(points):
    up = list(range(len(points)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= 2:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(points))]


@pytest.mark.parametrize(("points", "visitors"), [(8192, 65536), (4, 3)])
def test_against_brute_force(spark, monkeypatch, points, visitors):
    monkeypatch.setattr(simhash, "SHARD_POINTS", points)
    monkeypatch.setattr(simhash, "VISITORS", visitors)
    data = rows()
    fp = [fingerprint(d[1]) for d in data]
    g = groups(fp)
    least = {}
    for d, k in zip(data, g, strict=True):
        if d[0] is not None:
            least[k] = min(least.get(k, d[0]), d[0])
    got = simhash.digest(simhash.classes(docs(spark)))
    assert table(got, "doc_id", "fingerprint", "component_id") == Counter((d[0], f"{f:016x}", least.get(k)) for d, f, k in zip(data, fp, g, strict=True))
    kept = simhash.representatives(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == len(set(g))


@pytest.mark.parametrize("shards", [16, 512])
def test_trees_lose_no_link(shards):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(400)]
    points = base + [b ^ (1 << r.randrange(64)) for b in base[:200]] + [base[0] ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    a = np.unique(np.array(points, np.uint64))
    tree = simhash.build(a[::3], shards)
    idx, shard, home = simhash.route(tree, a)
    assert sorted(idx[home]) == list(range(len(a)))
    found = []
    for s in set(shard.tolist()):
        own, asks = idx[(shard == s) & home], idx[(shard == s) & ~home]
        at = np.concatenate([own, asks])
        found += [(at[x], at[y]) for x, y in simhash.links(a[at], len(own))]
    up = simhash._Forest(len(a))
    for x, y in found:
        assert (int(a[x]) ^ int(a[y])).bit_count() <= 2
        up.join(int(x), int(y))
    assert [up.root(i) for i in range(len(a))] == groups([int(x) for x in a])


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {x.node: x.root for x in simhash.components(edges).collect()}
    assert set(got) == {*range(61), 100, 101, 102} and all(v == (0 if k < 61 else 100) for k, v in got.items())


def test_empty_table(spark):
    assert simhash.classes(empty(spark)).count() == 0
    assert simhash.representatives(empty(spark)).count() == 0
