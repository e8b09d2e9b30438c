import random
from collections import Counter

import corpus_pipeline
from boxframe.llm import shingle_dedup, simhash
from boxframe.llm.common import stored

from .helpers import LOWER, docs, empty, rows, space_words


def shingles(t):
    w = space_words((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}


def groups(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def edited(r, words, n):
    """words with n of them replaced, and the similarity that is left."""
    out = list(words)
    for i in r.sample(range(len(words)), n):
        out[i] = f"new{r.randrange(10**9)}"
    a, b = shingles(" ".join(words)), shingles(" ".join(out))
    return " ".join(out), len(a & b) / len(a | b)


def planted(seed=5):
    """(doc_id, text): originals, copies of similarity 0.8 to 0.95 and below, a dense group, and a passage that many texts share."""
    r = random.Random(seed)
    new = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts, near = [], []
    for _ in range(60):
        words = new(200)
        texts.append(" ".join(words))
        for n in (1, 2, 3, 4, 5, 8):
            t, sim = edited(r, words, n)
            near.append((len(texts) - 1, len(texts), sim)) if sim < 0.96 else None
            texts.append(t)
    base, passage = new(300), new(60)
    texts += [edited(r, base, r.randint(0, 6))[0] for _ in range(80)]
    texts += [" ".join(passage + new(r.choice([5, 40, 200]))) for _ in range(80)]
    return texts, near


def check(spark, texts, monkeypatch=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted((x.group, x.doc_id) for x in shingle_dedup.classes(df).collect())
    least = {}
    for g, i in got:
        least.setdefault(g, i)
    assert {i: least[g] for g, i in got} == dict(enumerate(groups(texts)))
    return df


def test_planted_near_copies_against_brute_force(spark, monkeypatch):
    texts, near = planted()
    assert {int(s * 100) // 5 for *_, s in near} >= {16, 17, 18}
    df = check(spark, texts)
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(groups(texts))
    monkeypatch.setattr(shingle_dedup, "SAMPLE", 1)
    monkeypatch.setattr(shingle_dedup, "BROADCAST", 0)
    check(spark, texts)


def test_odd_rows(spark):
    kept = shingle_dedup.representatives(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == len(set(groups([x[1] for x in rows()])))
    assert max(Counter(x.doc_id for x in kept.collect()).values()) <= 2
    assert shingle_dedup.representatives(empty(spark)).count() == 0


def test_rounds_before_the_full_comparison_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingle_dedup, "WIDE", (0, 1, 0))
    monkeypatch.setattr(shingle_dedup, "HUBS", (1, 2, 5))
    check(spark, planted(7)[0])


def test_fingerprints_are_searched_first(spark, monkeypatch):
    """Vantage-point shards of fingerprints propose pairs of points; what they propose wrongly is no link, what they miss is found."""
    r = random.Random(9)
    long = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    df = spark.createDataFrame([(k, edited(r, long, k)[0]) for k in range(4)] + [(9, "no copy of them at all")], "doc_id long, text string")
    rows = shingle_dedup.prefixes(df).collect()
    bits = lambda x, y: ((x.fp ^ y.fp) & (2**64 - 1)).bit_count()
    near = simhash.components(shingle_dedup.near_fingerprints(stored(shingle_dedup.prefixes(df), "p"))).collect()
    want = {x.sid for x in rows for y in rows if x is not y and bits(x, y) <= 2}
    assert want and {x.node for x in near} == want and next(x.sid for x in rows if x.doc_id == 9) not in want

    texts, searched, link = planted(11)[0], [], simhash.link
    monkeypatch.setattr(simhash, "link", lambda d: searched.append(d.count()) or link(d))
    check(spark, texts)
    monkeypatch.setattr(simhash, "RADIUS", 64)
    check(spark, texts)
    assert len(searched) == 2 and searched[0] == searched[1] > 300


def test_few_leaving_documents_move_no_texts(spark, monkeypatch):
    """A broadcast tells the documents that leave, whatever Spark thinks of its size; too many are told by a join, with the same result."""
    found = stored(shingle_dedup.classes(docs(spark)), "found")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = simhash.representatives(docs(spark), found)
        plan = few._jdf.queryExecution().executedPlan().toString()
        few = sorted(map(str, few.collect()))
        monkeypatch.setattr(simhash, "LEAVING", 0)
        many = simhash.representatives(docs(spark), found)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" not in plan
        assert few == sorted(map(str, many.collect())) and 0 < len(few) < docs(spark).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
