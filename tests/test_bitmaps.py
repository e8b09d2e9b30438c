import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from boxframe.operators import bitmaps, evaluate
from boxframe.plans import ranks


def test_sets_of_integers(spark):
    r = random.Random(1)
    sets = {k: {r.choice([0, 1, 7, 8, 32_766, 32_767, 32_768, 70_000, r.randrange(200_000)]) for _ in range(n)} for k, n in enumerate((1, 3, 40, 400))}
    rows = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs] * 2, "k long, v long")
    built = bitmaps.build(rows, ["k"], "v").cache()
    assert {(x.k, x.n) for x in bitmaps.cardinality(built, ["k"]).collect()} == {(k, len(v)) for k, v in sets.items()}
    back = defaultdict(set)
    for x in built.select("k", F.explode(bitmaps.values(F.col("bits"), F.col("bucket"))).alias("v")).collect():
        back[x.k].add(x.v)
    assert back == sets
    assert max(len(x.bits) for x in built.where("k = 0").collect()) <= bitmaps.BYTES
    held = rows.select("v").distinct().join(built.where("k = 2")).where(F.bitmap_bucket_number(F.col("v") + 1) == F.col("bucket"))
    assert {x.v for x in held.where(bitmaps.contains(F.col("bits"), F.col("v"))).collect()} == sets[2]
    a, b = built.withColumnRenamed("k", "a"), built.withColumnRenamed("k", "b")
    got = {(x.a, x.b): x.n for x in bitmaps.intersections(a, b, ["a"], ["b"], F.col("a") < F.col("b")).collect()}
    assert got == {(i, j): n for i in sets for j in sets if i < j and (n := len(sets[i] & sets[j]))}
    union = bitmaps.union(built, []).select(F.explode(bitmaps.values(F.col("bits"), F.col("bucket"))).alias("v"))
    assert sorted(x.v for x in union.collect()) == sorted(set().union(*sets.values()))


def test_small_sets_stay_small(spark):
    x = bitmaps.build(spark.createDataFrame([(1, 0), (1, 9), (1, 300)], "k long, v int"), ["k"], "v").first()
    assert bytes(x.bits).hex() == "0102" + "00" * 35 + "10"


def test_ranges_number_and_rank_without_one_task(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(6), r.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, v long, w long").repartition(3)
    got = {x.i: x.n for x in ranks.numbered(df, ["v", "i"], "n", 5).collect()}
    assert got == {x[1]: 5 + n for n, x in enumerate(sorted(rows, key=lambda x: (x[2], x[1])))}
    by = defaultdict(list)
    for x in rows:
        by[x[0]].append(x)
    want = {}
    for g in by.values():
        g.sort(key=lambda x: x[1])
        want |= {x[1]: p[3] if p else None for p, x in zip([None, *g], g, strict=False)}
    assert {x.i: x.p for x in ranks.lagged(df, ["g"], ["i"], "w", "p").collect()} == want
    ranked = {x.i: x.r for x in evaluate.average_ranks(df, ["g"], "v", "r").collect()}
    for g in by.values():
        values = sorted(x[2] for x in g)
        for x in g:
            places = [k + 1 for k, v in enumerate(values) if v == x[2]]
            assert ranked[x[1]] == sum(places) / len(places)


def pairs_brute(a, b, guarded=True):
    return {(x, y) for x in a for y in b if x and y and (x in y or y in x) and (not guarded or x == y or min(len(x), len(y)) >= 3 or min(len(x), len(y)) / max(len(x), len(y)) > 0.5)}


def test_containments_lose_no_pair(spark):
    r = random.Random(3)
    a = ["".join(r.choice("ab1") for _ in range(r.randint(1, 6))) for _ in range(80)]
    b = ["".join(r.choice("ab1") for _ in range(r.randint(1, 9))) for _ in range(80)]
    da, db = spark.createDataFrame([(1, x) for x in a], "g int, a string"), spark.createDataFrame([(1, x) for x in b] + [(2, a[0])], "g int, b string")
    for guarded in (True, False):
        got = {(x.a, x.b) for x in evaluate.containments(da, db, ["g"], guarded).collect()}
        assert got == pairs_brute(a, b, guarded)


def test_fuzzy_recall_counts_numbers_and_types(spark):
    truth = spark.createDataFrame([(1, "Net  Sales", False), (1, "1,171", True), (1, "25", True), (1, "—", True), (1, " ", True), (2, "absent", False)], "d int, text string, numeric boolean")
    found = spark.createDataFrame([(1, 1, "net sales (in millions)", None), (1, 2, "$1171", "currency"), (1, 3, "2,251", "measure"), (2, 1, "", None)], "d int, o int, text string, type string")
    got = {x.d: x for x in evaluate.fuzzy_recall(truth, found, ["d"], ["o"]).collect()}
    assert (got[1].truth, got[1].matched, got[1].numbers, got[1].numbers_typed) == (4, 2, 3, 1) and got[2].recall == 0


def test_layouts_by_counting_equal_layouts_by_pairs(spark):
    r = random.Random(4)
    rows = [(g, r.randrange(4), r.randrange(4), r.uniform(0, 40), r.uniform(0, 60), r.choice([0.0, 5.0, 12.0])) for g in (1, 2) for _ in range(60)]
    rows += [(3, 0, 0, 1.0, 1.0, 1.0)]
    want = {}
    for g in (1, 2, 3):
        c = Counter(rows_ok=0, rows_all=0, columns_ok=0, columns_all=0)
        own = [x for x in rows if x[0] == g]
        for i, a in enumerate(own):
            for b in own[:i]:
                if a[2] == b[2]:
                    c["rows_all"] += 1
                    c["rows_ok"] += min(a[4] + a[5], b[4] + b[5]) - max(a[4], b[4]) > 0
                elif a[1] == b[1]:
                    c["columns_all"] += 1
                    c["columns_ok"] += abs(a[3] - b[3]) <= 12
        want[g] = dict(c)
    df = spark.createDataFrame(rows, "d int, gx int, gy int, x double, y double, h double")
    assert {x.d: {k: x[k] for k in want[1]} for x in evaluate.layout_agreement(df, ["d"]).collect()} == want
