from collections import Counter

from pyspark.sql import functions as F

from boxframe.llm import quality_rules

from .helpers import docs, empty, rows, space_words


def brute(t):
    w, s = space_words(t), t or ""
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in s.split("\n") if space_words(x)]
    return len(w), sum(map(len, w)), sum(s.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_features_against_brute_force(spark):
    got = quality_rules.judge(docs(spark)).collect()
    assert Counter((x.doc_id, *(x[c] for c in quality_rules.FEATURES)) for x in got) == Counter((d[0], *brute(d[1])) for d in rows())
    for x in got:
        n, *_, rep = brute(x.text)
        assert x.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (x.base_failed and x.kept)
    assert not any(x.kept for x in got if x.text and x.text.startswith("##$"))


def test_symbols_beyond_the_fence_are_rejected_and_prose_is_kept(spark):
    plain = [(i, " ".join(f"word{i}x{k}" for k in range(60)), "en", "a") for i in range(80)]
    odd = [(1000, " ".join(f"w{k}###" for k in range(60)), "en", "a")]
    got = {x.doc_id: x.kept for x in quality_rules.judge(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(1000) and all(got.values())


def test_groups_judge_the_same_text_by_their_own_distribution(spark):
    """What is usual in a source of price lists is rejected in one of prose, below any fixed cutoff of old."""
    prose = [(i, " ".join(f"word{i}x{k}" for k in range(100)), "en", "prose") for i in range(80)]
    lists = [(100 + i, " ".join(f"word{i}x{k}" + "$" * (k % 20 < i % 4) for k in range(100)), "en", "lists") for i in range(80)]
    same = " ".join(f"word40x{k}" + "$" * (k % 20 < 2) for k in range(100))
    long_words = " ".join(f"{'x' * 12}{k}" for k in range(100))
    odd = [(1000, same, "en", "prose"), (1001, same, "en", "lists"), (1002, long_words, "en", "prose"), (1003, "\n".join(["the same line again"] * 40 + [f"line {i}" for i in range(3)]), "en", "prose")]
    got = {x.doc_id: x.kept for x in quality_rules.judge(spark.createDataFrame(prose + lists + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert [got.pop(i) for i in (1000, 1001, 1002, 1003)] == [False, True, False, False] and all(got.values())


def test_a_junk_source_cannot_raise_its_own_fence(spark):
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(100)), "en", "a") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{i}x{k}" + "#" * (k % 100 < i) for k in range(100)), "en", "b") for i in range(60)]
    got = {x.doc_id: x.kept for x in quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in range(1016, 1060))


def test_sketches_merge(spark):
    """Buckets are exact below 256 and within one part in 128 above."""
    df = spark.range(1, 100_000, 7).select("id", quality_rules.bucket(F.col("id")).alias("b"))
    for x in df.collect():
        assert x.b <= x.id and (x.b == x.id if x.id < 256 else x.id - x.b < x.id / 128)


def test_empty_table(spark):
    assert quality_rules.judge(empty(spark)).count() == 0
