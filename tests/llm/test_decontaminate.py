import hashlib
from collections import Counter, defaultdict

import pytest

from boxframe.llm import decontaminate

from .helpers import docs, empty, rows, table, text_words


def brute(data, items):
    wins = defaultdict(set)
    for item, text in items:
        w = text_words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(item)
    out = Counter()
    for d in data:
        w, hit, its = text_words(d[1]), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (q := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    its |= q
        ids = ",".join(sorted(str(x) for x in its if x is not None))
        out[d[0], len(w), len(hit), len([x for x in its if x is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("bound", [decontaminate.MAX_BROADCAST_SHINGLES, 0])
def test_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_SHINGLES", bound)
    data = rows()
    w = text_words(data[-6][1] or "") or text_words(data[10][1])
    items = [(1, data[0][1]), (2, " ".join(w[3:16])), (3, "two words"), (10, "word"), (4, None), (5, "  "), (2, "two words"), (None, data[1][1]), (7, "not there at all " * 4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(docs(spark), bench))
    assert table(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute(data, items)


def test_removal_keeps_clean_rows_and_columns(spark):
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    out = decontaminate.remove(docs(spark), bench)
    assert out.columns == docs(spark).columns
    assert out.count() == len(rows()) - sum("two words" in " ".join(text_words(d[1])) for d in rows())


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.contamination(docs(spark), bench)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0
