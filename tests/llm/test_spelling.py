import random
import re
import zlib
from collections import Counter

import pytest

from boxframe.llm import spelling

from .helpers import LOWER, docs, empty, rows, table


def words(data, min_length=5, min_count=3):
    n = Counter()
    for doc_id, text, *_ in data:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_whole_texts_against_brute_force(spark):
    data = rows()
    # Misspelt copies of one text, so that forms and their chains exist.
    data = [*data, *[(50 + i, "erthonen ertonen erthonin eerthonen été-étéaa étéab ertthonen " * 2 ** (i % 5), "en", "a", 1, "s", None, "w") for i in range(30)], *data[:9]]
    df = spark.createDataFrame(data, docs(spark).schema)
    want = grouped(words(data))
    assert sum(x[4] > 0 for x in want) > 20 and any(x[1] != x[2] for x in want if x[1])
    assert table(spelling.group(df), *COLUMNS) == want


@pytest.mark.parametrize("letters", ["ab", "abcé", "aÿ"])
def test_no_near_word_is_lost(spark, letters):
    """Short alphabets repeat bigrams within a word, at its ends and across every place of an edit."""
    r = random.Random(len(letters))
    n = {"".join(r.choice(letters) for _ in range(r.randint(5, 9))): 0 for _ in range(300)}
    for w in list(n)[:100]:
        i = r.randrange(len(w))
        for v in (w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :], w + w[-1], w[0] + w):
            if len(v) >= 5:
                n[v] = 0
    n = {w: r.randint(3, 40) for w in n}
    n |= {"a" * 3_000: 9, "a" * 3_001: 30}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert table(got, *COLUMNS) == grouped(n)


def test_long_chains_reach_their_root(spark):
    letters = "bcdfghjklmnpq"
    n = {"aaaaa" + "a" * i + letters[:i]: 3 * 2**i for i in range(len(letters))}
    chain = ["a" * 30]
    for i in range(25):
        chain.append(chain[-1][:i] + "z" + chain[-1][i + 1 :])
    n |= {w: 3 * 2**i for i, w in enumerate(chain)}
    got = table(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")), *COLUMNS)
    assert got == grouped(n) and any(x[0] == chain[0] and x[2] == chain[-1] for x in got)


def test_empty_table(spark):
    assert spelling.group(empty(spark)).count() == 0
    assert spelling.group(spark.createDataFrame([(1, None), (2, ""), (3, "no word here"), (None, "abcde abcde abcde")], "doc_id long, text string")).count() == 1
