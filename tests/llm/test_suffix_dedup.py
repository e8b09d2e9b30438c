import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from boxframe.llm import suffix_dedup

from .helpers import docs, empty, prose, rows, table


def brute(data, least=400):
    texts = [(t or "").encode() for _, t in data]
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = Counter()
    for (doc_id, _), t in zip(data, texts, strict=True):
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                cover[i] += 1
                cover[i + least] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[doc_id, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_intervals_against_counting():
    r = random.Random(3)
    for _ in range(80):
        least, letters = r.choice([1, 2, 3, 5, 9]), r.choice([b"a", b"ab", b"abcdefgh", b"\x00\xff"])
        texts = [bytes(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(r.randint(1, 9))]
        count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
        assert [m.tolist() for m in suffix_dedup.repeated_starts(texts, least)] == [[count[t[i : i + least]] > 1 for i in range(len(t) - least + 1)] for t in texts]


@pytest.mark.parametrize("hot", [8192, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    data = [(d[0], d[1]) for d in rows(5)]
    data += [(900, "x" * 399), (901, "y" * 400), (902, "z" * 401), (903, "ab" * 700), (904, "é" * 300 + data[50][1][200:1200]), (905, data[50][1][700:1900] + "tail")]
    got = suffix_dedup.digest(suffix_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string")))
    assert table(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(data)


def test_pieces_do_not_change_rows(monkeypatch):
    r = random.Random(7)
    text = np.array([r.choice(b"abc") for _ in range(6000)], np.uint8)
    key, lo, n = suffix_dedup.anchor_rows(text)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    cut = suffix_dedup.anchor_rows(text)
    at = lambda rows: np.repeat(rows[0], rows[2]).tolist()
    assert at((key, lo, n)) == at(cut) and n.sum() == cut[2].sum() == len(text) - 399


def test_passages_of_many_words_are_judged_by_bytes(spark):
    """Over 50 words in two documents go from 400 bytes on and stay below; that is told by n_removed, n_bytes is the text's length."""
    r = random.Random(9)
    passage = lambda tail: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(57)) + tail
    short, long = passage("x"), passage("xy")
    assert (len(short), len(long)) == (399, 400)
    data = [(i, f"{prose(r, 60)}{2 * i}{p}{2 * i + 1}{prose(r, 60)}") for i, p in enumerate([short, short, long, long, ""])]
    got = suffix_dedup.digest(suffix_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string")))
    assert table(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(data)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in got.collect()} == {i: (len(t.encode()), 400 * (i in (2, 3)), int(i in (2, 3))) for i, t in data}


def test_empty_table(spark):
    assert suffix_dedup.dedup(empty(spark)).count() == 0
    assert suffix_dedup.dedup(docs(spark)).count() == len(rows())
