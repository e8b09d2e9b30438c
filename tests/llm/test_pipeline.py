"""The pipeline's stages, each on its own input, against brute-force versions; then run()."""

import duckdb
import pytest

import corpus_pipeline as cp
from boxframe.llm import oracles
from boxframe.llm.common import stored

from . import test_decontaminate, test_mixing, test_shingle_dedup, test_simhash
from .helpers import docs, empty, prose, rows, text_words


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    import random

    r = random.Random(11)
    path = tmp_path_factory.mktemp("sf")
    data = [x for x in rows() if x[0] is not None and x[1] != "same id, other text"]
    data = list(dict.fromkeys(data)) + [(1000 + i, prose(r, 90) + ("\nshared one\nshared two\nshared three" if i % 3 == 0 else ""), "en", "a", 1, None, None, None) for i in range(30)]
    data += [(2000 + i, data[40 + i][1], "en", "b", 1, None, None, None) for i in range(3)]
    # Near copies on either side of the similarity, which fingerprints of three-word shingles tell otherwise.
    words = prose(r, 160).split()
    data += [(2100 + n, " ".join(words), "en", "b", 1, None, None, None) for n in (0,)] + [(2100 + n, test_shingle_dedup.edited(r, words, n)[0], "en", "b", 1, None, None, None) for n in (1, 2, 3, 4, 5, 7, 9)]
    spark.createDataFrame(data, docs(spark).schema).write.parquet(f"{path}/documents.parquet")
    item = " ".join(text_words(data[-13][1])[4:20])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), [(1, item)]


def test_stages_against_brute_force(spark, folder):
    path, items = folder
    d = spark.read.parquet(f"{path}/documents.parquet")
    whole = [tuple(x) for x in d.collect()]

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    kept = {x[0] for x in con.sql(f"select doc_id from ({oracles.OP6}) where kept").fetchall()}
    d = stored(cp.quality(spark, d, path), "q")
    a = {x.doc_id: x for x in d.collect()}
    assert set(a) == kept and {tuple(x) for x in a.values()} <= set(whole) and 0 < len(a) < len(whole)

    seen, expected = set(), {}
    for i in sorted(a):
        lines, cover = a[i].text.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            cover |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        left = "\n".join(x for k, x in enumerate(lines) if k not in cover)
        if not cover or left.split():
            expected[i] = left
    d = stored(cp.lines(spark, d, path), "l")
    b = {x.doc_id: x for x in d.collect()}
    assert {i: x.text for i, x in b.items()} == expected and all(x.n_chars == len(x.text) for x in b.values()) and len(b) < len(a)

    order = sorted(b)
    group = test_shingle_dedup.groups([b[i].text for i in order])
    assert group != test_simhash.groups([test_simhash.fingerprint(b[i].text) for i in order])
    d = stored(cp.near_duplicates(spark, d, path), "s")
    c = {x.doc_id: x for x in d.collect()}
    assert set(c) == {order[g] for g in group} and all(c[i] == b[i] for i in c)

    bad = {k[0] for k in test_decontaminate.brute([tuple(x) for x in c.values()], items) if k[-1]}
    d = stored(cp.benchmarks(spark, d, path), "b")
    e = {x.doc_id: x for x in d.collect()}
    assert bad and set(e) == set(c) - bad

    out = cp.mixture(spark, d, path)
    assert set(d.columns) - set(cp.ADDED) < set(out.columns)
    taken = {x.doc_id: x.taken for x in out.collect()}
    full = cp.mixing.mix(d).collect()
    test_mixing.check([(x.doc_id, x.text, x.lang, x.source) for x in e.values()], full)
    assert taken == {x.doc_id: x.taken for x in full if x.taken > 0}
    assert {x.doc_id: x.taken for x in cp.run(spark, path).collect()} == taken


def test_stages_accept_odd_and_empty_tables(spark, folder):
    for start in (docs(spark), empty(spark)):
        d = start
        for k, (_, stage) in enumerate(cp.STAGES):
            d = stored(stage(spark, d, folder[0]), "x")
            if k < len(cp.STAGES) - 1:
                assert d.columns == start.columns
