from collections import Counter

import pytest

from boxframe.llm import line_dedup

from .helpers import docs, empty, rows, table


@pytest.mark.parametrize(("bound", "hot"), [(200_000, 10_000), (1, 2), (1, 10_000), (-1, 2)])
def test_against_brute_force(spark, monkeypatch, bound, hot):
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_WINDOWS", bound)
    monkeypatch.setattr(line_dedup, "HOT_WINDOW", hot)
    """Distinct (doc_id, text) pairs; where doc_ids are distinct the order is by doc_id alone."""
    data = [d for d in rows() if d[0] is not None and d[1] != "same id, other text"]
    seen, out = set(), {}
    for d in sorted({(d[0], d[1]) for d in data}, key=lambda x: x[0]):
        lines, cov = (d[1].split("\n") if d[1] is not None else []), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                cov |= {k, k + 1, k + 2}
            seen.add(w)
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in cov) if cov else d[1], len(lines), len(cov))
    expected = Counter((d[0], *out[d[0], d[1]]) for d in data)
    got = line_dedup.dedup(docs(spark).where("doc_id is not null and coalesce(text, '') != 'same id, other text'"))
    assert table(got, "doc_id", "text", "n_lines", "n_removed") == expected


def test_every_line_survives_and_nulls_pass(spark):
    before = {x for d in rows() if d[1] for x in d[1].split("\n")}
    out = line_dedup.dedup(docs(spark))
    assert out.count() == len(rows())
    assert before == {x for d in out.collect() if d.text for x in d.text.split("\n")} | ({""} & before)
    assert [tuple(x) for x in out.where("text is null").select("n_lines", "n_removed").collect()] == [(0, 0)]


def test_empty_table(spark):
    assert line_dedup.dedup(empty(spark)).count() == 0
