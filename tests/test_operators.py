"""Properties of the operators: order of input, split of the corpus and copies of documents do not matter."""

import random
from collections import Counter

import pytest

from boxframe.operators import evaluate, evidence, geometry, hypotheses, scoring, sequential
from boxframe.plans.store import stored
from boxframe.schema import BOX, CELL_KEY
from boxframe.sinks import artifact
from boxframe.streaming import boxes as streams


def box(doc, i, x, y, text, weight="normal", size=10.0, page=0):
    return (doc, page, i, float(x), float(y), float(6 * len(text)), 10.0, text, 0 if weight == "normal" else 1, weight, size, "F", "rgba(0,0,0,255)")


def report(doc):
    out = [box(doc, 0, 0, 0, "Title", "bold", 16.0), box(doc, 1, 0, 20, "Sales", "bold")]
    for r in range(4):
        out += [box(doc, 10 * r + 10, 0, 40 + 20 * r, f"row{r}"), box(doc, 10 * r + 11, 120, 40 + 20 * r, "$1,2"), box(doc, 10 * r + 12, 144, 40 + 20 * r, ","), box(doc, 10 * r + 13, 150, 40 + 20 * r, "00"), box(doc, 10 * r + 14, 300, 40 + 20 * r, "2024-01-15")]
    return out


@pytest.fixture(scope="module")
def boxes(spark):
    return spark.createDataFrame(report(1) + report(2), BOX)


def pipeline(b):
    w = stored(evidence.wide(stored(geometry.document_cells(b), "cells")), "wide")
    return stored(hypotheses.resolve(stored(hypotheses.generate(w), "hypotheses"), w), "roles")


def test_cells_glue_punctuation(boxes):
    got = [x.text for x in geometry.document_cells(boxes).where("doc_id = 1").orderBy(*CELL_KEY).collect()]
    assert got[:5] == ["Title", "Sales", "row0", "$1,2,00", "2024-01-15"]


def test_order_split_and_copies_do_not_matter(spark, boxes):
    whole = Counter(map(tuple, pipeline(boxes.where("doc_id = 1")).drop("doc_id").collect()))
    both = pipeline(boxes.orderBy("text").repartition(5)).collect()
    assert {d: Counter(tuple(x)[1:] for x in both if x.doc_id == d) for d in (1, 2)} == {1: whole, 2: whole}


def test_over_tall_rows_are_cut(spark):
    b = spark.createDataFrame([box(1, i, 0, 6 * i, f"w{i}") for i in range(8)], BOX)
    got = sorted(x.row_cluster for x in geometry.row_clusters(b).collect())
    assert len(set(got)) > 1 and min(got) >= 1000


def test_empty_and_null(spark):
    none = spark.createDataFrame([], BOX)
    assert pipeline(none).count() == 0
    f = stored(scoring.features(stored(evidence.typed(geometry.document_cells(none)), "typed")), "features")
    assert scoring.assign(f, stored(scoring.role_scores(f), "scores")).count() == 0


def test_scores_prefer_labels_on_the_left(boxes):
    f = stored(scoring.features(stored(evidence.typed(geometry.document_cells(boxes)), "typed")), "features")
    roles = {x.text: x.role for x in scoring.assign(f, stored(scoring.role_scores(f), "scores")).where("doc_id = 1").collect()}
    assert roles["row0"] == "row_label" and roles["$1,2,00"] == "measure" and roles["2024-01-15"] == "date" and roles["Sales"] in ("section_label", "prose")


def test_spearman(spark):
    df = spark.createDataFrame([("a", i, i * i) for i in range(6)] + [("b", i, -i) for i in range(6)] + [("c", 1, 1), ("c", 1, 1)], "k string, x int, y int")
    assert {r.k: r.rho for r in evaluate.spearman(df, ["k"], "x", "y").collect()} == {"a": 1.0, "b": -1.0, "c": None}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:{i % 60:02d}:00", i % 3, "t", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streams.tumbling_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert Counter(map(tuple, spark.table("counts").collect())) == Counter(map(tuple, streams.tumbling_counts(df).collect()))


def test_ingest_and_latest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny")
    (tmp_path / "in" / "b.html").write_text("<html><body><p>z</p></body></html>")
    q = streams.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sorted(x.text for x in artifact.scan(spark, str(tmp_path / "out")).collect()) == ["x", "y", "z"]
    (tmp_path / "in" / "c.txt").write_text("x\ny")  # the content is there already
    streams.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert artifact.scan(spark, str(tmp_path / "out")).count() == 3
    feed = spark.createDataFrame([("u", "p", 1.0, 1.0, "old", "added", 1.0), ("u", "p", 1.0, 1.0, "new", "changed", 2.0)], "url string, tag string, x double, y double, text string, mutation_type string, t_ms double")
    assert [x.text for x in streams.latest(feed).collect()] == ["new"]


def test_artifacts_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"a\nb")), (2, bytearray(b"a\nb")), (3, bytearray(b"c"))], "doc_id long, content binary")
    assert artifact.write(df, str(tmp_path / "art")) == 2
    assert artifact.write(df, str(tmp_path / "art")) == 0
    assert artifact.scan(spark, str(tmp_path / "art")).count() == 3


def test_merged_fragments_use_the_height_of_the_cells_first(spark):
    b = [(1, 0, 1, 1, 0.0, 10.0, 10.0, "$12"), (1, 0, 1, 2, 12.0, 5.0, 2.0, ",400"), (1, 0, 1, 3, 24.0, 5.0, 2.0, "up"), (1, 0, 1, 4, 37.0, 1.0, 2.0, "x"), (1, 0, 1, 5, 40.0, 1.0, 2.0, "y"), (1, 0, 2, 6, 0.0, 1.0, 1.0, "z"), (1, 0, 1, 7, 43.9, 1.0, 10.0, "w")]
    df = spark.createDataFrame(b, "doc_id long, page_id int, row_cluster long, ord long, x double, w double, h double, text string")
    got = [(r.row_cluster, r.cell_id, r.x, round(r.w, 6), r.text) for r in sequential.merged_fragments(df).orderBy("row_cluster", "cell_id").collect()]
    assert got == [(1, 1, 0.0, 29.0, "$12,400 up"), (1, 2, 37.0, 7.9, "x y w"), (2, 1, 0.0, 1.0, "z")]
    assert sequential.merged_fragments(df.limit(0)).count() == 0


def test_column_clusters_measure_from_the_first_member(spark):
    xs = [0.0, 2.0, 4.0, 20.0, 30.0, 40.0, 50.0, None]  # gaps 2 2 16 10 10 10: tolerance 3
    df = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(xs)] + [(2, 0, 9, 7.0), (2, 0, 10, 7.0)], "doc_id long, page_id int, ord int, x double")
    got = {r.ord: r.col_cluster for r in sequential.column_clusters(df).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: None, 9: 1, 10: 1}


def test_centroid_rows_carry_the_mean_from_batch_to_batch(spark):
    r = random.Random(3)
    rows = [(d, p, i, float(r.randrange(50)), round(r.random() * 90, 2), 10.0) for d in (1, 2) for p in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, page_id int, ord long, x double, y double, h double")
    want = {}
    for key in {x[:2] for x in rows}:
        row, centre, n = 0, None, 0
        for m, _, i in sorted((x[4] + x[5] / 2, x[3], x[2]) for x in rows if x[:2] == key):
            row, centre, n = (row + 1, m, 1) if centre is None or abs(m - centre) > 6 else (row, centre + (m - centre) / (n + 1), n + 1)
            want[(*key, i)] = row
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = sequential.centroid_rows(df)
        assert {tuple(x)[:3]: x.row_cluster for x in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "GroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
