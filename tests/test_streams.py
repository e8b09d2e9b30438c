import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from boxframe.sinks import artifact
from boxframe.streaming import boxes, feed, latest
from boxframe.streaming.replay import appended

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def batches(records, size, ms):
    """What the feed is to send, by a loop over each source's records."""
    out = []
    for source in {x[0] for x in records}:
        done, open_ = 0, []
        for t, i in sorted((x[2], x[1]) for x in records if x[0] == source):
            if open_ and t - open_[0][0] >= timedelta(milliseconds=ms):
                out.append((source, done, "time", [k for _, k in open_]))
                done, open_ = done + 1, []
            open_.append((t, i))
            if len(open_) == size:
                out.append((source, done, "size", [k for _, k in open_]))
                done, open_ = done + 1, []
        if open_:
            out.append((source, done, "time", [k for _, k in open_]))
    return sorted(out)


def test_feed_flushes_by_size_or_time(spark):
    r = random.Random(5)
    records, t = [], 0
    for i in range(150):
        t += r.choice([1, 1, 2, 5, 30, 50, 100, 200, 600])
        records.append((i % 3, i, START + timedelta(milliseconds=t), min(2, i // 50)))
    # Some arrive a run late, out of order, but within the watermark.
    records = [(*x[:3], min(2, x[3] + (x[1] % 7 == 0))) for x in records]
    df = spark.createDataFrame(records, "source long, id long, ts timestamp, slice int")
    got = appended(df, F.col("slice"), 3, lambda s: feed.flushed(s, "1 hour", 3, 200), "ts").where("source is not null").collect()
    want = batches(records, 3, 200)
    assert {x[2] for x in want} == {"size", "time"}
    assert sorted((x.source, x.batch, x.reason, list(x.ids)) for x in got) == want
    assert all(x.n == len(x.ids) for x in got)


def state(spark, folder):
    return Counter(tuple(x) for x in latest.current(spark, folder).select("k", "t", "v").collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", "c", None]), i, str(r.random())) for i in range(60)]
    r.shuffle(rows)
    df = [spark.createDataFrame(rows[k::3], "k string, t long, v string") for k in range(3)]
    folder = str(tmp_path / "state")
    assert latest.current(spark, folder) is None
    for n in (0, 1, 2):
        latest.merge(df[n], n, folder, ["k"], ["t"], buckets=2)
        before = state(spark, folder)
        latest.merge(df[n], n, folder, ["k"], ["t"], buckets=2)
        assert state(spark, folder) == before
    want = {k: max((x for x in rows if x[0] == k), key=lambda x: x[1]) for k in {x[0] for x in rows}}
    assert state(spark, folder) == Counter(want.values())
    # A batch that was killed while it wrote has no mark and is not there.
    (tmp_path / "state/bf_version=3/bf_bucket=0").mkdir(parents=True)
    (tmp_path / "state/bf_version=3/bf_bucket=0/part-0.parquet").write_bytes(b"half")
    assert state(spark, folder) == Counter(want.values())
    latest.merge(df[0], 3, folder, ["k"], ["t"], buckets=2)
    assert state(spark, folder) == Counter(want.values())


def contents(spark, *data):
    return spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(data)], "doc_id long, content binary")


def test_artifacts_have_a_status_and_no_halves(spark, tmp_path):
    folder = str(tmp_path / "art")
    first = contents(spark, b"a\nb", b"a\nb", b"\n\n", b"%PDF-1.4 no reader", None)
    assert artifact.commit(first, folder, 0) == {"write": 1, "metadata-only": 1, "rejected": 2, "dedup": 1}
    assert artifact.commit(first, folder, 0) == {"write": 1, "metadata-only": 1, "rejected": 2, "dedup": 1}  # a replay
    assert artifact.scan(spark, folder).count() == 2 and artifact.headers(spark, folder).count() == 3
    assert artifact.commit(contents(spark, b"a\nb", b"c", b"%PDF-1.4 no reader"), folder, 1) == {"write": 1, "metadata-only": 0, "rejected": 0, "dedup": 2}
    # Boxes without headers are those of a killed write.
    boxes = spark.read.parquet(f"{folder}/boxes/batch=1")
    boxes.write.partitionBy("band").parquet(f"{folder}/boxes/batch=2")
    assert artifact.batches(spark, folder) == [0, 1] and artifact.scan(spark, folder).count() == 3
    assert artifact.commit(contents(spark, b"d\ne"), folder, 2)["write"] == 1 and artifact.scan(spark, folder).count() == 5


def test_page_ranges_skip_files(spark, tmp_path):
    doc = "struct<document_id:int,source_type:string,filename:string,checksum:string,page_count:int>"
    box = F.struct(F.col("p").cast("int").alias("page_id"), F.lit(0).alias("style_id"), *[F.lit(1.0).alias(c) for c in "xywh"], F.lit("string").alias("cell_type"), F.lit(None).cast("double").alias("vnum"), F.lit(None).cast("boolean").alias("vbool"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("formula"))

    def parse(df):
        pages = df.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("p")).groupBy("doc_id").agg(F.collect_list(box).alias("bboxes"))
        return pages.withColumn("doc", F.from_json(F.lit("{}"), doc))

    folder = str(tmp_path / "art")
    artifact.commit(contents(spark, b"a", b"b"), folder, 0, parse=parse)
    every, some = artifact.scan(spark, folder), artifact.scan(spark, folder, 20, 40)
    assert every.count() == 200 and sorted({x.page_id for x in some.collect()}) == list(range(20, 41))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "band" in plan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(page_id,20)" in plan
    read = some.select(F.input_file_name().alias("f")).distinct().count()
    assert read < every.select(F.input_file_name().alias("f")).distinct().count()


def test_late_events_join_sessions_that_ended_before_them(spark):
    at = lambda m: START + timedelta(minutes=m)
    # The watermark stands at 190: what lies at 160 or before is late, and a session that ends at 189 can still go on.
    rows = [(1, 150, 0), (1, 159, 0), (1, 200, 0), (2, 100, 0), (1, 161, 1), (1, 161, 1), (1, 160, 1), (2, 120, 1), (3, 165, 1)]
    df = spark.createDataFrame([(u, at(m), k) for u, m, k in rows], "user_id long, ts timestamp, slice int")
    got = appended(df, F.col("slice"), 2, boxes.sessions, "ts").where("user_id is not null")
    minute = lambda c: ((F.unix_timestamp(c) - int(START.timestamp())) / 60).cast("int")
    found = sorted(tuple(x) for x in got.select("user_id", minute("session_start"), minute("session_end"), "n").collect())
    assert found == [(1, 150, 191, 4), (1, 200, 230, 1), (2, 100, 130, 1), (3, 165, 195, 1)]
