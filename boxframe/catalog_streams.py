"""Registered queries that run as streams: tables arrive in slices, each in a run of its own from the last one's checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .catalog import query, table
from .catalog_io import events
from .sinks import artifact
from .sources import text
from .streaming import boxes as streams
from .streaming import feed, latest
from .streaming.replay import appended, new_folder, replay

#: Events that arrive after all others, in a slice of their own: far too late for most windows.
LATE = 37
_EDGES = "b as (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from events)"
_THIRD = "(epoch_us(ts) - lo) * 3 // (hi - lo + 1)"
_ARRIVED = f"""{_EDGES}, s as (select events.*, case when event_id % {LATE} = 0 then 3 else {_THIRD} end as slice from events, b),
w as (select date_trunc('millisecond', max(ts) filter (slice < 3)) - interval '10 minutes' as mark from s),
arrived as (select s.* from s, w where slice < 3 or {{end}} > mark)"""


def moments(s: SparkSession, d: str) -> DataFrame:
    """The events with their wall-clock times as instants (in UTC), which watermarks need."""
    return events(s, d).withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


def clock(df: DataFrame, *columns: str) -> DataFrame:
    """Instants as wall-clock times again."""
    return df.withColumns({c: F.to_utc_timestamp(F.col(c), F.current_timezone()).cast("timestamp_ntz") for c in columns})


def third(rows: DataFrame) -> Column:
    """0, 1 or 2 by the place of ts between its first and last value, which one aggregate tells."""
    lo, hi = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    return F.floor((F.unix_micros("ts") - (lo or 0)) * 3 / ((hi or 0) - (lo or 0) + 1)).cast("int")


def _late(rows: DataFrame) -> Column:
    return F.when(F.col("event_id") % LATE == 0, 3).otherwise(third(rows))


@query(f"with {_ARRIVED.format(end="time_bucket(interval '1 hour', ts) + interval '1 hour'")} select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from arrived group by all")
def live_tumbling(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts; of the events that come last only those count whose window the watermark has not passed."""
    rows = moments(s, d)
    return clock(appended(rows, _late(rows), 4, streams.tumbling_counts, "ts"), "window_start")


@query(
    f"with {_ARRIVED.format(end="ts + interval '30 minutes'")} select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from (select *, sum(case when g is null or g >= interval '30 minutes' then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as k"
    " from (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as g from arrived)) group by user_id, k"
)
def live_sessions(s: SparkSession, d: str) -> DataFrame:
    rows = moments(s, d)
    return clock(appended(rows, _late(rows), 4, streams.sessions, "ts"), "session_start", "session_end")


SIZE, SPAN_MS, OUT_OF_ORDER = 8, 3 * 86_400_000, 5


@query(
    f"""with recursive e as materialized (select user_id as source, event_id as id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null),
n as materialized (select source, id, k, t, least(k + {SIZE - 1}, max(k) over (partition by source order by t range between current row and {SPAN_MS * 1000 - 1} following)) as stop from e),
chain as (select source, 1::bigint as k, 0::bigint as batch from n where k = 1 union all select c.source, after.k, c.batch + 1 from chain c join n on n.source = c.source and n.k = c.k join n after on after.source = c.source and after.k = n.stop + 1)
select source, batch, case when stop - k + 1 = {SIZE} then 'size' else 'time' end as reason, stop - k + 1 as n, t as first_at,
  (select string_agg(e.id::varchar, ',' order by e.k) from e where e.source = n.source and e.k between n.k and n.stop) as ids
from chain join n using (source, k)"""
)
def live_feed(s: SparkSession, d: str) -> DataFrame:
    """Batches of each user's events, of eight or of three days; a fifth of the events arrives a slice late, within the watermark."""
    rows = moments(s, d).where("user_id is not null")
    slices = third(rows) + F.when(F.col("event_id") % OUT_OF_ORDER == 0, 1).otherwise(0)
    records = rows.select(F.col("user_id").cast("long").alias("source"), F.col("event_id").alias("id"), "ts", slices.alias("slice"))
    # The lateness that the watermark allows for is the table's own span: slices are thirds of it.
    days = rows.agg(F.date_diff(F.max("ts"), F.min("ts"))).first()[0] or 0
    out = appended(records, F.col("slice"), 4, lambda stream: feed.flushed(stream, f"{days + 1} days", SIZE, SPAN_MS), "ts")
    return out.where("source is not null").select("source", "batch", "reason", "n", "first_at", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("select user_id, event_type, ts, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def live_latest(s: SparkSession, d: str) -> DataFrame:
    """The last event of each user and type, merged slice by slice; the slices come out of order."""
    rows = moments(s, d).select("user_id", "event_type", "ts", "event_id", "value")
    folder = new_folder(s)

    def start(stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(lambda batch, n: latest.merge(batch, n, f"{folder}/state", ["user_id", "event_type"], ["ts", "event_id"]))

    replay(rows, F.pmod(F.xxhash64("event_id"), F.lit(3)), 3, folder, start)
    state = latest.current(s, f"{folder}/state")
    return clock((rows.limit(0) if state is None else state).select(*rows.columns), "ts")


@query(
    """select sha, status, n_boxes, n_boxes as stored from (select sha256(text) as sha, len([x for x in string_split(text, chr(10)) if x <> '']) as n_boxes, case when n_boxes = 0 then 'metadata-only' else 'write' end as status
from (select distinct text from documents where text is not null))"""
)
def live_ingest(s: SparkSession, d: str) -> DataFrame:
    """Texts arrive as contents in three slices with repeats across them; headers and boxes of what was committed."""
    rows = table(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    folder = new_folder(s)

    def start(stream: DataFrame) -> DataStreamWriter:
        return streams.committed(stream, f"{folder}/artifacts", text.parsed)

    replay(rows, F.pmod(F.xxhash64("doc_id"), F.lit(3)), 3, folder, start)
    heads = artifact.headers(s, f"{folder}/artifacts")
    if heads is None:
        return s.createDataFrame([], "sha string, status string, n_boxes long, stored long")
    found = artifact.scan(s, f"{folder}/artifacts").groupBy("sha").agg(F.count("*").alias("stored"))
    return heads.select("sha", "status", "n_boxes").join(found, "sha", "left").select("sha", "status", "n_boxes", F.coalesce("stored", F.lit(0)).cast("long").alias("stored"))
