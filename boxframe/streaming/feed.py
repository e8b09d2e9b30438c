"""The change feed: records of a source leave in batches, of a given size or a given time after the batch's first record.

State is keyed by source: records that wait for the watermark, and the open batch. Records are taken in the order of their time once the
watermark has passed them, so batches do not depend on how records were dealt to micro-batches, and a restart changes nothing.
The timer of an open batch closes it even if no further record of its source arrives.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How many records, or how many milliseconds after the first, end a batch.
FLUSH_SIZE, FLUSH_MS = 50, 200
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORD = "at long, id long"


class Flush(StatefulProcessor):
    """Rows (source, id, at in microseconds) to batches; a record at the very end of the time opens the next batch."""

    def __init__(self, size: int, ms: int) -> None:
        self.size, self.span = size, ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", RECORD)
        self.open = handle.getListState("open", RECORD)
        self.done = handle.getValueState("done", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.sort_values(["at", "id"])
            self.waiting.appendList([(int(a), int(i)) for a, i in zip(pdf["at"], pdf["id"], strict=True)])
            self.handle.registerTimer(int(pdf["at"].iloc[0]) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((int(r[0]), int(r[1])) for r in self.waiting.get())
        batch = [(int(r[0]), int(r[1])) for r in self.open.get()]
        done = int(self.done.get()[0]) if self.done.exists() else 0
        out: list[dict] = []

        def flush(reason: str) -> None:
            nonlocal batch
            out.append({"source": key[0], "batch": done + len(out), "reason": reason, "n": len(batch), "first_at": batch[0][0], "ids": [i for _, i in batch]})
            batch = []

        ready = [r for r in waiting if r[0] <= now]
        for r in ready:
            if batch and r[0] >= batch[0][0] + self.span:
                flush("time")
            batch.append(r)
            if len(batch) == self.size:
                flush("size")
        if batch and now >= batch[0][0] + self.span:
            flush("time")
        self._keep(self.waiting, waiting[len(ready) :])
        self._keep(self.open, batch)
        if out:
            self.done.update((done + len(out),))
        if len(waiting) > len(ready):
            self.handle.registerTimer(waiting[len(ready)][0] // 1000 + 1)
        if batch:
            self.handle.registerTimer((batch[0][0] + self.span) // 1000 + 1)
        if out:
            yield pd.DataFrame(out)

    @staticmethod
    def _keep(state, rows: list[tuple[int, int]]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def flushed(feed: DataFrame, late: str, size: int = FLUSH_SIZE, ms: int = FLUSH_MS) -> DataFrame:
    """source, batch (from 0), reason (size or time), n, first_at (microseconds), ids of a stream of (source long, id long, ts).

    Records later than the watermark are dropped, as anywhere in a stream. The session gets the state store that lists and timers need.
    """
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = feed.withWatermark("ts", late).selectExpr("source", "coalesce(id, -1) as id", "unix_micros(ts) as at", "ts")
    schema = "source long, batch long, reason string, n long, first_at long, ids array<long>"
    return rows.groupBy("source").transformWithStateInPandas(Flush(size, ms), schema, "Append", "EventTime")
