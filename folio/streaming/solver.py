"""The solver's stream with state: chunks of requests put in order, until a request is finished, failed or stale."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNKS = "request string, seq long, type string, text string, ts timestamp"
EVENTS = "request string, event string, seq long, text string"
TOLD = Row("request", "event", "seq", "text")
#: Rows of a request that are put in order at once.
FRAME = 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Solver(StatefulProcessor):
    """Chunks of a request are numbered from 0; `done` or `error` has the number behind the last. Rows may come late, twice
    and in any order, in one batch or in several.

    State of a request: its chunks by number, and how far they are whole, what ended it, and when it becomes stale. A chunk
    is passed on as soon as all before it are there. A request that has ended keeps its state without chunks until the
    timer, so that what comes late is told as late and opens nothing again.
    """

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "seq long", "text string")
        self.about = handle.getValueState("about", "next long, last long, kind string, note string, ended boolean, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        about = self.about.get()
        next_, last, kind, note, ended, timer = about or (0, None, None, None, False, None)
        # Chunks that come now go to the state at the end, and only if the request doesn't end: each look there is a call to Spark.
        stored, came, latest = about is not None and not ended, {}, None
        while frame := sorted(islice(rows, FRAME), key=lambda r: r.seq):
            for r in frame:
                latest = r.ms if latest is None else max(latest, r.ms)
                text = r.text or ""
                if ended:
                    yield TOLD(key[0], "late", r.seq, text)
                elif r.type in ("done", "error"):
                    if last is None:
                        last, kind, note = r.seq, r.type, text
                elif r.seq >= next_ and r.seq not in came and not (stored and self.chunks.containsKey((r.seq,))):
                    came[r.seq] = text
            while not ended and (last is None or next_ < last):
                text = came.get(next_)
                if text is None and stored and (found := self.chunks.getValue((next_,))) is not None:
                    text = found[0]
                if text is None:
                    break
                yield TOLD(key[0], "chunk", next_, text)
                next_ += 1
            if not ended and last is not None and (kind == "error" or next_ == last):
                yield TOLD(key[0], "failed", last, note) if kind == "error" else TOLD(key[0], "finished", last, self.whole(next_, came, stored))
                if stored:
                    self.chunks.clear()
                ended, stored, came = True, False, {}
        for seq, text in came.items():
            self.chunks.updateValue((seq,), (text,))
        if timer is None or (latest is not None and not ended and latest + self.timeout_ms > timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (latest or timerValues.getCurrentWatermarkInMs()) + self.timeout_ms
            self.handle.registerTimer(timer)
        self.about.update((next_, last, kind, note, ended, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        next_, _, _, _, ended, _ = self.about.get()
        if not ended:
            yield TOLD(key[0], "stale", next_, self.whole(next_, {}, True))
            self.chunks.clear()
        self.about.clear()

    def whole(self, n: int, came: dict[int, str], stored: bool) -> str:
        texts = {seq: text for (seq,), (text,) in self.chunks.iterator()} | came if stored else came
        return "".join(texts[i] for i in range(n))

    def close(self) -> None:
        pass


def solver_events(chunks: DataFrame, timeout: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """EVENTS of a stream of CHUNKS: `chunk` (in order, each once), `finished` with the whole text, `failed` with the reason,
    `stale` with the text so far if nothing came for `timeout`, and `late` for what comes after the end.

    Time is that of the rows: the watermark is `delay` behind the latest, and rows behind it are left out. Rows without a
    request or a number are left out. State is one request's chunks, so a key is bounded by one answer.
    """
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    rows = chunks.filter("request IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").select("request", F.col("seq").cast("long").alias("seq"), "type", "text", "ts", F.unix_millis("ts").alias("ms"))
    return rows.withWatermark("ts", delay).groupBy("request").transformWithState(Solver(ms), EVENTS, "Append", "EventTime")


def write_events(events: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Appends events to a Parquet table. State goes to RocksDB, which this operator needs, and with it to the checkpoint, so a
    query that is started again goes on where it was."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = events.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def history(events: DataFrame) -> DataFrame:
    """request and text of what has finished, as the history keeps it."""
    return events.filter("event = 'finished'").select("request", "text")
