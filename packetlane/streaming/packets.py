"""Streams of page events: windows with late data, latest form type, early stop of growing answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetlane.functions.scanner import StreamScanner


def windowed(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None, **aggs: Column) -> DataFrame:
    """Tumbling or sliding windows; the same plan for a static and a streaming frame."""
    e = events.withWatermark(time, late) if late else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return e.groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggs)


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Each key once while its watermark lasts."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


ANSWER = "request string, mode string, reason string, kept string, chunks int"
#: Of the state store that `early_stop` needs, and that a session must name before it starts the query.
STORE = "spark.sql.streaming.stateStore.providerClass"


def _fed(scan: StreamScanner, text: str | None, last: bool) -> tuple | None:
    got = scan.feed(text or "")
    if got:
        return got["mode"], got["reason"], scan.text[: got["end"]]
    return ("end", None, scan.text) if last else None


class EarlyStop(StatefulProcessor):
    """State by request: a scanner that has seen each character once, the number of the next chunk, chunks that came before their turn."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scan = handle.getValueState("scan", "state string, next int, done boolean")
        self.waiting = handle.getMapState("waiting", "seq int", "text string, last boolean")

    def _wake(self, timer_values) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, at, done = self.scan.get() if self.scan.exists() else ("{}", 0, False)
        self._wake(timerValues)
        came = {} if done else {int(s): (t, bool(e)) for b in rows for s, t, e in zip(b["seq"], b["text"], b["last"], strict=True) if s >= at}
        scan, out = StreamScanner(json.loads(state or "{}")), []
        while not done and (at in came or self.waiting.containsKey((at,))):
            text, last = came.pop(at) if at in came else self.waiting.getValue((at,))
            if self.waiting.containsKey((at,)):
                self.waiting.removeKey((at,))
            at += 1
            if got := _fed(scan, text, last):
                out, done = [(key[0], *got, at)], True
        if done:
            self.waiting.clear()
        for s, v in came.items():
            if not done:
                self.waiting.updateValue((s,), v)
        self.scan.update((None if done else json.dumps(scan.dump()), at, done))
        yield pd.DataFrame(out, columns=["request", "mode", "reason", "kept", "chunks"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, at, done = self.scan.get() if self.scan.exists() else (None, 0, True)
        out = [] if done else [(key[0], "idle", None, StreamScanner(json.loads(state)).text, at)]
        self.scan.clear()
        self.waiting.clear()
        yield pd.DataFrame(out, columns=["request", "mode", "reason", "kept", "chunks"])


def _chunks(chunks: DataFrame) -> DataFrame:
    last = F.coalesce("last", F.lit(False)) if "last" in chunks.columns else F.lit(False)
    return chunks.select(F.col("request").cast("string").alias("request"), F.col("seq").cast("int").alias("seq"), "text", last.alias("last"))


def early_stop(chunks: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """chunks: request, seq (from 0), text, last. One row for each request as soon as its answer may stop (mode, reason, kept), has ended, or has been idle.

    Chunks may come in any order, also in other batches, and more than once. Needs the RocksDB state store (STORE).
    """
    if "RocksDB" not in chunks.sparkSession.conf.get(STORE):
        raise ValueError(f"set {STORE} to the RocksDB provider")
    return _chunks(chunks).groupBy("request").transformWithStateInPandas(EarlyStop(idle_ms), ANSWER, "Append", "ProcessingTime")


def stopped(chunks: DataFrame) -> DataFrame:
    """The same of a table: one row for each request that may stop or has ended. A request's chunks are those of one answer."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        scan, out = StreamScanner(), []
        for at, (seq, text, last) in enumerate(rows.drop_duplicates("seq").sort_values("seq")[["seq", "text", "last"]].itertuples(index=False)):
            if seq != at:
                break  # what follows a gap can't be read yet
            if got := _fed(scan, text, last):
                out = [(key[0], *got, at + 1)]
                break
        return pd.DataFrame(out, columns=["request", "mode", "reason", "kept", "chunks"])

    return _chunks(chunks).groupBy("request").applyInPandas(run, ANSWER)
