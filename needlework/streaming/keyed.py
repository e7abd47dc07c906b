"""Streams of chunks with typed state for each: what changes is written, not all of it.

As ``stream.scan_stream``, by ``transformWithStateInPandas``. A stream's tail (a
value), the places where its engines go on (a map) and each chunk that came
early (another map, whose entries may expire) are states of their own; a timer
ends a stream that went idle. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.patterns import PatternSet
from .stream import EXACT, StreamScanner

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that typed states need, for queries that start from now on."""
    spark.conf.set(STORE, ROCKSDB)


class ScanProcessor(StatefulProcessor):
    """The scan of one stream, its chunks in order of ``seq``."""

    def __init__(self, patterns: PatternSet, mode: str = EXACT, max_match_len: int | None = None, limit: int = 1 << 62, idle_ms: int | None = None, wait_ms: int | None = None):
        self.patterns, self.mode, self.max_match_len, self.limit = patterns, mode, max_match_len, limit
        self.idle_ms, self.wait_ms = idle_ms, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "buffer binary, base bigint, following bigint")
        self.resume = handle.getMapState("resume", "engine int", "at bigint")
        self.early = handle.getMapState("early", "seq bigint", "data binary, eos boolean", self.wait_ms)

    def _restored(self) -> tuple[StreamScanner, int]:
        scanner = StreamScanner(self.patterns, self.mode, self.max_match_len, self.limit)
        if not self.tail.exists():
            return scanner, 0
        buffer, base, following = self.tail.get()
        resume = {int(k[0]): int(v[0]) for k, v in self.resume.iterator()}
        return scanner.restore((bytes(buffer), int(base), scanner.resume | resume)), int(following)

    def _forget(self) -> None:
        self.tail.clear()
        self.resume.clear()
        self.early.clear()
        self._no_timer()

    def _no_timer(self) -> None:
        if self.idle_ms is not None:  # else there are none, and asking for them is an error
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)

    def _rows(self, key: tuple, found: list[tuple[int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": [key[0]] * len(found), "pattern_id": [i for _, i, _ in found], "start": [s for s, _, _ in found], "end": [e for _, _, e in found]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scanner, following = self._restored()
        before = dict(scanner.resume)
        waiting = {int(k[0]) for k in self.early.keys()} if self.early.exists() else set()
        held: dict[int, tuple[bytes, bool]] = {}  # of this batch, until their turn
        found, over = [], False
        for frame in rows:
            for seq, data, eos in zip(frame["seq"], frame["data"], frame["eos"], strict=True):
                seq = int(seq)
                if over or seq < following or seq in waiting:  # known, as it came before
                    continue
                held.setdefault(seq, (b"" if data is None else bytes(data), bool(eos)))
                while not over and (following in held or following in waiting):
                    if following in held:
                        data, over = held.pop(following)
                    else:
                        data, over = self.early.getValue((following,)) or (None, None)
                        waiting.discard(following)
                        if data is None:  # it has expired meanwhile
                            break
                        self.early.removeKey((following,))
                    found += scanner.feed(bytes(data))
                    following += 1
        if over:
            found += scanner.finish()
            self._forget()
        else:
            buffer, base, resume = scanner.state()
            self.tail.update((buffer, base, following))
            for k, at in resume.items():
                if at != before.get(k) or not at:
                    self.resume.updateValue((k,), (at,))
            for seq, chunk in held.items():
                self.early.updateValue((seq,), chunk)
            if self.idle_ms is not None:
                self._no_timer()
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self._restored()[0].finish()
        self._forget()
        yield self._rows(key, found)

    def close(self) -> None:
        pass


def scan_keyed_stream(chunks: DataFrame, patterns: PatternSet, mode: str = EXACT, max_match_len: int | None = None, limit: int = 1 << 62, idle_ms: int | None = None, wait_ms: int | None = None) -> DataFrame:
    """Matches of a stream of chunks (stream_id, seq, data binary, eos): stream_id, pattern_id, start, end in the stream.

    ``seq`` counts from 0 in each stream; a chunk that comes early waits, for
    ``wait_ms`` at most if that is given, one that comes again is left out.
    ``eos`` marks the last one, after which the state is gone. After
    ``idle_ms`` without a chunk a stream ends as it is, by a timer; such a
    query wants a trigger that runs further batches.
    """
    if patterns.max_match_len is None and max_match_len is None:
        raise ValueError("a regex of the set has no limit; give max_match_len")
    kind = chunks.schema["stream_id"].dataType.simpleString()
    processor = ScanProcessor(patterns, mode, max_match_len, limit, idle_ms, wait_ms)
    grouped = chunks.select("stream_id", "seq", "data", "eos").groupBy("stream_id")
    timed = "None" if idle_ms is None and wait_ms is None else "ProcessingTime"
    return grouped.transformWithStateInPandas(processor, f"stream_id {kind}, pattern_id int, start bigint, end bigint", "Append", timed)
