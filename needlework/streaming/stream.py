"""Scans of streams that come in chunks, with exact results across chunk bounds.

The state of a stream is the bytes that a later match may still need, where they
begin in the stream, where the scan goes on, and chunks that came too early. In
exact mode a match is emitted once no longer one can start at its place, so the
result is that of a scan of the whole stream. In eager mode it is emitted as
soon as it ends, and matches may overlap.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import InputTooLarge
from ..operators.arrow import compiled, scan_bytes
from ..plans.patterns import HotSwapPatternSet, PatternSet

EXACT, EAGER = "exact", "eager"


class StreamScanner:
    """One stream; ``feed`` takes its chunks in order, ``finish`` ends it.

    Regexes need a bounded length, or a ``max_match_len``.
    """

    def __init__(self, patterns: PatternSet, mode: str = EXACT, max_match_len: int | None = None, limit: int = 1 << 62):
        if mode not in (EXACT, EAGER):
            raise ValueError(f"unknown mode {mode}")
        self.patterns, self.mode = patterns, mode
        longest = patterns.max_match_len if max_match_len is None else max_match_len
        if longest is None:
            raise ValueError("a regex of the set has no limit; give max_match_len")
        self.longest, self.limit = max(1, longest), limit
        self.buffer, self.base = b"", 0
        self.resume = {i: 0 for i in (-1, *[r.pattern_id for r in patterns.regexes])}

    def state(self) -> tuple:
        """What goes on from chunk to chunk; the patterns stay outside."""
        return self.buffer, self.base, self.resume

    def restore(self, state: tuple) -> StreamScanner:
        self.buffer, self.base, self.resume = state
        return self

    def feed(self, chunk: bytes) -> list[tuple[int, int, int]]:
        """(start, pattern_id, end) of the matches that are now certain; a stream of ``limit`` bytes or more is an error."""
        if self.base + len(self.buffer) + len(chunk) >= self.limit:
            raise InputTooLarge(f"a stream of {self.base + len(self.buffer) + len(chunk)} bytes")
        return self._eager(chunk) if self.mode == EAGER else self._exact(chunk, False)

    def finish(self) -> list[tuple[int, int, int]]:
        return [] if self.mode == EAGER else self._exact(b"", True)

    def _eager(self, chunk: bytes) -> list[tuple[int, int, int]]:
        overlap = len(self.buffer)
        data = self.buffer + chunk
        out = [(s + self.base, i, e + self.base) for s, i, e in scan_bytes(data, self.patterns) if e > overlap]
        keep = min(len(data), self.longest)
        self.base += len(data) - keep
        self.buffer = data[len(data) - keep :]
        return sorted(out)

    def _exact(self, chunk: bytes, last: bool) -> list[tuple[int, int, int]]:
        data, out = self.buffer + chunk, []
        # a place is certain once the longest match from it, and a byte to look ahead at, are here
        sure = len(data) if last else len(data) - self.longest - bool(self.patterns.regexes)
        literal, ids, regexes = compiled(self.patterns)
        fold = bytes.lower if self.patterns.case_insensitive else bytes
        # a byte before the resumed place stays, for the looks behind
        engines = [(-1, literal)] * (literal is not None) + regexes
        for key, regex in engines:
            at = self.resume[key] - self.base
            ended = -1
            while at <= len(data):
                m = regex.search(data, at)
                if m is None or m.start() > sure:
                    break
                if m.end() == m.start() == ended:
                    at += 1
                    continue
                out.append((m.start() + self.base, ids[fold(m.group())] if key == -1 else key, m.end() + self.base))
                at = ended = m.end()
            self.resume[key] = self.base + (len(data) if last else max(at, min(len(data), max(0, sure + 1))))
        keep = max(0, min(self.resume.values(), default=0) - 1 - self.base) if engines else len(data)
        self.buffer, self.base = data[keep:], self.base + keep
        return sorted(out)


def _update(patterns: PatternSet, mode: str, max_match_len: int | None, idle_ms: int | None, limit: int) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scanner, following, early = StreamScanner(patterns, mode, max_match_len, limit), 0, {}
        if state.exists:
            own, following, early = pickle.loads(bytes(state.get[0]))
            scanner.restore(own)
        found, over = [], state.hasTimedOut
        if not over:
            for frame in frames:
                for seq, data, eos in zip(frame["seq"], frame["data"], frame["eos"], strict=True):
                    if int(seq) >= following:  # a chunk that comes again is known
                        early[int(seq)] = (b"" if data is None else bytes(data), bool(eos))
        while following in early and not over:
            data, over = early.pop(following)
            found += scanner.feed(data)
            following += 1
        if over:
            found += scanner.finish()
            state.remove()
        else:
            state.update((pickle.dumps((scanner.state(), following, early)),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"stream_id": [key[0]] * len(found), "pattern_id": [i for _, i, _ in found], "start": [s for s, _, _ in found], "end": [e for _, _, e in found]})

    return run


def scan_stream(chunks: DataFrame, patterns: PatternSet | HotSwapPatternSet, mode: str = EXACT, max_match_len: int | None = None, idle_ms: int | None = None, limit: int = 1 << 62) -> DataFrame:
    """Matches of a stream of chunks (stream_id, seq, data binary, eos): stream_id, pattern_id, start, end in the stream.

    ``seq`` counts from 0 in each stream; chunks that come early wait. ``eos``
    marks the last one, whose matches are then final. Offsets are long; a
    stream of ``limit`` bytes fails the query. A stream keeps the set that the
    query began with. Its state is the bytes that a match may still need, not
    the set, and goes with its last chunk, or when for ``idle_ms`` none came:
    then what is there counts as the whole stream. As timeouts ask for further
    batches, a query with ``idle_ms`` ends by a one-batch trigger or when it is
    stopped, not by ``availableNow``.
    """
    own = patterns.current() if isinstance(patterns, HotSwapPatternSet) else patterns
    if own.max_match_len is None and max_match_len is None:
        raise ValueError("a regex of the set has no limit; give max_match_len")
    kind = chunks.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {kind}, pattern_id int, start bigint, end bigint"
    grouped = chunks.select("stream_id", "seq", "data", "eos").groupBy("stream_id")
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return grouped.applyInPandasWithState(_update(own, mode, max_match_len, idle_ms, limit), schema, "state binary", "append", timeout)


def scan_each_batch(source: DataFrame, col: str, patterns: HotSwapPatternSet, sink: Callable[[DataFrame, int], None], **options):
    """A stream writer whose every micro-batch is scanned with the set of its moment."""
    from ..operators.scan import scan

    return source.writeStream.foreachBatch(lambda df, number: sink(scan(df, col, patterns.current(), **options), number))
