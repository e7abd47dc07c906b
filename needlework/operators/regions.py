"""Exact scans of the few stretches of haystacks in which a literal can be.

A batch of haystacks is looked at as one array of bytes. Windows without the
bytes that some literal needs, as often as it needs them, are left out by their
byte frequencies; in the others a sieve looks for each literal's rarest pair of
neighbouring bytes. A pair gives the stretch in which its literals lie,
stretches that touch are merged, and only these are scanned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.patterns import PatternSet
from ..plans.planner import ScanConfig
from .arrow import as_one, compiled, overflow

#: Bytes of a window.
WINDOW = 4096
#: Literals up to which byte frequencies are compared; for more, the sieve alone is cheaper.
FREQUENCIES = 64
#: Haystacks looked at together.
ROWS = 256

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def surviving(x: np.ndarray, literals: list[bytes]) -> np.ndarray:
    """Which windows of ``x`` may hold the beginning of a literal, by byte frequencies."""
    n = -(-len(x) // WINDOW)
    if len(literals) > FREQUENCIES or max(map(len, literals)) > WINDOW:
        return np.ones(n, bool)
    cells = (np.arange(len(x), dtype=np.int64) // WINDOW) * 256 + x
    counts = np.bincount(cells, minlength=n * 256).reshape(n, 256)
    reach = counts.copy()
    reach[:-1] += counts[1:]  # a literal may end in the next window
    out = np.zeros(n, bool)
    for raw in literals:
        need = Counter(raw)
        left = np.flatnonzero(~out)
        out[left] = (reach[np.ix_(left, list(need))] >= np.array(list(need.values()))).all(axis=1)
    return out


class Sieve:
    """For each pair of bytes how far literals that are told by it begin before it and end after it."""

    def __init__(self, literals: list[bytes], frequency: np.ndarray):
        """``frequency`` of each byte decides which pair of a literal is rare; literals of one byte go by all pairs that begin with it."""
        self.before = np.full(1 << 16, -1, np.int64)
        self.after = np.zeros(1 << 16, np.int64)
        for raw in literals:
            if len(raw) == 1:
                self._add(np.arange(raw[0] << 8, (raw[0] + 1) << 8), 0, 1)
                continue
            x = np.frombuffer(raw, np.uint8)
            rare = frequency[x[:-1]] * frequency[x[1:]]
            k = int(np.argmin(rare))
            self._add(np.array([(int(x[k]) << 8) + int(x[k + 1])]), k, len(raw) - k)

    def _add(self, pairs: np.ndarray, before: int, after: int) -> None:
        self.before[pairs] = np.maximum(self.before[pairs], before)
        self.after[pairs] = np.maximum(self.after[pairs], after)

    def stretches(self, x: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings and ends of the stretches told by pairs at ``first`` up to ``last``."""
        pairs = x[first:last].astype(np.uint16) << np.uint16(8)
        pairs[: len(x) - first - 1] |= x[first + 1 : last + 1]
        at = np.flatnonzero(self.before[pairs] >= 0)
        own = pairs[at]
        at = at + first
        return at - self.before[own], at + self.after[own]


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order without those that touch another."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return begin[heads], end[np.append(heads[1:], len(begin)) - 1]


def regions(x: np.ndarray, bounds: np.ndarray, literals: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(haystack, begin, end) of the stretches of ``x`` to scan; haystack k lies from ``bounds[k]`` to ``bounds[k + 1]``."""
    frequency = np.bincount(x, minlength=256).astype(np.float64) + 1
    sieve = Sieve(literals, frequency)
    windows = surviving(x, literals)
    longest = max(map(len, literals))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], windows.astype(np.int8), [0]])))
    found = [sieve.stretches(x, a * WINDOW, min(len(x), b * WINDOW + longest)) for a, b in edges.reshape(-1, 2).tolist()]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    begin, end = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    begin, end = merged(np.clip(begin, 0, None), np.clip(end, None, len(x)))
    first = np.searchsorted(bounds, begin, "right") - 1
    last = np.searchsorted(bounds, end, "left") - 1
    spans = last - first + 1  # a stretch over a haystack's end is cut there
    row = np.repeat(first, spans) + (np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans))
    begin, end = np.maximum(np.repeat(begin, spans), bounds[row]), np.minimum(np.repeat(end, spans), bounds[row + 1])
    full = end > begin
    return row[full], begin[full], end[full]


def _literals(patterns: PatternSet) -> list[bytes]:
    if patterns.regexes:
        raise ValueError("stretches are found for literals only")
    return [k.encode("latin-1") for k in patterns.keys]


def _batches(batch: pa.RecordBatch, literals: list[bytes], fold: bool) -> Iterator[tuple]:
    """(slice, bytes, its bounds in them, stretches)"""
    for first in range(0, batch.num_rows, ROWS):
        part = batch.slice(first, ROWS)
        data, bounds = as_one(part.column(part.num_columns - 1))
        x = np.frombuffer(data, np.uint8)
        x = _LOWER[x] if fold else x
        yield part, data, bounds, regions(x, bounds, literals) if len(x) else (np.zeros(0, np.int64),) * 3


def scan_regions(df: DataFrame, col: str, patterns: PatternSet, keep: list[str] | None = None, config: ScanConfig = ScanConfig()) -> DataFrame:
    """As ``scan`` for literals: ``keep`` (default: all but ``col``), pattern_id, start, end."""
    keep = [c for c in df.columns if c != col] if keep is None else keep
    if clash := {"pattern_id", "start", "end"} & set(keep):
        raise ValueError(f"the result has columns of these names already: {sorted(clash)}")
    literals, limit = _literals(patterns), config.max_matches
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], *[T.StructField(c, T.IntegerType()) for c in ("pattern_id", "start", "end")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        literal, ids, _ = compiled(patterns)
        fold = patterns.case_insensitive
        for batch in batches:
            for part, data, bounds, (row, begin, end) in _batches(batch, literals, fold):
                view = memoryview(data)
                rows, found, starts, ends = [], [], [], []
                for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True):
                    base = int(bounds[r])
                    for m in literal.finditer(view, a, b):
                        text = m.group()
                        rows.append(r)
                        found.append(ids[bytes(text).lower() if fold else bytes(text)])
                        starts.append(m.start() - base)
                        ends.append(m.end() - base)
                if rows and max(Counter(rows).values()) >= limit:
                    overflow(limit)
                if rows:
                    take = pa.array(rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([*[part.column(k).take(take) for k in range(len(keep))], *[pa.array(v, pa.int32()) for v in (found, starts, ends)]], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{col}`").cast("binary").alias("_hay")).mapInArrow(run, schema)


def bytes_read(df: DataFrame, col: str, patterns: PatternSet, keep: list[str] | None = None) -> DataFrame:
    """``keep``, n_bytes and n_read of every haystack: how much of it is scanned; null for a null one."""
    keep = [c for c in df.columns if c != col] if keep is None else keep
    literals = _literals(patterns)
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], T.StructField("n_bytes", T.LongType()), T.StructField("n_read", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, bounds, (row, begin, end) in _batches(batch, literals, patterns.case_insensitive):
                read = np.zeros(part.num_rows, np.int64)
                np.add.at(read, row, end - begin)
                gone = np.array(part.column(part.num_columns - 1).is_null())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(np.diff(bounds), mask=gone), pa.array(read, mask=gone)], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{col}`").cast("binary").alias("_hay")).mapInArrow(run, schema)
