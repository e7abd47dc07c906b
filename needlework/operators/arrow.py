"""The Arrow strategy: Python's engine over bytes, a batch at a time.

It takes what Java's engine can't: expressions that may be empty (whose
iteration rules differ) and repetitions of groups, on which Java recurses. For
rows of matches it is also the faster: offsets come with the matches, while
built-in functions have to sum lengths up.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MatchBufferOverflow, MatchTooLong
from ..plans.literals import start_regex
from ..plans.patterns import PatternSet
from ..types import MATCHES
from .greedy import HITS


@lru_cache(maxsize=32)
def compiled(patterns: PatternSet) -> tuple:
    """Compiled once per worker and set."""
    literal = re.compile(patterns.literal_regex.encode("ascii")) if patterns.literal_regex else None
    ids = {k.encode("latin-1"): v[0] for k, v in patterns.keys.items()}
    return literal, ids, [(r.pattern_id, re.compile(r.rendered.encode("ascii"))) for r in patterns.regexes]


@lru_cache(maxsize=32)
def candidates(patterns: PatternSet) -> tuple:
    """Where literals begin, how many bytes tell them apart, and by these bytes the other lengths that they have; all ids by bytes."""
    begins = re.compile(f"(?={start_regex(patterns.keys, patterns.case_insensitive)})".encode("ascii"))
    every = {k.encode("latin-1"): ids for k, ids in patterns.keys.items()}
    head = min(map(len, every))
    lengths: dict[bytes, set[int]] = {}
    for k in every:
        lengths.setdefault(k[:head], set()).add(len(k))
    return begins, head, {k: tuple(sorted(v)) for k, v in lengths.items()}, every


def overlapping(data: bytes, patterns: PatternSet) -> Iterator[tuple[int, int, int]]:
    """(start, pattern_id, end) of every occurrence of every literal."""
    begins, head, lengths, every = candidates(patterns)
    low = data.lower() if patterns.case_insensitive else data
    for m in begins.finditer(data):
        s = m.start()
        for n in lengths[low[s : s + head]]:
            if s + n > len(low):
                break
            for i in every.get(low[s : s + n], ()):
                yield s, i, s + n


def shortest_all(data: bytes, patterns: PatternSet) -> list[tuple[int, int, int]]:
    """At each start the shortest literal that matches, with all ids of it; goes on at its end."""
    out, at = [], 0
    for s, i, e in overlapping(data, patterns):
        if s >= at or (out and out[-1][0] == s and out[-1][2] == e):
            out.append((s, i, e))
            at = e
    return out


def needle_by_needle(data: bytes, patterns: PatternSet) -> list[tuple[int, int, int]]:
    """Each literal's own non-overlapping hits; of those that overlap the leftmost, then longest, then lowest id."""
    low = data.lower() if patterns.case_insensitive else data
    found = []
    for i, raw in patterns.literals:
        raw = raw.lower() if patterns.case_insensitive else raw
        at = low.find(raw)
        while at >= 0:
            found.append((at, -len(raw), i))
            at = low.find(raw, at + len(raw))
    out, at = [], 0
    for s, n, i in sorted(found):
        if s >= at:
            out.append((s, i, s - n))
            at = s - n
    return out


COMPAT = {"shortest_all": shortest_all, "needle_by_needle": needle_by_needle}


def spans(regex: re.Pattern, data: bytes):
    """Non-overlapping matches; an empty one right after another match doesn't count."""
    at, last = 0, -1
    while at <= len(data):
        m = regex.search(data, at)
        if m is None:
            return
        if m.end() == m.start() == last:
            at += 1
            continue
        yield m.start(), m.end()
        at = last = m.end()


def scan_bytes(data: bytes, patterns: PatternSet) -> list[tuple[int, int, int]]:
    """(start, pattern_id, end) in order."""
    literal, ids, regexes = compiled(patterns)
    out = []
    if literal:
        fold = bytes.lower if patterns.case_insensitive else bytes
        out = [(m.start(), ids[fold(m.group())], m.end()) for m in literal.finditer(data)]
    for i, regex in regexes:
        out += [(s, i, e) for s, e in spans(regex, data)]
    return sorted(out) if regexes else out


def iterate(data: bytes, patterns: PatternSet) -> Iterator[tuple[int, int, int]]:
    """As ``scan_bytes``, one at a time: who stops early saves the rest of the haystack."""
    literal, ids, regexes = compiled(patterns)
    fold = bytes.lower if patterns.case_insensitive else bytes
    numbered = lambda i, regex: ((s, i, e) for s, e in spans(regex, data))
    engines = [numbered(i, regex) for i, regex in regexes]
    if literal:
        engines.append((m.start(), ids[fold(m.group())], m.end()) for m in literal.finditer(data))
    return heapq.merge(*engines)


def found_anywhere(data: bytes, patterns: PatternSet) -> bool:
    literal, _, regexes = compiled(patterns)
    return bool(literal and literal.search(data)) or any(r.search(data) for _, r in regexes)


def met(regex: re.Pattern, data: bytes, low: int, high: int, region: int, whole: bool) -> dict[int, int]:
    """Start and end of what a walk may meet that comes in anywhere from ``low`` to ``low + region``: the first match from each
    such place on, and the chains that go on at their ends, as far as they start before ``high``."""
    found: dict[int, int] = {}

    def follow(at: int) -> int:
        """The first start from ``at`` on; its chain is in ``found`` then."""
        first = -1
        while at < high and (m := regex.search(data, at)) and m.start() < high:
            first = m.start() if first < 0 else first
            if m.start() in found:
                break
            if m.end() == len(data) and not whole:
                raise MatchTooLong(f"a match of {m.end() - m.start()} bytes or more goes on beyond its chunk; raise max_match_len")
            found[m.start()] = at = m.end()
        return first if first >= 0 else high

    at = low
    while at < min(high, low + region):
        at = follow(at) + 1
    return found


def matches_arrow(c: Column, patterns: PatternSet) -> Column:
    """As ``functions.columns.matches``, for a binary column."""

    @F.pandas_udf(MATCHES)
    def found(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [{"pattern_id": i, "start": s, "end": e} for s, i, e in scan_bytes(bytes(v), patterns)])

    return found(c)


def count_arrow(c: Column, patterns: PatternSet) -> Column:
    """Matches in a binary column, which aren't kept; null for a null haystack."""

    @F.pandas_udf("long")
    def found(values: pd.Series) -> pd.Series:
        literal, _, regexes = compiled(patterns)
        count = lambda v: (len(literal.findall(v)) if literal else 0) + sum(1 for _, r in regexes for _ in spans(r, v))
        return pd.Series([None if v is None else count(bytes(v)) for v in values], dtype="Int64")

    return found(c)


def any_arrow(c: Column, patterns: PatternSet) -> Column:
    """Whether any pattern is in a binary column; the first match ends the search."""

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else found_anywhere(bytes(v), patterns))

    return found(c)


def first_arrow(c: Column, patterns: PatternSet) -> Column:
    """The first match in a binary column, or null; it ends the search."""

    @F.pandas_udf("pattern_id int, start int, end int")
    def found(values: pd.Series) -> pd.DataFrame:
        firsts = [None if v is None else next(iterate(bytes(v), patterns), None) for v in values]
        return pd.DataFrame({c: pd.array([None if m is None else m[k] for m in firsts], dtype="Int32") for c, k in (("pattern_id", 1), ("start", 0), ("end", 2))})

    one = found(c)
    return F.when(one["start"].isNotNull(), one)


def nested_rows(df: DataFrame, hay: str, patterns: PatternSet, into: str, max_matches: int) -> DataFrame:
    """``df``, whose column ``hay`` is binary, with the array of its matches instead of it; so many fail the query."""
    keep = [c for c in df.columns if c != hay]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(into, T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("pattern_id", "start", "end")])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                found, ends = [], [0]
                for value in part.column(part.num_columns - 1).to_pylist():
                    if value is not None:
                        found += scan_bytes(value, patterns) if len(value) < max_matches else bounded(iterate(value, patterns), max_matches)
                    if len(found) - ends[-1] >= max_matches:
                        overflow(max_matches)
                    ends.append(len(found))
                columns = [pa.array([m[k] for m in found], pa.int32()) for k in (1, 0, 2)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["pattern_id", "start", "end"]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*keep, into])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(hay)).mapInArrow(run, schema)


#: Haystacks whose matches are one batch of the result, about.
ROWS = 256


def as_one(column: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of a binary column's values one after the other, and where each begins and the last ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    data = column.buffers()[2].slice(int(offsets[0]), size) if size else pa.py_buffer(b"")
    return data, offsets - offsets[0]


def overflow(n: int) -> None:
    raise MatchBufferOverflow(f"{n} matches or more")


def bounded(found: Iterator, n: int) -> Iterator:
    """``found``, or an error as soon as there are ``n``."""
    for k, m in enumerate(found, 1):
        if k == n:
            overflow(n)
        yield m


def scan_rows(rows: DataFrame, keep: list[str], patterns: PatternSet, every: bool = False, compat: str | None = None, max_matches: int | None = None, first_n: int | None = None) -> DataFrame:
    """``keep``, pattern_id, start, end for every match in the last column, a binary one; with ``every``, overlapping literals.

    A haystack with ``max_matches`` or more fails the query as soon as they are
    found; ``first_n`` ends its scan. Nothing is shuffled.
    """
    numbers = ["pattern_id", "start", "end"]
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in keep], *[T.StructField(c, T.IntegerType()) for c in numbers]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        literal, ids, regexes = compiled(patterns)
        fold = bytes.lower if patterns.case_insensitive else None

        def all_of(value: bytes) -> Iterator[tuple[int, int, int]]:
            if every or compat:
                yield from (COMPAT[compat] if compat else overlapping)(value, patterns)
                for i, regex in regexes:
                    yield from ((s, i, e) for s, e in spans(regex, value))
            elif first_n is not None or len(value) >= (max_matches or 0) > 0:  # else no engine can have so many
                yield from islice(iterate(value, patterns), first_n)
            else:
                yield from scan_bytes(value, patterns)

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                counts, found, starts, ends = [], [], [], []
                for value in part.column(part.num_columns - 1).to_pylist():
                    before = len(found)
                    if value is not None and (regexes or every or compat or first_n is not None or len(value) >= (max_matches or 0) > 0):
                        for s, i, e in all_of(value) if max_matches is None else bounded(all_of(value), max_matches):
                            found.append(i)
                            starts.append(s)
                            ends.append(e)
                    elif value is not None:  # a match has a byte at least, so there can't be too many
                        hits = list(literal.finditer(value))
                        found += [ids[m.group()] for m in hits] if fold is None else [ids[fold(m.group())] for m in hits]
                        starts += [m.start() for m in hits]
                        ends += [m.end() for m in hits]
                    counts.append(len(found) - before)
                if found:
                    take = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int32())
                    columns = [part.column(k).take(take) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int32()) for x in (found, starts, ends)]], [*keep, *numbers])

    return rows.mapInArrow(run, schema)


def total_rows(rows: DataFrame, keep: list[str], patterns: PatternSet, places: bool = True) -> DataFrame:
    """``keep``, pattern_id, n_matches, n_bytes and, with ``places``, least_start, largest_end: a row for each pattern that the last column, a binary one, has."""
    numbers = ["pattern_id", "n_matches", "n_bytes", *(["least_start", "largest_end"] if places else [])]
    kinds = [T.IntegerType(), *[T.LongType()] * (len(numbers) - 1)]
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in keep], *[T.StructField(c, k) for c, k in zip(numbers, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        literal, ids, regexes = compiled(patterns)
        fold = bytes.lower if patterns.case_insensitive else None

        def counted(value: bytes) -> list[tuple]:
            found = literal.findall(value)
            return [(ids[w], n, n * len(w)) for w, n in Counter(found if fold is None else map(fold, found)).items()]

        def placed(value: bytes) -> list[tuple]:
            hits = list(literal.finditer(value))
            texts = [m.group() for m in hits] if fold is None else [fold(m.group()) for m in hits]
            last = dict(zip(texts, hits, strict=True))
            first = dict(zip(reversed(texts), reversed(hits), strict=True))
            return [(ids[w], n, n * len(w), first[w].start(), last[w].end()) for w, n in Counter(texts).items()]

        def mixed(value: bytes) -> list[tuple]:
            own: dict[int, list[int]] = {}
            for s, i, e in scan_bytes(value, patterns):
                t = own.setdefault(i, [0, 0, s, e])
                t[0] += 1
                t[1] += e - s
                t[3] = max(t[3], e)
            return [(i, *t[: len(numbers) - 1]) for i, t in own.items()]

        totals_of = mixed if regexes else placed if places else counted
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                take, totals = [], []
                for row, value in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    if value is not None:
                        own = totals_of(value)
                        take += [row] * len(own)
                        totals += own
                if totals:
                    columns = [part.column(k).take(pa.array(take, pa.int32())) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int32() if n == 0 else pa.int64()) for n, x in enumerate(zip(*totals, strict=True))]], [*keep, *numbers])

    return rows.mapInArrow(run, schema)


def chunk_rows(rows: DataFrame, keep: list[str], patterns: PatternSet, size: int, longest: int) -> DataFrame:
    """``keep``, pattern_id, _block and _hits (in the whole haystack) of what a walk along each regex may meet in a chunk.

    ``rows`` have ``keep``, chunk_start, the chunk's own size, whether the
    haystack ends in its bytes, and these, ahead of which is the last byte of
    the chunk that comes first.
    """
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in keep], T.StructField("pattern_id", T.IntegerType()), T.StructField("_block", T.LongType()), T.StructField("_hits", HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regexes = compiled(patterns)[2]
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                take, ids, blocks, ends, starts, stops = [], [], [], [0], [], []
                for row, (at, own, whole, value) in enumerate(zip(*(c.to_pylist() for c in part.columns[-4:]), strict=True)):
                    lead = min(1, at)
                    for i, regex in regexes:
                        if found := met(regex, value, lead, lead + max(1, own), longest, whole):
                            take.append(row)
                            ids.append(i)
                            blocks.append(at // size)
                            starts += [s + at - lead for s in found]
                            stops += [e + at - lead for e in found.values()]
                            ends.append(len(starts))
                if take:
                    columns = [part.column(k).take(pa.array(take, pa.int32())) for k in range(len(keep))]
                    numbers = [pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array([i for i, a, b in zip(ids, ends, ends[1:], strict=False) for _ in range(b - a)], pa.int64())]
                    hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(numbers, ["start", "end", "pattern_id"]))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.int32()), pa.array(blocks, pa.int64()), hits], schema.names)

    return rows.mapInArrow(run, schema)
