"""Scans of long haystacks in chunks, so that one of them isn't one task's work."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..plans.patterns import PatternSet
from ..plans.planner import ScanConfig
from . import greedy
from .arrow import chunk_rows
from .scan import NO_LIMIT, is_binary, limited, overflow, scan_overlapping


def shard_plan(length: int, shards: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, nominal end, end with overlap) of equal byte ranges."""
    bounds = [length * k // shards for k in range(shards + 1)]
    return [(a, b, min(length, b + overlap)) for a, b in zip(bounds, bounds[1:], strict=False)]


def chunks(df: DataFrame, col: str, size: int, overlap: int, before: int = 0) -> DataFrame:
    """One row per chunk: the other columns, chunk_start, nominal_end, _whole and ``col`` as binary, ``overlap`` bytes longer.

    _whole tells whether the haystack ends in these bytes. ``before`` bytes ahead of the chunk come with it. The pieces are cut before
    they become rows, so a haystack isn't copied once per chunk.
    """
    raw = F.col(col) if is_binary(df, col) else F.encode(F.col(col), "UTF-8")
    other = [F.col(f"`{c}`") for c in df.columns if c != col]

    def cut(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(own) - 1), F.lit(size))

        def piece(at: Column) -> Column:
            first = F.greatest(F.lit(0), at - before)
            end = F.least(at + size, F.octet_length(own))
            whole = at + size + overlap >= F.octet_length(own)
            return F.struct(at.alias("chunk_start"), end.alias("nominal_end"), whole.alias("_whole"), F.substring(own, first + 1, at - first + size + overlap).alias(col))

        return F.transform(starts, piece)

    return df.where(F.col(f"`{col}`").isNotNull()).select(*other, F.inline(let(raw, cut)))


def scan_chunked(df: DataFrame, col: str, patterns: PatternSet, keep: list[str], config: ScanConfig = ScanConfig(), spread: int | None = None, max_match_len: int | None = None) -> DataFrame:
    """As ``scan_overlapping``, chunk by chunk; a hit belongs to the chunk in which it starts.

    The overlap is that of the longest match at least: regexes need a bounded
    length, or a ``max_match_len``; one that still goes on where a chunk's
    bytes end is an error (``MatchTooLong``), never cut. Matches of a regex
    don't overlap, which chunks can't know of each other: each gives what a
    walk may meet in it wherever it comes in, and ``greedy.pick`` keeps what
    the walk from the haystack's beginning meets. ``spread`` deals the chunks
    out to so many tasks before the scan. The limit of ``config`` on matches
    holds for haystacks, not chunks.
    """
    longest = patterns.max_match_len if max_match_len is None else max_match_len
    if longest is None:
        raise ValueError("a regex of the set has no limit; give max_match_len")
    if any(r.least == 0 for r in patterns.regexes):
        raise ValueError("a regex of the set may be empty")
    own = [c for c in df.columns if c in {*keep, col}]
    rows = df.select(*[F.col(f"`{c}`") for c in own]).withColumn("_row", F.monotonically_increasing_id())
    found = []
    regexes = {r.pattern_id for r in patterns.regexes}
    if patterns.keys:
        plain = PatternSet(tuple(p for p in patterns.patterns if p.pattern_id not in regexes), patterns.case_insensitive, patterns.regex_limit)
        hits = lambda some: _literals(some, col, plain, keep, config, spread)
        found.append(limited(rows, col, is_binary(df, col), hits, plain, config.max_matches))
    if regexes:
        found.append(_regexes(rows, col, patterns, keep, config, spread, longest))
    names = [*[F.col(f"`{c}`") for c in keep], "pattern_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")]
    both = [f.select(*names) for f in found]
    return both[0] if len(both) == 1 else both[0].unionByName(both[1])


def _literals(rows: DataFrame, col: str, patterns: PatternSet, keep: list[str], config: ScanConfig, spread: int | None) -> DataFrame:
    parts = chunks(rows, col, config.chunk_bytes, max(config.overlap, patterns.max_pattern_len - 1))
    parts = parts.repartition(spread) if spread else parts
    hits = scan_overlapping(parts, col, patterns, [*keep, "_row", "chunk_start", "nominal_end"], replace(config, max_matches=NO_LIMIT))
    moved = hits.withColumns({"start": F.col("start") + F.col("chunk_start"), "end": F.col("end") + F.col("chunk_start")})
    return moved.where("start < nominal_end").drop("chunk_start", "nominal_end")


def _regexes(rows: DataFrame, col: str, patterns: PatternSet, keep: list[str], config: ScanConfig, spread: int | None, longest: int) -> DataFrame:
    before, size = 1, max(config.chunk_bytes, longest)  # a byte ahead for looks behind, one more behind for those ahead
    parts = chunks(rows, col, size, max(config.overlap, longest) + 1, before)
    parts = parts.repartition(spread) if spread else parts
    names = [*[F.col(f"`{c}`") for c in keep], "_row"]
    raw = parts.select(*names, "chunk_start", (F.col("nominal_end") - F.col("chunk_start")).alias("_size"), "_whole", F.col(f"`{col}`").alias("_hay"))
    keys = [*keep, "_row", "pattern_id"]
    kept = greedy.pick(chunk_rows(raw, [*keep, "_row"], patterns, size, longest), keys, longest, size)
    counts = kept.groupBy("_row").agg(F.sum(F.size("_hits")).alias("_n"))
    over = counts.where(F.col("_n") >= config.max_matches).select(overflow("_n").alias("_row"))
    checked = kept.join(F.broadcast(over), "_row", "left_anti")  # no row of it comes so far
    return checked.select(*[F.col(f"`{c}`") for c in [*keep, "pattern_id"]], F.inline(F.transform("_hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))))


def shortest_by_start(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of hits with one pattern and start, the one with the smallest end."""
    return hits.groupBy(*keys, "pattern_id", "start").agg(F.min("end").alias("end"))


def leftmost_longest(hits: DataFrame, keys: list[str], longest: int | None = None) -> DataFrame:
    """Overlapping literal hits reduced to the leftmost-longest ones of each source; unless ``longest`` bounds their bytes, the longest is looked for first."""
    if longest is None:
        longest = hits.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1
    found = greedy.leftmost_longest(hits, keys, longest)
    return found.withColumns({c: F.col(c).cast(hits.schema[c].dataType) for c in ("pattern_id", "start", "end")})
