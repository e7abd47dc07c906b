"""Matching events by windows of event time: tumbling, sliding and sessions, with late rows left out and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import any_match
from ..plans.patterns import PatternSet

_DEDUP = "dedupeWithinWatermark"


def window_of(time: str, length: str | None = None, slide: str | None = None, gap: str | None = None) -> Column:
    """Windows of ``length`` (every ``slide``), or sessions that end after ``gap`` without an event."""
    if (length is None) == (gap is None):
        raise ValueError("either a length or a gap")
    return F.session_window(time, gap) if gap else F.window(time, length, slide) if slide else F.window(time, length)


def matches_by_window(events: DataFrame, col: str, patterns: PatternSet, time: str, ident: str, late: str, keys: list[str] | None = None, length: str | None = None, slide: str | None = None, gap: str | None = None) -> DataFrame:
    """``keys``, window_start, window_end, n_events: events in which some pattern matches, by window and ``keys``.

    The events of a stream (or table) are told apart by ``ident``: one that
    comes again counts once. Those that come later than ``late`` behind the
    latest matching event are left out, before they meet a window, row by row, so
    ``late_rows`` counts them. A session's state is merged by Spark. A window
    is given once the watermark has passed its end.
    """
    keys = keys or []
    rows = any_match(events.select(ident, time, col, *keys), col, patterns).withWatermark(time, late)
    once = rows.select(ident, time, *keys).dropDuplicatesWithinWatermark([ident]) if events.isStreaming else rows.dropDuplicates([ident])
    own = window_of(time, length, slide, gap).alias("window")
    counted = once.groupBy(*keys, own).agg(F.count(F.lit(1)).alias("n_events"))
    return counted.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_events")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query of ``matches_by_window`` left out so far because they came too late, of the progress that Spark holds."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators if s.operatorName == _DEDUP)
