"""Scans: DataFrame in, one row per match (or per source) out.

Counts, tests, flags and first matches are built-in expressions; rows of matches
come from Arrow batches or, in the native strategy, from built-in functions.

All are lazy plans over the given rows: no shuffle, no unique identifier
needed, the table is read once. A null haystack has no match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import columns as C
from ..plans.patterns import HotSwapPatternSet, PatternSet
from ..plans.planner import MAP_PATTERNS, NATIVE, ScanConfig, sieve, strategy
from ..types import MATCHES, PATTERN_SCHEMA
from .arrow import any_arrow, count_arrow, first_arrow, matches_arrow, nested_rows, scan_rows, total_rows

#: Bytes of a pattern table up to which a join broadcasts it.
BROADCAST_BYTES = 8 << 20
#: Literals up to which a test looks for each by itself.
FEW = 8
#: A limit on matches that no haystack reaches.
NO_LIMIT = 1 << 62


class Scanner(Protocol):
    """What can scan: for ``df.transform`` and for users' own engines."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def is_binary(df: DataFrame, col: str) -> bool:
    return isinstance(df.select(col).schema[0].dataType, T.BinaryType)


def pattern_table(df_or_spark, patterns: PatternSet) -> DataFrame:
    """The set as a table (pattern_id, kind, literal, regex, name)."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    rows = [(p.pattern_id, p.kind, None if p.literal is None else bytearray(p.literal), p.regex, p.name) for p in patterns.patterns]
    return spark.createDataFrame(rows, PATTERN_SCHEMA)


def _keys(df: DataFrame, patterns: PatternSet, every: bool) -> DataFrame:
    """(key, pattern_id) of the literals, to be broadcast if they are no more than ``BROADCAST_BYTES``."""
    rows = [(k, i) for k, ids in patterns.keys.items() for i in (ids if every else ids[:1])]
    table = df.sparkSession.createDataFrame(rows, "_key string, _pattern int")
    return F.broadcast(table) if sum(len(k) + 16 for k, _ in rows) <= BROADCAST_BYTES else table


def _names(df: DataFrame, keep: list[str] | None) -> list[Column]:
    return [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]


def _kept(df: DataFrame, col: str, keep: list[str] | None) -> list[str]:
    keep = [c for c in df.columns if c != col] if keep is None else keep
    return _kept_names(keep)


def _kept_names(keep: list[str]) -> list[str]:
    if clash := {"pattern_id", "start", "end"} & set(keep):
        raise ValueError(f"the result has columns of these names already: {sorted(clash)}")
    return keep


def _any_of(c: Column, patterns: PatternSet) -> Column:
    """Whether any of a few literals is in a binary column, each looked for by itself."""
    tests = [F.contains(c, F.lit(bytearray(k.encode("latin-1")))) for k in patterns.keys]
    return reduce(Column.__or__, tests)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if fewer than half of them would have rows, as with one small file of one row group.

    For tables as they are read: rows by split are counted from the files'
    footers, and only if there are few splits. Of a plan with a shuffle,
    counting would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() > 4 * cores:
        return df
    full = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).count()
    return df.repartition(cores) if full * 2 <= cores else df


def overflow(n: Column | str) -> Column:
    """An error that says so."""
    return F.raise_error(F.concat(F.lit("MatchBufferOverflow: "), F.col(n).cast("string") if isinstance(n, str) else n.cast("string"))).cast("long")


def limited(rows: DataFrame, col: str, binary: bool, hits: Callable[[DataFrame], DataFrame], patterns: PatternSet, limit: int) -> DataFrame:
    """``hits(rows)`` without _row, which tells haystacks apart, or an error if one has ``limit`` hits or more.

    A haystack has no more hits than bytes times ids; only those that could
    have too many are scanned a second time and counted, by _row. What is
    broadcast has no row, as one of it is an error.
    """
    size = F.octet_length(F.col(f"`{col}`")).cast("long")
    large = rows.where(size * len(patterns.literals) >= limit)
    counts = hits(large).groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    over = counts.where(F.col("_n") >= limit).select(overflow("_n").alias("_row"))
    return hits(rows).join(F.broadcast(over), "_row", "left_anti").drop("_row")


def _hay(rows: DataFrame, patterns: PatternSet, config: ScanConfig) -> DataFrame:
    """``rows`` for Python: those that the sieve leaves, the haystack as binary."""
    if sieve(patterns, config):
        rows = rows.where(_any_of(F.col("_hay").cast("binary"), patterns))
    return rows.withColumn("_hay", F.col("_hay").cast("binary"))


def nested(df: DataFrame, col: str, patterns: PatternSet, config: ScanConfig = ScanConfig(), into: str = "matches") -> DataFrame:
    """``df`` with an array of (pattern_id, start, end) by (start, pattern_id, end); empty for a null haystack.

    ``native`` holds for ``MAP_PATTERNS`` literals at most.
    """
    binary = is_binary(df, col)
    if config.strategy == NATIVE and strategy(patterns, config, "nested") == NATIVE:
        if len(patterns.keys) > MAP_PATTERNS:
            raise ValueError(f"arrays of matches are native for {MAP_PATTERNS} literals at most")
        found = C.matches(F.col(col), patterns, binary)
    else:
        found = matches_arrow(F.col(col).cast("binary"), patterns)
    return df.withColumn(into, F.coalesce(found, F.array().cast(MATCHES)))


def scan(df: DataFrame, col: str, patterns: PatternSet, keep: list[str] | None = None, config: ScanConfig = ScanConfig(), max_matches: int | None = None, first_n: int | None = None) -> DataFrame:
    """One row per match: the columns ``keep`` (default: all but ``col``), pattern_id, start, end.

    Literals: at the leftmost start the longest, of duplicates the lowest id.
    Regexes: each by itself, leftmost-first, without overlaps of its own.
    Rows of matches are made in Arrow batches unless the native strategy is
    asked for. ``max_matches`` (by default that of ``config``) fails the query
    if a row has that many or more; ``first_n`` stops after so many of a row.
    """
    keep = _kept(df, col, keep)
    rows = df.select(*_names(df, keep), F.col(col).alias("_hay"))
    if config.compat and (max_matches is not None or first_n is not None):
        raise ValueError("limits are for the leftmost-longest rule")
    limit = config.max_matches if max_matches is None else max_matches
    if strategy(patterns, config, "scan") != NATIVE:
        return scan_rows(_hay(rows, patterns, config), keep, patterns, compat=config.compat, max_matches=limit, first_n=first_n)
    if len(patterns.keys) > MAP_PATTERNS:
        if first_n is not None:
            raise ValueError(f"first matches are native for {MAP_PATTERNS} literals at most")
        return _scan_joined(rows, keep, patterns, is_binary(df, col), limit)
    found = nested(rows, "_hay", patterns, config, "_found")
    own = F.col("_found") if first_n is None else F.slice("_found", 1, first_n)
    own = F.when(F.size(own) >= limit, F.when(overflow(F.size(own)).isNull(), own)).otherwise(own)
    return found.select(*_names(df, keep), F.inline(own))


def scan_totals(df: DataFrame, col: str, patterns: PatternSet, keep: list[str] | None = None, config: ScanConfig = ScanConfig(), places: bool = True) -> DataFrame:
    """For each row and pattern that it has: ``keep``, pattern_id, n_matches, n_bytes and, with ``places``, least_start, largest_end.

    What an aggregate over matches needs of them, made where they are found, so
    that a row leaves Python for each pattern, not for each match. Without
    ``places`` matches are counted by their texts alone, which is faster.
    """
    keep = [c for c in df.columns if c != col] if keep is None else keep
    if clash := {"pattern_id", "n_matches", "n_bytes", "least_start", "largest_end"} & set(keep):
        raise ValueError(f"the result has columns of these names already: {sorted(clash)}")
    rows = df.select(*_names(df, keep), F.col(col).alias("_hay"))
    return total_rows(_hay(rows, patterns, config), keep, patterns, places)


def _scan_joined(rows: DataFrame, keep: list[str], patterns: PatternSet, binary: bool, limit: int = NO_LIMIT) -> DataFrame:
    """Ids by a broadcast join on the matched text."""
    view = C.byte_view("_hay", binary)
    kinds = "array<struct<_text:string,_end:bigint,_id:int>>"

    def numbered(pattern_id: int | None) -> Callable[[Column], Column]:
        return lambda h: F.struct(h["text"].alias("text"), h["end"].alias("end"), F.lit(pattern_id).cast("int").alias("id"))

    def found(v: Column) -> Column:
        parts = [F.transform(C.literal_hits(v, patterns), numbered(None))]
        parts += [F.transform(C.regex_hits(v, r.rendered), numbered(r.pattern_id)) for r in patterns.regexes]
        return (F.concat(*parts) if len(parts) > 1 else parts[0]).cast(kinds)

    def checked(own: Column) -> Column:
        return F.when(F.size(own) >= limit, F.when(overflow(F.size(own)).isNull(), own)).otherwise(own)

    hits = rows.select(*_names(rows, keep), F.inline(C.let(C.let(view, found), checked)))
    key = F.when(F.col("_id").isNull(), F.col("_text"))
    joined = hits.join(_keys(rows, patterns, every=False), key == F.col("_key"), "left")
    return joined.select(*_names(rows, keep), F.coalesce("_id", "_pattern").alias("pattern_id"), (F.col("_end") - F.length("_text")).cast("int").alias("start"), F.col("_end").cast("int").alias("end"))


def scan_overlapping(df: DataFrame, col: str, patterns: PatternSet, keep: list[str] | None = None, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Every occurrence of every literal (duplicates with all their ids); regexes as in ``scan``.

    Places where some literal begins come from one look-ahead; each candidate
    is then verified by a lookup (in the native strategy, a join) of the bytes
    that follow, for every length that a literal has.
    """
    keep = _kept(df, col, keep)
    rows = df.select(*_names(df, keep), F.col(col).alias("_hay"))
    if not patterns.keys:
        return scan(df, col, patterns, keep, config)
    if strategy(patterns, config, "overlapping") != NATIVE:
        return scan_rows(_hay(rows, patterns, config), keep, patterns, every=True, max_matches=config.max_matches)
    binary = is_binary(df, col)
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    hits = limited(numbered, "_hay", binary, lambda some: _overlapping_joined(some, [*keep, "_row"], patterns, binary), patterns, config.max_matches)
    return hits.unionByName(_regex_only(rows, keep, patterns, binary, config)) if patterns.regexes else hits


def _overlapping_joined(rows: DataFrame, keep: list[str], patterns: PatternSet, binary: bool) -> DataFrame:
    lengths = F.array(*[F.lit(n) for n in sorted({len(k) for k in patterns.keys})])
    begins = C.let(C.byte_view("_hay", binary), lambda v: C.overlapping_hits(v, patterns)).cast("array<struct<_start:bigint,_window:string>>")
    starts = rows.select(*_names(rows, keep), F.inline(begins))
    tried = starts.select("*", F.explode(F.filter(lengths, lambda n: n <= F.length("_window"))).alias("_n"))
    keyed = tried.withColumn("_key", C.fold(F.substring(F.col("_window"), F.lit(1), F.col("_n")), patterns))
    return keyed.join(_keys(rows, patterns, every=True), "_key").select(*_names(rows, keep), F.col("_pattern").alias("pattern_id"), F.col("_start").cast("int").alias("start"), (F.col("_start") + F.col("_n")).cast("int").alias("end"))


def _regex_only(rows: DataFrame, keep: list[str], patterns: PatternSet, binary: bool, config: ScanConfig) -> DataFrame:
    plain = {i for i, _ in patterns.literals}
    found = nested(rows, "_hay", patterns, config, "_found")
    return found.select(*_names(rows, keep), F.inline(F.filter("_found", lambda m: ~m["pattern_id"].isin(*plain)))) if plain else found.select(*_names(rows, keep), F.inline("_found"))


def max_per_source(hits: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``hits``, or an error if a source has ``limit`` or more of them."""
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    over = counts.where(F.col("_n") >= limit).withColumn("_bad", F.raise_error(F.concat(F.lit("MatchBufferOverflow: "), F.col("_n").cast("string"))))
    return hits.join(over.select(*keys, "_bad"), keys, "left").where("_bad is null").drop("_bad")


def scan_count(df: DataFrame, col: str, patterns: PatternSet, into: str = "n_matches", config: ScanConfig = ScanConfig()) -> DataFrame:
    """``df`` with the number of matches, which aren't made; null for a null haystack."""
    if strategy(patterns, config, "count") == NATIVE:
        return df.withColumn(into, C.match_count(F.col(col), patterns, is_binary(df, col)))
    return df.withColumn(into, count_arrow(F.col(col).cast("binary"), patterns))


def any_match(df: DataFrame, col: str, patterns: PatternSet, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The rows of ``df`` in which some pattern matches."""
    return df.where(_contains(df, col, patterns, config))


def no_match(df: DataFrame, col: str, patterns: PatternSet, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The rows of ``df`` in which none does, null haystacks among them."""
    return df.where(~F.coalesce(_contains(df, col, patterns, config), F.lit(False)))


def _contains(df: DataFrame, col: str, patterns: PatternSet, config: ScanConfig) -> Column:
    if strategy(patterns, config, "any") == NATIVE:
        if not patterns.regexes and not patterns.case_insensitive and 0 < len(patterns.keys) <= FEW:
            return _any_of(F.col(col).cast("binary"), patterns)
        return C.contains_any(F.col(col), patterns, is_binary(df, col))
    return any_arrow(F.col(col).cast("binary"), patterns)


def pattern_flags(df: DataFrame, col: str, patterns: PatternSet, into: str = "flags") -> DataFrame:
    """``df`` with array<boolean> by pattern id: which occur anywhere."""
    return df.withColumn(into, C.pattern_flags(F.col(col), patterns, is_binary(df, col)))


def first_match(df: DataFrame, col: str, patterns: PatternSet, into: str = "first_match") -> DataFrame:
    """``df`` with the first match, or null."""
    if strategy(patterns, operator="first") == NATIVE:
        return df.withColumn(into, C.first_match(F.col(col), patterns, is_binary(df, col)))
    return df.withColumn(into, first_arrow(F.col(col).cast("binary"), patterns))


def scan_nested(df: DataFrame, col: str, patterns: PatternSet, config: ScanConfig = ScanConfig()) -> DataFrame:
    """``df`` without the haystack, with the array of its matches."""
    if strategy(patterns, config, "nested") != NATIVE:
        others = [c for c in df.columns if c != col]
        return nested_rows(df.select(*_names(df, others), F.col(col).cast("binary").alias("_hay")), "_hay", patterns, "matches", config.max_matches)
    found = nested(df, col, patterns, config, "matches").drop(col)
    n = F.size("matches")
    return found.withColumn("matches", F.when(n >= config.max_matches, F.when(overflow(n).isNull(), F.col("matches"))).otherwise(F.col("matches")))


def scanner(col: str, patterns: PatternSet | HotSwapPatternSet, how: Callable[..., DataFrame] = scan, **options) -> Scanner:
    """For ``df.transform``; of a hot-swap set the patterns of the moment."""

    def run(df: DataFrame) -> DataFrame:
        own = patterns.current() if isinstance(patterns, HotSwapPatternSet) else patterns
        return how(df, col, own, **options)

    return run


def register_udtf(spark, name: str, patterns: PatternSet) -> None:
    """A table function ``name(binary)`` for SQL: (pattern_id, start, end)."""
    from .arrow import scan_bytes

    class ScanBytes:
        def eval(self, data):
            if data is not None:
                raw = data.encode("utf-8") if isinstance(data, str) else bytes(data)
                for start, pattern_id, end in scan_bytes(raw, patterns):
                    yield pattern_id, start, end

    spark.udtf.register(name, F.udtf(ScanBytes, returnType="pattern_id int, start int, end int", useArrow=True))


@dataclass
class _Analyzed(AnalyzeResult):
    """What ``analyze`` hands to the tasks."""

    patterns: PatternSet | None = None
    hay: int = 0


class ScanTable:
    """``select * from scan(table(docs), 'text', array('the', 'and'))``: the other columns, pattern_id, start, end.

    A fourth argument is an array of regexes; ids go on from the literals'. The
    schema is made from the table's when the query is analysed, where a bad
    pattern or column is an error. Rows travel in Arrow batches; Spark splits
    the table as it is, unless the query says ``partition by``.
    """

    def __init__(self, analyzed: _Analyzed):
        self.patterns, self.hay = analyzed.patterns, analyzed.hay

    @staticmethod
    def analyze(rows: AnalyzeArgument, col: AnalyzeArgument, literals: AnalyzeArgument, regexes: AnalyzeArgument | None = None) -> _Analyzed:
        if not rows.isTable:
            raise ValueError("the first argument is a table: scan(table(docs), 'text', array('the'))")
        fields = rows.dataType.fields
        names = [f.name for f in fields]
        if col.value not in names:
            raise ValueError(f"the table has no column {col.value}")
        if not isinstance(fields[names.index(col.value)].dataType, T.StringType | T.BinaryType):
            raise ValueError(f"{col.value} is neither text nor binary")
        others = [f for f in fields if f.name != col.value]
        _kept_names([f.name for f in others])
        own = PatternSet.builder()
        for text in literals.value or []:
            own.literal(text)
        for text in (regexes.value if regexes is not None else None) or []:
            own.regex(text)
        schema = T.StructType([*others, *[T.StructField(c, T.IntegerType()) for c in ("pattern_id", "start", "end")]])
        return _Analyzed(schema=schema, patterns=own.build(), hay=names.index(col.value))

    def eval(self, row, col, literals, regexes=None):
        from .arrow import scan_bytes

        data = row[self.hay]
        if data is not None:
            others = [v for k, v in enumerate(row) if k != self.hay]
            for start, pattern_id, end in scan_bytes(data.encode("utf-8") if isinstance(data, str) else bytes(data), self.patterns):
                yield (*others, pattern_id, start, end)


def register_scan_table(spark, name: str = "scan") -> None:
    """``ScanTable`` as a table function for SQL."""
    spark.udtf.register(name, F.udtf(ScanTable, useArrow=True))
