"""Scans for the literals of a table, however many there are.

The set is a DataFrame and stays one: nothing of it is collected but a bitmap
of bounded size and the lengths that occur. A literal's class is the largest
power of two among its length or below. A haystack's bytes are hashed once for
each class that occurs, at all places together; the bitmap tells where a
literal of the class may begin. For each of its lengths there, two hashes of
the class (at the place, and as far on as the length goes beyond it) make a key
that covers all its bytes, which a second part of the bitmap tests. What is
left is joined with the literals by key and compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EmptyPatternSet, PatternTooLarge
from ..plans.patterns import LARGEST_PATTERN
from ..sources.scratch import written
from .arrow import as_one
from .greedy import leftmost_longest

#: Odd factors of the rolling hash and of its finish.
_BASE, _SPREAD, _OTHER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASK = (1 << 64) - 1
#: Bits of a bitmap for each literal, about, and the power of two that they are at least and at most (2**26 are 8 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 26
#: Haystacks whose hits are one batch, and bytes of them that are hashed at once.
ROWS, WINDOW = 256, 1 << 20

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def class_of(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _SPREAD
    return h ^ (h >> np.uint64(29))


def rolled(data: np.ndarray, classes: list[int]) -> dict[int, np.ndarray]:
    """For each class the hashes of as many bytes from every place on: those of twice as many come from two of a half."""
    out, h, n, power = {}, data.astype(np.uint64) + np.uint64(1), 1, int(_BASE)
    while len(h):
        if n in classes:
            out[n] = h
        if n >= classes[-1] or len(h) <= n:
            break
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power & _MASK, 2 * n
    return out


def prefix_bits(h: np.ndarray, size: int, bits: int) -> np.ndarray:
    return (finish(h + np.uint64(size * int(_OTHER) & _MASK)) >> np.uint64(64 - bits)).astype(np.int64)


def keys_of(first: np.ndarray, last: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Keys of literals by the hashes of their class at the beginning and at the end."""
    return finish(finish(first) * _OTHER + finish(last) * _BASE + np.atleast_1d(np.asarray(length, np.uint64)))


def key_bits(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def keyed(patterns: DataFrame, literal_col: str, id_col: str, case_insensitive: bool) -> DataFrame:
    """_length, _key and prefix (hash of the class) of every literal, with its id and bytes; nulls are left out."""
    schema = T.StructType([T.StructField("pattern_id", patterns.schema[id_col].dataType), T.StructField("_literal", T.BinaryType()), T.StructField("_length", T.IntegerType()), T.StructField("_key", T.LongType()), T.StructField("_prefix", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = as_one(batch.column(1))
            x = np.frombuffer(data, np.uint8)
            x = _LOWER[x] if case_insensitive else x
            starts, sizes = bounds[:-1], np.diff(bounds)
            if len(sizes) and sizes.max() > LARGEST_PATTERN:
                raise PatternTooLarge(f"a literal of {sizes.max()} bytes")
            own = np.left_shift(1, np.frexp(sizes.astype(np.float64))[1] - 1)
            classes = np.unique(own).tolist()
            hashes = rolled(x, classes)
            keys, prefixes = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            for c in classes:
                at = np.flatnonzero(own == c)
                prefixes[at] = hashes[c][starts[at]]
                keys[at] = keys_of(prefixes[at], hashes[c][starts[at] + sizes[at] - c], sizes[at].astype(np.uint64))
            raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array(sizes.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(prefixes.view(np.int64))], schema.names)

    raw = F.col(f"`{literal_col}`").cast("binary")
    checked = F.when(F.octet_length(raw) > 0, raw).otherwise(F.when(F.raise_error(F.lit("EmptyPattern: a literal of the table is empty")).isNull(), raw))
    return patterns.where(raw.isNotNull()).select(F.col(f"`{id_col}`"), checked.alias("raw")).mapInArrow(run, schema)


def tested(packed: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which bits are set."""
    return (packed[bit >> 3] << (bit & 7).astype(np.uint8)) & np.uint8(128) > 0


def bitmaps(literals: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which prefixes and which keys occur, eight of ``2**bits`` bits in a byte: that much comes to the driver, however many literals there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = np.zeros((2, 1 << bits), bool)
        for batch in batches:
            length, key, prefix = (c.to_numpy() for c in batch.columns)
            maps[1, key_bits(key.view(np.uint64), bits)] = True
            sizes = np.left_shift(1, np.frexp(length.astype(np.float64))[1] - 1)
            for c in np.unique(sizes).tolist():
                maps[0, prefix_bits(prefix.view(np.uint64)[sizes == c], c, bits)] = True
        packed = np.packbits(maps, axis=1)
        for kind in (0, 1):
            words = packed[kind].view(np.int64)
            there = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), kind, np.int32)), pa.array(there.astype(np.int32)), pa.array(words[there])], ["kind", "word", "value"])

    found = literals.select("_length", "_key", "_prefix").mapInArrow(run, "kind int, word int, value long").groupBy("kind", "word").agg(F.bit_or("value").alias("value"))
    words = np.zeros((2, 1 << (bits - 6)), np.int64)
    for kind, word, value in found.toLocalIterator():
        words[kind, word] = value
    return words[0].view(np.uint8), words[1].view(np.uint8)


def candidates(whole: np.ndarray, classes: list[int], lengths: dict[int, list[int]], maps: tuple[np.ndarray, np.ndarray], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, keys) where a literal of that length may be in an array of bytes, one window of it after the other."""
    longest = max(n[-1] for n in lengths.values())
    for at in range(0, len(whole), WINDOW):
        hashes = rolled(whole[at : at + WINDOW + longest - 1], classes)
        for c, h in hashes.items():
            starts = np.flatnonzero(tested(maps[0], prefix_bits(h[:WINDOW], c, bits)))
            for n in lengths[c]:
                fit = starts[starts + (n - c) < len(h)]
                if len(fit):
                    key = keys_of(h[fit], h[fit + (n - c)], n)
                    there = tested(maps[1], key_bits(key, bits))
                    if there.any():
                        yield n, fit[there] + at, key[there].view(np.int64)


def changes(x: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """At which of ``starts`` the ``n`` bytes from there on are others than at the one before."""
    new = np.ones(len(starts), bool)
    texts = np.lib.stride_tricks.sliding_window_view(x, n)
    some = max(1, WINDOW // n)
    for k in range(1, len(starts), some):
        own = starts[k : k + some]
        new[k : k + some] = (texts[own] != texts[starts[k - 1 : k - 1 + len(own)]]).any(axis=1)
    return new


def scan_table(df: DataFrame, col: str, patterns: DataFrame, keep: list[str] | None = None, literal_col: str = "literal", id_col: str = "pattern_id", overlapping: bool = False, case_insensitive: bool = False) -> DataFrame:
    """One row per match of a table of literals: ``keep`` (default: all but ``col``), pattern_id, start, end.

    ``overlapping`` gives every occurrence of every literal, equal literals with
    all their ids; else at the leftmost start the longest stays (of equal ones
    the lowest id, which has to be an integer then) and the scan goes on at its
    end, by ``greedy.leftmost_longest``. ``case_insensitive`` is ASCII-only.

    Literals are text or binary; null ones are left out, an empty one is an
    error. A null haystack has no match; long ones are hashed a window at a
    time. Hits of a batch of haystacks meet the literals a row for each
    different literal, so a common one is no row per hit; the join is by key
    and Spark may split it where one key is hot. Runs jobs: the
    keys of the literals are written to the shared folder, the bitmaps and the
    lengths come from there. An empty table of literals is an error.
    """
    keep = [c for c in df.columns if c != col] if keep is None else keep
    if clash := {"pattern_id", "start", "end"} & set(keep):
        raise ValueError(f"the result has columns of these names already: {sorted(clash)}")
    literals = written(keyed(patterns, literal_col, id_col, case_insensitive), "literals")
    sizes = {r["_length"]: r["n"] for r in literals.groupBy("_length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length, 65,536 at most
    if not sizes:
        raise EmptyPatternSet("no literal in the table")
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * sum(sizes.values()) - 1).bit_length()))
    maps = bitmaps(literals, bits)
    lengths: dict[int, list[int]] = {}
    for n in sorted(sizes):
        lengths.setdefault(class_of(n), []).append(n)
    classes = sorted(lengths)
    shared = df.sparkSession.sparkContext.broadcast(maps)
    extra = [] if overlapping else ["_row"]  # tells haystacks apart, where their hits meet again
    fields = [T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(c, T.LongType()) for c in extra]
    place = T.StructType([*fields, T.StructField("_start", T.IntegerType())])
    schema = T.StructType([T.StructField("_length", T.IntegerType()), T.StructField("_key", T.LongType()), T.StructField("_bytes", T.BinaryType()), T.StructField("_places", T.ArrayType(place))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                data, bounds = as_one(part.column(part.num_columns - 1))
                x = np.frombuffer(data, np.uint8)
                x = _LOWER[x] if case_insensitive else x
                found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
                for n, starts, keys in candidates(x, classes, lengths, own, bits):
                    found.setdefault(n, []).append((starts, keys))
                for n, parts in found.items():
                    starts, keys = (np.concatenate([p[k] for p in parts]) for k in range(2))
                    rows = np.searchsorted(bounds, starts, "right") - 1
                    inside = starts + n <= bounds[rows + 1]  # in one haystack
                    starts, keys, rows = starts[inside], keys[inside], rows[inside]
                    if not len(starts):
                        continue
                    order = np.argsort(keys, kind="stable")
                    starts, keys, rows = starts[order], keys[order], rows[order]
                    heads = np.flatnonzero(changes(x, starts, n))  # by bytes, as keys may be shared by chance
                    take = pa.array(rows)
                    places = pa.StructArray.from_arrays([*[part.column(k).take(take) for k in range(len(keep) + len(extra))], pa.array((starts - bounds[rows]).astype(np.int32))], [*keep, *extra, "_start"])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(keys)).astype(np.int32)), places)
                    texts = pa.array([x[s : s + n].tobytes() for s in starts[heads].tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), n, np.int32)), pa.array(keys[heads]), texts, lists], schema.names)

    own = [F.monotonically_increasing_id().alias(c) for c in extra]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], *own, F.col(f"`{col}`").cast("binary").alias("_hay"))
    hits = rows.mapInArrow(run, schema)
    met = hits.join(literals.drop("_prefix"), ["_length", "_key"]).where("_bytes = _literal")
    names = [F.col(f"_place.`{c}`").alias(c) for c in keep]
    names += [F.col(f"_place.{c}").alias(c) for c in extra]
    flat = met.select("pattern_id", "_length", F.explode("_places").alias("_place")).select(*names, "pattern_id", F.col("_place._start").alias("start"), (F.col("_place._start") + F.col("_length")).alias("end"))
    if overlapping:
        return flat
    kind = patterns.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError("of equal literals the lowest id stays, so ids have to be integers")
    found = leftmost_longest(flat, [*keep, "_row"], max(sizes))
    return found.select(*[F.col(f"`{c}`") for c in keep], F.col("pattern_id").cast(kind).alias("pattern_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
