"""Hits that don't overlap, picked from left to right in haystacks of any length.

Which hits stay depends on where the one before ended, from the first byte on.
So that a long haystack isn't one task, it is cut into blocks, and each block
is summed up as a map from the place where a walk comes in to the place where
it goes out. Maps are put together, ``FAN`` neighbours at a time, until one
group of a haystack is left; then entries are handed down the same way, and
each block picks its hits by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MatchTooLong
from ..sources.scratch import written

#: Bytes of a block at least.
BLOCK = 1 << 16
#: Blocks whose maps one group puts together.
FAN = 256
HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("pattern_id", T.LongType())]))


# -- in one block ------------------------------------------------------------------
def best(start: np.ndarray, end: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each start the longest hit, then the lowest id; by start."""
    order = np.lexsort((ident, -end, start))
    start, end, ident = start[order], end[order], ident[order]
    first = np.ones(len(start), bool)
    first[1:] = start[1:] != start[:-1]
    return start[first], end[first], ident[first]


def exits(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where a walk that takes each hit goes out of the block: all chains at once, by doubled steps."""
    n = len(start)
    step = np.searchsorted(start, end)
    step = np.where(step < n, step, np.arange(n))
    while True:
        far = step[step]
        if (far == step).all():
            return end[step]
        step = far


def picked(start: np.ndarray, end: np.ndarray, entry: int) -> list[int]:
    """The hits that a walk from ``entry`` takes."""
    step = np.searchsorted(start, end).tolist()
    out, at = [], int(np.searchsorted(start, entry))
    while at < len(step):
        out.append(at)
        at = step[at]
    return out


def summary(start: np.ndarray, end: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(at, to, other): a walk that comes in at or before ``at[i]``, the first such, goes out at ``to[i]``, a later one at ``other``.

    ``last`` is the latest place to come in. ``other`` is -1 if such a walk
    meets no hit, so that it goes out where it came in.
    """
    out = exits(start, end)
    n = int(np.searchsorted(start, last, "right"))
    return start[:n], out[:n], int(out[n]) if n < len(out) else -1


def through(maps: tuple, entries: np.ndarray) -> np.ndarray:
    at, to, other = maps
    k = np.searchsorted(at, entries)
    late = entries if other < 0 else np.full(len(entries), other)
    return np.where(k < len(at), np.append(to, 0)[k], late)


def chained(maps: list[tuple]) -> tuple:
    """The maps of blocks that follow each other as one. No walk comes into the first behind the beginning of the second."""
    at, to, other = maps[0]
    values = np.append(to, other)
    for m in maps[1:]:
        values = through(m, values)
    return at, values[:-1], int(values[-1])


# -- over a table ------------------------------------------------------------------
def by_block(hits: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``keys``, _block and the hits (start, end, pattern_id) in it."""
    one = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("pattern_id").cast("long").alias("pattern_id"))
    return hits.groupBy(*keys, F.expr(f"start div {block}").alias("_block")).agg(F.collect_list(one).alias("_hits"))


def _arrays(column: pa.Array, row: int) -> tuple[np.ndarray, ...]:
    values = column[row].values
    return tuple(values.field(k).to_numpy(zero_copy_only=False) for k in range(3))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def _structs(rows: list[tuple[np.ndarray, ...]]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(r[0]) for r in rows]]).astype(np.int32)
    columns = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0) for k in range(3)]
    kinds = (pa.int64(), pa.int64(), pa.int64())
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["start", "end", "pattern_id"]))


_MAP = [T.StructField("_at", T.ArrayType(T.LongType())), T.StructField("_to", T.ArrayType(T.LongType())), T.StructField("_other", T.LongType())]


def _summed(blocks: DataFrame, keys: list[str], longest: int, block: int) -> DataFrame:
    """``blocks`` with the map of each; block 0, whose entry is known, has the hits that stay."""
    schema = T.StructType([*[blocks.schema[c] for c in [*keys, "_block", "_hits"]], *_MAP])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, maps = [], []
            for row, number in enumerate(batch.column(len(keys)).to_pylist()):
                start, end, ident = best(*_arrays(batch.column(len(keys) + 1), row))
                if (end <= start).any() or (end - start > longest).any():
                    raise MatchTooLong(f"matches have 1 to {longest} bytes here")
                maps.append(summary(start, end, number * block + longest - 1))
                if number == 0:
                    keep = picked(start, end, 0)
                    start, end, ident = start[keep], end[keep], ident[keep]
                rows.append((start, end, ident))
            arrays = [_lists([m[0] for m in maps], pa.int64()), _lists([m[1] for m in maps], pa.int64()), pa.array([m[2] for m in maps], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _structs(rows), *arrays], schema.names)

    return blocks.select(*[F.col(f"`{k}`") for k in keys], "_block", "_hits").mapInArrow(run, schema)


def _of(table: pa.Table) -> list[tuple]:
    """(place in the table, map) by block."""
    number = table.column("_block").to_numpy()
    at, to, other = (table.column(c).combine_chunks() for c in ("_at", "_to", "_other"))
    return [(k, (at[k].values.to_numpy(), to[k].values.to_numpy(), other[k].as_py())) for k in np.argsort(number).tolist()]


def _up(maps: DataFrame, keys: list[str]) -> DataFrame:
    """The maps of ``FAN`` neighbours as one."""
    schema = T.StructType([*[maps.schema[c] for c in keys], T.StructField("_block", T.LongType()), *_MAP])

    def run(table: pa.Table) -> pa.Table:
        at, to, other = chained([m for _, m in _of(table)])
        number = table.column("_block")[0].as_py() // FAN
        return pa.table([*[table.column(c).slice(0, 1) for c in keys], pa.array([number], pa.int64()), _lists([at], pa.int64()), _lists([to], pa.int64()), pa.array([other], pa.int64())], names=schema.names)

    return maps.groupBy(*keys, F.expr(f"_block div {FAN}").alias("_group")).applyInArrow(run, schema)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])


def _down(maps: DataFrame, keys: list[str], above: DataFrame | None) -> DataFrame:
    """``keys``, _block, _entry: where the walk comes into each block, from where it comes into the group of its neighbours."""
    schema = T.StructType([*[maps.schema[c] for c in keys], T.StructField("_block", T.LongType()), T.StructField("_entry", T.LongType())])
    rows = maps.withColumn("_group", F.expr(f"_block div {FAN}"))
    if above is None:
        rows = rows.withColumn("_from", F.lit(0).cast("long"))
    else:
        given = above.select(*[F.col(f"`{k}`") for k in keys], F.col("_block").alias("_group"), F.col("_entry").alias("_from"))
        rows = rows.join(given, _same(rows, given, [*keys, "_group"])).select(*[rows[c] for c in rows.columns], "_from")

    def run(table: pa.Table) -> pa.Table:
        entry, rows, entries = table.column("_from")[0].as_py(), [], []
        for k, m in _of(table):
            rows.append(k)
            entries.append(entry)
            entry = int(through(m, np.array([entry]))[0])
        table = table.take(rows)
        return pa.table([*[table.column(c) for c in [*keys, "_block"]], pa.array(entries, pa.int64())], names=schema.names)

    return rows.groupBy(*keys, "_group").applyInArrow(run, schema)


def _picked_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    schema = T.StructType([*[rows.schema[c] for c in keys], T.StructField("_hits", HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, entry in enumerate(batch.column(len(keys) + 1).to_pylist()):
                own = _arrays(batch.column(len(keys)), row)
                keep = picked(own[0], own[1], entry)
                out.append(tuple(x[keep] for x in own))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], _structs(out)], schema.names)

    return rows.select(*[F.col(f"`{k}`") for k in keys], "_hits", "_entry").mapInArrow(run, schema)


def pick(blocks: DataFrame, keys: list[str], longest: int, block: int = BLOCK) -> DataFrame:
    """``keys`` and _hits (an array) of the hits that stay, a row for each block, from the hits of each block of ``block`` bytes.

    At the leftmost start the longest stays, of these the lowest id, and the
    walk goes on at its end. ``longest`` bounds the length of a hit and is no
    more than ``block``. Runs jobs: blocks and their maps are written to the
    shared folder, a round for each factor of ``FAN`` that the longest haystack
    has of blocks; one without a second block takes none.
    """
    if longest > block:
        raise ValueError("a block has to be as long as the longest match")
    done = written(_summed(blocks, keys, longest, block), "blocks")
    first = done.where("_block = 0").select(*[F.col(f"`{k}`") for k in keys], "_hits")
    most = done.agg(F.max("_block")).first()[0] or 0
    if most == 0:
        return first
    names = [*[F.col(f"`{k}`") for k in keys], "_block", "_at", "_to", "_other"]
    all_maps, long = done.select(*names), done.where("_block > 0").select(*[F.col(f"`{k}`") for k in keys]).distinct()
    levels = [all_maps.join(long, _same(all_maps, long, keys), "left_semi")]  # a haystack of one block is done
    while most >= FAN:
        levels.append(written(_up(levels[-1], keys), "maps"))
        most //= FAN
    entries = None
    for maps in reversed(levels):
        entries = written(_down(maps, keys, entries), "entries")
    late, given = done.where("_block > 0").select(*[F.col(f"`{k}`") for k in keys], "_block", "_hits"), entries
    joined = late.join(given, _same(late, given, [*keys, "_block"])).select(*[late[c] for c in late.columns], "_entry")
    return first.unionByName(_picked_rows(joined, keys))


def unpacked(picked_rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each hit: ``keys``, pattern_id, start, end."""
    return picked_rows.select(*[F.col(f"`{k}`") for k in keys], F.inline("_hits")).select(*[F.col(f"`{k}`") for k in keys], "pattern_id", "start", "end")


def leftmost_longest(hits: DataFrame, keys: list[str], longest: int, block: int = BLOCK) -> DataFrame:
    """Overlapping hits (``keys``, pattern_id, start, end) without those that a better one to the left overlaps, by ``keys``."""
    block = max(block, longest)
    return unpacked(pick(by_block(hits, keys, block), keys, longest, block), keys)
