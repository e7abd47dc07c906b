"""Which of many regexes occur: one pass over literals that they need names those worth running, and where.

The literals are looked for in a batch of haystacks at once, by the hashes of
``table``. A regex of bounded length then runs only around the places where a
literal that it needs was found, if these are few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PatternCompilationFailed
from ..plans.factors import required
from ..plans.patterns import PatternSet
from .arrow import ROWS, as_one, compiled
from .table import candidates, class_of, key_bits, keys_of, prefix_bits, rolled

#: Bits, as a power of two, of the bitmaps of needed literals.
BITS = 16
#: Places up to which a regex of bounded length is tried around each, and bytes that it may have.
PLACES, NEAR = 24, 64

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Index:
    """``raws``: the needed literals; ``stands``: of each the patterns that it stands for; ``keys`` and ``own``: their hashes, in order, and which it is."""

    raws: list[bytes]
    stands: list[tuple[int, ...]]
    always: tuple[int, ...]
    plain: frozenset[int]
    lengths: dict[int, list[int]]
    maps: tuple[np.ndarray, np.ndarray]
    keys: np.ndarray
    own: np.ndarray


@lru_cache(maxsize=16)
def index(patterns: PatternSet) -> Index:
    """Of a set that folds case all literals are folded: those of regexes are then found too often, never too seldom."""
    wanted: dict[bytes, set[int]] = {}
    always = []
    low = bytes.lower if patterns.case_insensitive else bytes
    for i, raw in patterns.literals:
        wanted.setdefault(low(raw), set()).add(i)
    for r in patterns.regexes:
        needed = required(patterns._parsed[r.pattern_id])
        if needed is None:
            always.append(r.pattern_id)
        for raw in needed or ():
            wanted.setdefault(low(raw), set()).add(r.pattern_id)
    raws = sorted(wanted)
    maps, keys, lengths = np.zeros((2, 1 << BITS), bool), np.zeros(len(raws), np.uint64), {}
    for k, raw in enumerate(raws):
        c = class_of(len(raw))
        h = rolled(np.frombuffer(raw, np.uint8), [c])[c]
        keys[k] = keys_of(h[:1], h[-1:], len(raw))[0]
        maps[0, prefix_bits(h[:1], c, BITS)] = True
        lengths.setdefault(c, set()).add(len(raw))
    maps[1, key_bits(keys, BITS)] = True
    order = np.argsort(keys)
    if len(np.unique(keys)) < len(keys):
        raise PatternCompilationFailed("two literals of the set share a hash")
    return Index(raws, [tuple(sorted(wanted[r])) for r in raws], tuple(always), frozenset(i for i, _ in patterns.literals), {c: sorted(v) for c, v in lengths.items()}, tuple(np.packbits(maps, axis=1)), keys[order], order)


def places(x: np.ndarray, bounds: np.ndarray, own: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(haystack, needed literal, place in the haystack) by haystack and literal; ``x`` is folded as the literals are."""
    rows, which, at = [], [], []
    classes = sorted(own.lengths)
    for n, starts, keys in candidates(x, classes, own.lengths, own.maps, BITS) if own.raws else ():
        k = np.minimum(np.searchsorted(own.keys, keys.view(np.uint64)), len(own.keys) - 1)
        row = np.searchsorted(bounds, starts, "right") - 1
        good = (own.keys[k] == keys.view(np.uint64)) & (starts + n <= bounds[row + 1])
        rows.append(row[good])
        which.append(own.own[k[good]])
        at.append((starts - bounds[row])[good])
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none
    row, literal, place = (np.concatenate(v) for v in (rows, which, at))
    order = np.lexsort((place, literal, row))
    return row[order], literal[order], place[order]


def around(regex: re.Pattern, data: bytes, spots: list[tuple[int, int]], most: int) -> bool:
    """Whether a match of ``most`` bytes at most holds one of ``spots`` (place, bytes)."""
    for place, n in spots:
        end = place + most + 1  # a byte more, for a look ahead
        if m := regex.search(data, max(0, place + n - most), end):
            # one that ends where these bytes do may not see what comes next
            return m.end() < end or end >= len(data) or regex.search(data) is not None
    return False


def flags_of(values: list[bytes | None], data: pa.Buffer, bounds: np.ndarray, patterns: PatternSet) -> np.ndarray:
    """A row of flags for each haystack."""
    own, regexes, most = index(patterns), dict(compiled(patterns)[2]), {r.pattern_id: r.most for r in patterns.regexes}
    flags = np.zeros((len(values), len(patterns)), bool)
    x = np.frombuffer(data, np.uint8)
    row, literal, place = places(_LOWER[x] if patterns.case_insensitive else x, bounds, own)
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (literal[1:] != literal[:-1])])[: len(row)])
    named: list[dict[int, list[tuple[int, int]]]] = [{} for _ in values]
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(row)], strict=False):
        r, k = int(row[a]), int(literal[a])
        n, found = len(own.raws[k]), named[r]
        for i in own.stands[k]:
            if i in own.plain:
                flags[r, i] = True
            else:
                spots = found.setdefault(i, [])
                if len(spots) <= PLACES:
                    spots += [(p, n) for p in place[a : min(b, a + PLACES + 1)].tolist()]
    for r, value in enumerate(values):
        if value is None:
            continue
        for i in own.always:
            flags[r, i] = regexes[i].search(value) is not None
        for i, spots in named[r].items():
            bounded = most[i] is not None and most[i] <= NEAR and len(spots) <= PLACES
            flags[r, i] = around(regexes[i], value, spots, most[i]) if bounded else regexes[i].search(value) is not None
    return flags


def named(data: bytes, patterns: PatternSet) -> set[int]:
    """Patterns of which a needed literal is in ``data``, or of which none is known: of the set's literals those that occur, of its regexes a superset."""
    own = index(patterns)
    x = np.frombuffer(data, np.uint8)
    literal = places(_LOWER[x] if patterns.case_insensitive else x, np.array([0, len(data)]), own)[1]
    return set(own.always).union(*[own.stands[k] for k in np.unique(literal).tolist()])


def flags_indexed(df: DataFrame, col: str, patterns: PatternSet, into: str = "flags") -> DataFrame:
    """``df`` with array<boolean> by pattern id: which occur anywhere; null for a null haystack.

    A regex runs on a haystack only if the haystack has a literal that each of
    its matches contains, or if no such literal is known; one of bounded length
    only around such literals, if they are few.
    """
    keep = [c for c in df.columns if c != into]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(into, T.ArrayType(T.BooleanType()))])
    n = len(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                column = part.column(part.num_columns - 1)
                flags = flags_of(column.to_pylist(), *as_one(column), patterns)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * n)
                lists = pa.ListArray.from_arrays(ends, pa.array(flags.ravel()), mask=column.is_null())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{col}`").cast("binary").alias("_hay")).mapInArrow(run, schema)
