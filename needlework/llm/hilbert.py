"""Sharding along a Hilbert curve, in built-in functions only.

Metadata columns are quantised at their exact quantiles, the cell's index on the
Hilbert curve orders the rows, and equal runs of that order are the shards.
Neighbours on the curve are neighbours in every dimension, so a shard (and a
file of it) covers a small range of each and readers can skip it by min/max.

The global order needs no global sort. Rows are counted by (cell, salt), the
counts are summed along the curve in two levels of bounded size, and a row's
rank is the start of its (cell, salt) plus its number there. A cell with a third
of all rows is spread over all its salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Ranges of a dimension's different values that are numbered side by side.
RANGES = 32
#: Rows that one (cell, salt) of a hot cell holds at most, about.
ROWS_A_SALT, LEAST_SALTS = 100_000, 64
_COARSE_BITS = 10


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve over ``len(coordinates)`` axes of ``bits`` bits.

    The axes are transposed as in Skilling, "Programming the Hilbert curve"
    (2004); the array of axes goes through a fold with one step per bit and axis.
    """
    n = len(coordinates)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        own, p = x[i], q - 1
        inverted = own.bitwiseAND(q) != 0
        swap = x[0].bitwiseXOR(own).bitwiseAND(p)
        return F.transform(x, lambda v, j: v.bitwiseXOR(F.when(inverted, F.when(j == 0, p).otherwise(0)).otherwise(F.when(i == 0, 0).when((j == 0) | (j == i), swap).otherwise(0))))

    axes = F.array(*[c.cast("int") for c in coordinates])
    turned = F.aggregate(steps, axes, step) if bits > 1 else axes

    def interleave(x: Column) -> Column:
        gray = [x[0]]
        for i in range(1, n):
            gray.append(gray[-1].bitwiseXOR(x[i]))
        flip = F.lit(0)
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(gray[-1].bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0))
        index = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(gray[i].bitwiseXOR(flip), b).bitwiseAND(1)
                index = index * 2 + bit
        return index

    # a one-element fold names the array, which the expression above uses often
    return F.element_at(F.transform(F.array(turned), interleave), 1)


def _number(kind: T.DataType, c: Column) -> Column:
    """A number in the order of the column's values."""
    return F.unix_timestamp(c.cast("timestamp")).cast("double") if isinstance(kind, (T.DateType, T.TimestampType)) else c.cast("double")


def quantiles(df: DataFrame, value: Column, share: list[float]) -> list:
    """The values of all rows at ``share`` of the rows that aren't null, in ascending order; all but the last if there are no more than that.

    Different values are counted and sorted in ranges. What comes to the driver
    is the size of each range and the values that are cut at.
    """
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    with Scratch(df.sparkSession) as kept:
        ranged = kept.keep(counts.repartitionByRange(RANGES, "v").withColumn("part", F.spark_partition_id()), "values")
        sizes = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("n"), F.count(F.lit(1))).collect())
        total, different = sum(r[1] for r in sizes), sum(r[2] for r in sizes)
        if different <= len(share) + 1:
            return [r["v"] for r in ranged.orderBy("part", "v").collect()][:-1]
        ranks = sorted({int(s * total) for s in share})
        before, starts = 0, []
        for part, n, _ in sizes:
            if any(before <= r < before + n for r in ranks):
                starts += [F.lit(part), F.lit(before).cast("long")]
            before += n
        upto = F.sum("n").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        placed = ranged.where(F.col("part").isin(starts[::2])).withColumn("end", upto + F.create_map(*starts)[F.col("part")])
        at = F.exists(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end")))
        return [r["v"] for r in placed.where(at).orderBy("part", "v").select("v").collect()]


def cut_points(df: DataFrame, dimensions: list[str], order: list[Column], bits: int) -> tuple[int, list[list]]:
    """Rows of ``df``, and for each dimension ascending values between which a cell of its axis lies.

    All are cut at the quantiles of all rows, strings and binaries too, whole
    and not by a prefix. Where it has few enough different values each of them
    is a cell. The rows' ``order`` is of no account.
    """
    cells = (1 << bits) - 1  # and one for nulls
    share = [k / cells for k in range(1, cells)]
    n = df.count()
    cuts: list[list] = []
    for d in dimensions:
        kind, c = df.schema[d].dataType, F.col(f"`{d}`")
        binary = isinstance(kind, (T.StringType, T.BinaryType))
        found = quantiles(df, c.cast("binary") if binary else _number(kind, c), share) if n and cells > 1 else []
        cuts.append([bytes(v) for v in found] if binary else found)
    return n, cuts


def axis(df: DataFrame, name: str, cuts: list) -> Column:
    """A column's cell: 0 for null, else 1 and the cut points below the value."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    binary = isinstance(kind, (T.StringType, T.BinaryType))
    value = c.cast("binary") if binary else _number(kind, c)
    points = F.array(*[F.lit(bytearray(x)) if binary else F.lit(float(x)) for x in cuts])
    below = F.size(F.filter(points, lambda x: x < value)) if cuts else F.lit(0)
    return F.when(c.isNull(), 0).otherwise(1 + below)


def hilbert_shards(df: DataFrame, dimensions: list[str], n_shards: int = 16, bits: int = 5, tie: list[str] | None = None) -> DataFrame:
    """``df`` with hilbert (curve index), shard (int) and slot (long, from 0 in each shard).

    Shards are runs of the curve whose row counts differ by one at most. ``tie``
    orders rows of one cell: by default all columns that can be ordered, so
    that equal rows alone are interchangeable (and they alone meet in one
    task). Nulls come first in every dimension; an empty table stays empty. A
    text of any length can be a dimension. Columns named hilbert, shard, slot
    of ``df`` are replaced, all others stay, whatever their names.
    """
    df = df.drop("hilbert", "shard", "slot")
    if not dimensions or bits * len(dimensions) > 60:
        raise ValueError("one dimension at least, and 60 bits of index at most")
    tie = tie or [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    order = [F.col(f"`{t}`") for t in tie]
    n, cuts = cut_points(df, dimensions, order, bits)
    if n == 0:
        return df.withColumns({"hilbert": F.lit(0).cast("long"), "shard": F.lit(0), "slot": F.lit(0).cast("long")})
    axes = [axis(df, d, own) for d, own in zip(dimensions, cuts, strict=True)]
    salts = max(LEAST_SALTS, n // ROWS_A_SALT)
    # whole rows as one column, so that no name can clash
    rows = df.select(F.struct("*").alias("row"), hilbert_index(axes, bits).alias("hilbert"), F.pmod(F.xxhash64(*order), F.lit(salts)).alias("salt"))

    coarse = F.shiftright("hilbert", max(0, bits * len(dimensions) - _COARSE_BITS))
    counts = rows.groupBy("hilbert", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("coarse", coarse)
    blocks = counts.groupBy("coarse").agg(F.sum("n").alias("block"))
    before = W.orderBy("coarse").rowsBetween(W.unboundedPreceding, -1)  # over 1024 rows at most
    blocks = blocks.select("coarse", F.coalesce(F.sum("block").over(before), F.lit(0)).alias("from"))
    inside = W.partitionBy("coarse").orderBy("hilbert", "salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.join(blocks, "coarse").select("hilbert", "salt", (F.col("from") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))

    number = F.row_number().over(W.partitionBy("hilbert", "salt").orderBy(*[F.col("row")[t] for t in tie]))
    ranked = rows.join(starts, ["hilbert", "salt"]).withColumn("rank", F.col("start") + number - 1)
    placed = ranked.withColumn("shard", F.expr(f"int((rank * {n_shards}L) div {n}L)"))
    return placed.select("row.*", "hilbert", "shard", (F.col("rank") - F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")).alias("slot"))


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """Parquet under ``path/shard=…``, in the curve's order; ``files`` ranges of it in all."""
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
