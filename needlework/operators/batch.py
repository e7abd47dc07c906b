"""Batches: planning, coalescing into one buffer, mapping hits back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.planner import ScanConfig
from ..types import MATCH


def plan_batches(sizes: list[tuple[object, int]], config: ScanConfig = ScanConfig()) -> list[list]:
    """Greedy batches of (id, bytes) within the limits on inputs and bytes, the largest first if ``sort_by_size``."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i][1]) if config.sort_by_size else range(len(sizes))
    out: list[list] = []
    total = 0
    for i in order:
        key, n = sizes[i]
        if not out or len(out[-1]) >= config.batch_inputs or total + n > config.batch_bytes:
            out.append([])
            total = 0
        out[-1].append(key)
        total += n
    return out


#: Rows whose ids give the ranges in which a buffer is summed up, and how many ranges.
SAMPLE, RANGES = 4096, 256


def _range_of(slim: DataFrame) -> Column:
    """The number of the range in which an id lies: of ``RANGES`` about equal ones, by a bounded sample of ids."""
    known = slim.select("id", F.xxhash64("id").alias("hash")).where("id is not null")
    # about four times as many by a bound of the hash, so that tasks don't send the driver a sample each
    few = known.where(F.col("hash") / float(1 << 63) < 8 * SAMPLE / max(1, known.count()) - 1)
    ids = sorted(r["id"] for r in few.orderBy("hash").limit(SAMPLE).collect())
    cuts = sorted({ids[len(ids) * k // RANGES] for k in range(1, RANGES)}) if ids else []
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda c: c <= F.col("id"))), F.lit(0)) if cuts else F.lit(0)


def fill(runs: list[tuple[int, int]], config: ScanConfig = ScanConfig()) -> list[tuple[int, int, int, int, int, int]]:
    """The greedy plan of items given as runs (bytes, how many of that size), in closed form for each run.

    (bytes, batch, place, first, batch of the rest, items of a batch of the
    rest): the first ``first`` items go on at ``place`` of ``batch``, the others
    fill batches of their own one after the other.
    """
    out, batch, held, total = [], -1, config.batch_inputs, 0
    for n, count in runs:
        room = config.batch_inputs - held
        if n and batch >= 0:
            room = min(room, max(0, config.batch_bytes - total) // n)
        elif total > config.batch_bytes:
            room = 0
        first = min(count, max(0, room))
        each = max(1, min(config.batch_inputs, config.batch_bytes // n) if n else config.batch_inputs)
        out.append((n, max(batch, 0), held, first, batch + 1, each))
        left = count - first
        held, total = held + first, total + first * n
        if left:
            batch += -(-left // each)
            held = left - (-(-left // each) - 1) * each
            total = held * n
    return out


def planned_whole(df: DataFrame, id_col: str, col: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """(id, batch, place): the greedy plan of the whole table, the largest first, of equal sizes by ascending id (nulls first).

    The plan of ``plan_batches`` without a task that has all items: they are
    counted by size, the runs of equal sizes are filled in on the driver (a row
    for each size that occurs), and each item's rank among those of its size
    says where in the run it lies. Ranks are sums of counts by size and range
    of ids, and places in these, so a size that many items share isn't one task.
    """
    if not config.sort_by_size:
        raise ValueError("runs of equal sizes need the order by size")
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(col), F.lit(0)).cast("long").alias("n"))
    ranged = slim.withColumn("_range", F.when(F.col("id").isNull(), -1).otherwise(_range_of(slim)))
    counts = ranged.groupBy("n", "_range").agg(F.count(F.lit(1)).alias("_c"))
    runs = sorted(counts.groupBy("n").agg(F.sum("_c").alias("c")).toLocalIterator(), key=lambda r: -r["n"])
    schema = "n long, _batch long, _place long, _first long, _next long, _each long"
    plan = df.sparkSession.createDataFrame(fill([(r["n"], r["c"]) for r in runs], config), schema)
    ahead = W.partitionBy("n").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = counts.withColumn("_from", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).drop("_c").join(plan, "n")
    inside = F.row_number().over(W.partitionBy("n", "_range").orderBy("id")) - 1
    placed = ranged.withColumn("_inside", inside).join(starts, ["n", "_range"]).withColumn("_rank", F.col("_from") + F.col("_inside"))
    early = F.col("_rank") < F.col("_first")
    rest = F.col("_rank") - F.col("_first")
    batch = F.when(early, F.col("_batch")).otherwise(F.col("_next") + F.expr("(_rank - _first) div _each"))
    place = F.when(early, F.col("_place") + F.col("_rank")).otherwise(F.pmod(rest, F.col("_each")))
    return placed.select("id", batch.cast("int").alias("batch"), place.cast("int").alias("place"))


def planned_batches(df: DataFrame, id_col: str, col: str, config: ScanConfig = ScanConfig(), group: Column | None = None) -> DataFrame:
    """(id, group, batch, place): the greedy plan, made in each ``group`` (a long, of the rows of ``df``) by itself.

    Only ids and sizes are shuffled. Without groups the plan is the sequential
    one, which one task makes: ``planned_whole`` deals a whole table out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    own = (F.lit(0) if group is None else group).cast("long")
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(col), F.lit(0)).cast("long").alias("n"), own.alias("group"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        plan = plan_batches(list(zip(pdf["id"], pdf["n"], strict=True)), config)
        rows = [(i, int(key[0]), b, p) for b, ids in enumerate(plan) for p, i in enumerate(ids)]
        return pd.DataFrame(rows, columns=["id", "group", "batch", "place"])

    return slim.groupBy("group").applyInPandas(run, f"id {kind}, group bigint, batch int, place int")


def coalesce_map(df: DataFrame, id_col: str, col: str, batch: list[str] | None = None, limit: int = 1 << 32) -> DataFrame:
    """(batch columns, id, offset, length): where each item lies in the buffer of its batch, by ascending id.

    Without ``batch`` all items are one buffer. A buffer of ``limit`` bytes or
    more fails the query. Its
    offsets are running sums in two levels: of ranges of ids, and of the items
    of a range, so that no task has all of them.
    """
    size = F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
    slim = df.select(*(batch or []), F.col(id_col).alias("id"), size.alias("length"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    if batch:
        offsets = slim.withColumn("offset", before(W.partitionBy(*batch).orderBy("id"), "length"))
    else:
        ranged = slim.withColumn("_range", F.when(F.col("id").isNull(), -1).otherwise(_range_of(slim)))
        sums = ranged.groupBy("_range").agg(F.sum("length").alias("_sum"))  # a row for each range
        starts = sums.select("_range", before(W.orderBy("_range"), "_sum").alias("_start"))
        joined = ranged.join(F.broadcast(starts), "_range")
        offsets = joined.withColumn("offset", F.col("_start") + before(W.partitionBy("_range").orderBy("id"), "length"))
    too_large = F.raise_error(F.lit(f"InputTooLarge: a buffer of {limit} bytes or more")).cast("long")
    return offsets.select(*(batch or []), "id", F.when(F.col("offset") + F.col("length") < limit, F.col("offset")).otherwise(too_large).alias("offset"), "length")


def decoalesce(hits: DataFrame, offsets: DataFrame, batch: list[str] | None = None, bucket: int = 1 << 20) -> DataFrame:
    """Hits (pattern_id, start, end) in a buffer as (id, pattern_id, start, end) in their items; those that span two are dropped.

    The range join is an equi-join on buckets of the buffer: an item is in each
    bucket that it touches, a hit in that of its start.
    """
    batch = batch or []
    last = F.greatest(F.col("offset"), F.col("offset") + F.col("length") - 1)
    items = offsets.withColumn("_b", F.explode(F.sequence(F.floor(F.col("offset") / bucket), F.floor(last / bucket))))
    keyed = hits.withColumn("_b", F.floor(F.col("start") / bucket))
    joined = keyed.join(items, [*batch, "_b"]).where("start >= offset and end <= offset + length")
    return joined.select(*batch, "id", "pattern_id", (F.col("start") - F.col("offset")).cast("int").alias("start"), (F.col("end") - F.col("offset")).cast("int").alias("end"))


def tagged_to_nested(hits: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """One row per source with the array of its matches by (start, pattern_id, end), empty if it has none."""
    found = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "pattern_id", "end"))).alias("_m"))
    joined = sources.select(*keys).join(found, keys, "left")
    own = F.transform(F.coalesce("_m", F.array().cast("array<struct<start:int,pattern_id:int,end:int>>")), lambda m: F.struct(m["pattern_id"].alias("pattern_id"), m["start"].alias("start"), m["end"].alias("end")))
    return joined.select(*keys, own.cast(f"array<{MATCH}>").alias("matches"))
