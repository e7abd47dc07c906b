"""As-of join: for each row the last one of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of time in which the last row is looked for by itself.
RANGES = 64


def _range_of(time: Column, cuts: list) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= time)) if cuts else F.lit(0)


def asof_join(left: DataFrame, right: DataFrame, on: str, right_on: str, by: list[str], values: list[str], tie: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` with the same ``by`` whose time (``right_on``) isn't after ``on``, null if there is none.

    Of rows of ``right`` at one time the last by ``tie`` counts (default: by
    ``values``). A null in ``by`` or a null time has no partner. All rows of
    ``left`` stay, also repeated ones.

    Time is cut into ``ranges`` with about equally many rows of both tables; a
    row looks in its own range, and where that has nothing before it takes what
    is carried over from the ranges ahead, of which there is a row for each
    ``by`` and range. So a ``by`` that has a third of all rows isn't one task.
    Runs a job for the cut points.
    """
    if clash := set(values) & set(left.columns):
        raise ValueError(f"both tables have columns of these names: {sorted(clash)}")
    keys = [f"_k{i}" for i in range(len(by))]
    key = lambda df: [df[c].alias(k) for c, k in zip(by, keys, strict=True)]
    value = F.struct(*[right[c].alias(c) for c in values])
    order = F.struct(*[right[c] for c in (tie or values)])
    mine = left.select(*key(left), left[on].alias("_t"), F.struct(*[left[c] for c in left.columns]).alias("_row"))
    theirs = right.select(*key(right), right[right_on].alias("_t"), value.alias("_value"), order.alias("_tie"))
    whole = F.lit(True)
    for k in [*keys, "_t"]:
        whole = whole & F.col(k).isNotNull()
    theirs = theirs.where(whole)
    times = mine.select("_t").unionByName(theirs.select("_t")).where("_t is not null")
    number = F.unix_micros("_t") if dict(times.dtypes)["_t"] == "timestamp" else F.col("_t")
    if dict(times.dtypes)["_t"] == "timestamp_ntz":
        number = F.unix_micros(F.col("_t").cast("timestamp"))
    quantiles = times.agg(F.percentile_approx(number, [k / ranges for k in range(1, ranges)]).alias("c")).first()["c"]
    cuts = sorted(set(quantiles or []))
    mine, theirs = (df.withColumn("_range", _range_of(number, cuts)) for df in (mine, theirs))
    # of each key and range the last row, carried over to the ranges behind
    lasts = theirs.groupBy(*keys, "_range").agg(F.max_by("_value", F.struct("_t", "_tie")).alias("_last"))
    places = mine.where(whole).select(*keys, "_range").distinct()
    ahead = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range at most
    carried = places.join(lasts, [*keys, "_range"], "full").withColumn("_carried", F.last("_last", ignorenulls=True).over(ahead)).select(*keys, "_range", "_carried")
    none = F.lit(None)
    rows = theirs.select(*keys, "_range", "_t", F.lit(0).alias("_side"), "_tie", "_value", none.cast(mine.schema["_row"].dataType).alias("_row")).unionByName(
        mine.where(whole).select(*keys, "_range", "_t", F.lit(1).alias("_side"), none.cast(theirs.schema["_tie"].dataType).alias("_tie"), none.cast(theirs.schema["_value"].dataType).alias("_value"), "_row")
    )
    so_far = W.partitionBy(*keys, "_range").orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(so_far)).where("_side = 1")
    found = seen.join(carried, [*keys, "_range"], "left").select("_row", F.coalesce("_own", "_carried").alias("_found"))
    alone = mine.where(~whole).select("_row", none.cast(theirs.schema["_value"].dataType).alias("_found"))
    return found.unionByName(alone).select(*[F.col(f"_row.`{c}`").alias(c) for c in left.columns], *[F.col(f"_found.`{c}`").alias(c) for c in values])
