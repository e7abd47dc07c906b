"""Pattern sets in versions that a running stream follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.scan import scan
from ..plans.patterns import PatternSet
from ..sources.index import load_index, save_index

_LIST = "version long, path string"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, path) of the sets published under ``path``; empty before the first."""
    try:
        return spark.read.schema(_LIST).parquet(f"{path}/versions")
    except AnalysisException:  # no such folder yet
        return spark.createDataFrame([], _LIST)


def publish(spark: SparkSession, patterns: PatternSet, path: str) -> int:
    """Stores a set as the next version; readers see it once it is whole. One publisher at a time."""
    number = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    save_index(spark, patterns, f"{path}/sets/{number}")
    spark.createDataFrame([(number, f"{path}/sets/{number}")], _LIST).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return number


def current(spark: SparkSession, path: str) -> tuple[int, PatternSet]:
    """The latest version and its set."""
    last = versions(spark, path).orderBy(F.col("version").desc()).first()
    if last is None:
        raise ValueError(f"no set has been published under {path}")
    return last["version"], load_index(spark, last["path"])


def scan_versions(source: DataFrame, col: str, path: str, sink: Callable[[DataFrame, int], None], how: Callable[..., DataFrame] = scan, **options) -> DataStreamWriter:
    """A stream writer whose every micro-batch is scanned with the version that is the latest when it begins; the result says which (``version``).

    ``sink`` gets the matches and the number of the micro-batch. A batch that
    runs again after a failure may find a later version: a sink that replaces
    what a batch has written has one version for each batch.
    """
    held: dict[int, PatternSet] = {}

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = versions(spark, path).agg(F.max("version")).first()[0]
        if last not in held:
            held.clear()
            last, held[last] = current(spark, path)
        sink(how(batch, col, held[last], **options).withColumn("version", F.lit(last).cast("long")), number)

    return source.writeStream.foreachBatch(each)
