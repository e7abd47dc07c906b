"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, in local sessions without one in a temporary folder; it goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="needlework-")
    path = f"{base.rstrip('/')}/needlework/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        remove(spark, path)


#: Has a query's shuffle files deleted when it ends, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables that are ``written`` within go at its end; what is needed of them has to be kept by ``lasting``."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: what comes next doesn't run it again, nor does a lost executor."""
    df, path = _written(df, name)
    if _passing:
        _passing[-1].append(path)
    return df


def lasting(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, whatever is ``passing``."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path
