"""Shared scratch space and small helpers of the subpackage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_base: str | None = None


def scratch_base(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests), a temporary folder is
    used; a cluster without that setting is an error, since a folder of one
    machine can't be read by the others.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_base is None:
        _local_base = "file://" + tempfile.mkdtemp(prefix="needlework-")
    return _local_base


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_base(spark)}/needlework/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation of
    what is above. The table is deleted when the driver's Python ends.
    """
    return materialize_at(df, name)[0]


#: Has a query's shuffle files deleted when it ends, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the path for those who delete it earlier."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Intermediate tables that go together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = materialize_at(df, name)
        self.paths.append(path)
        return df

    def drop(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths.clear()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def budgeted(rows, size, limit: int):
    """Cuts an iterable into lists whose summed ``size`` stays near ``limit``."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def first_of_key(slim: DataFrame, key: str, ident: str, salts: int = 64, extra: DataFrame | None = None) -> DataFrame:
    """``slim`` with first_id, the smallest ``ident`` of the rows that share ``key``.

    A key is first reduced in ``salts`` parts by its identifiers, so that a key
    with a third of all rows doesn't meet in one task: what meets is a row per
    part. ``extra`` (first_id and more columns, unique by first_id) is joined
    before the result goes back to the rows.
    """
    rows = slim.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(salts)))
    parts = rows.groupBy(key, "_salt").agg(F.min(ident).alias("first_id"))
    whole = parts.groupBy(key).agg(F.min("first_id").alias("first_id"), F.collect_list("_salt").alias("_salt"))
    if extra is not None:
        whole = whole.join(extra, "first_id", "left")
    return rows.join(whole.withColumn("_salt", F.explode("_salt")), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b: long); the component is its smallest node.

    Every round contracts each node into its neighbour of least random rank, so
    the graph shrinks by a constant factor however it is shaped. Rounds are
    written to the shared folder. Edges are never collected. The result goes
    with ``scratch``, if there is one.
    """
    result = scratch or Scratch(edges.sparkSession)
    with Scratch(edges.sparkSession) as own:
        rounds = Scratch(edges.sparkSession)
        live = edges.where("a <> b").select("a", "b").distinct()
        live = rounds.keep(live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        label = rounds.keep(live.select(F.col("a").alias("node"), F.col("a").alias("at")).distinct(), "labels")
        k = 0
        while not live.isEmpty():
            before, rounds, k = rounds, Scratch(edges.sparkSession), k + 1
            rank = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("r"), F.col(c).alias("n"))
            step = live.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("n"), F.least(F.col("m"), rank("a"))["n"].alias("to"))
            step = before.keep(step, "step")
            moved = live.join(step.select(F.col("n").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("n").alias("b"), F.col("to").alias("y")), "b")
            live = rounds.keep(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
            label = rounds.keep(label.join(step.select(F.col("n").alias("at"), "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at")), "labels")
            before.drop()
        least = own.keep(label.groupBy("at").agg(F.min("node").alias("component")), "least")
        done = result.keep(label.join(least, "at").select("node", "component"), "components")
        rounds.drop()
    return done
