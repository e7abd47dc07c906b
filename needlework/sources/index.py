"""Pattern sets on disk: a Parquet table of patterns and a line of metadata with a checksum.

Both are written and read by Spark, so any store that it knows will do.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexCorrupt
from ..operators.scan import pattern_table, scan
from ..plans.patterns import PatternSet, PatternSetBuilder
from ..plans.planner import ScanConfig

FORMAT_VERSION = 1
MAGIC = "needlework-patterns"
#: Bytes of patterns that a driver loads.
LARGEST_INDEX = 512 << 20


def checksum(patterns: PatternSet) -> int:
    total = 0
    for p in patterns.patterns:
        row = json.dumps([p.pattern_id, p.kind, None if p.literal is None else p.literal.hex(), p.regex, p.name])
        total = zlib.crc32(row.encode(), total)
    return total


def save_index(spark: SparkSession, patterns: PatternSet, path: str) -> None:
    pattern_table(spark, patterns).coalesce(1).write.parquet(f"{path}/patterns")
    meta = {
        "magic": MAGIC, "format_version": FORMAT_VERSION, "case_insensitive": patterns.case_insensitive, "regex_limit": patterns.regex_limit, "pattern_count": len(patterns),
        "literal_count": len(patterns.literals), "regex_count": len(patterns.regexes), "crc32": checksum(patterns),
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def load_index(spark: SparkSession, path: str) -> PatternSet:
    """The set at ``path``, with its ids and names; ``IndexCorrupt`` if anything in it doesn't fit."""
    try:
        lines = [r["value"] for r in spark.read.text(f"{path}/metadata").limit(2).collect()]
        meta = json.loads(lines[0]) if len(lines) == 1 else {}
        table = spark.read.parquet(f"{path}/patterns")
        size = table.agg(F.sum(F.coalesce(F.octet_length("literal"), F.lit(0)) + F.coalesce(F.octet_length("regex"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    except Exception as e:
        raise IndexCorrupt(f"{path} can't be read") from e
    if meta.get("magic") != MAGIC or meta.get("format_version") != FORMAT_VERSION:
        raise IndexCorrupt("not an index of this format")
    if (size["n"] or 0) > LARGEST_INDEX:
        raise IndexCorrupt("too large")
    if size["rows"] != meta["pattern_count"]:
        raise IndexCorrupt(f"{size['rows']} patterns of {meta['pattern_count']}")
    rows = sorted(table.collect(), key=lambda r: r["pattern_id"])
    if [r["pattern_id"] for r in rows] != list(range(len(rows))):
        raise IndexCorrupt("pattern ids have gaps")
    builder = PatternSetBuilder().case_insensitive(meta["case_insensitive"]).regex_limit(meta["regex_limit"])
    for r in rows:
        builder._add(kind=r["kind"], literal=None if r["literal"] is None else bytes(r["literal"]), regex=r["regex"], name=r["name"])
    found = builder.build()
    if checksum(found) != meta["crc32"] or (len(found.literals), len(found.regexes)) != (meta["literal_count"], meta["regex_count"]):
        raise IndexCorrupt("the checksum doesn't fit")
    return found


def scan_index(df: DataFrame, col: str, path: str, keep: list[str] | None = None, config: ScanConfig = ScanConfig()) -> DataFrame:
    """A scan with the set at ``path``."""
    return scan(df, col, load_index(df.sparkSession, path), keep, config)
