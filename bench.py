"""Headline scans over `documents`; one JSON line with seconds by query and MB/s.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores of local mode.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from needlework import queries as Q
    from needlework.operators import chunk
    from needlework.operators import scan as S
    from needlework.plans.patterns import PatternSet
    from needlework.plans.planner import ScanConfig

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "0").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the table is one row group, so one task; dealt out and held in memory, as the figures to match are of scans in memory
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(int(cpus)).cache()
    megabytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] / 1e6
    words = [r["w"] for r in docs.select(F.explode(F.split("text", "[^a-z]+")).alias("w")).where("length(w) between 6 and 12").groupBy("w").count().orderBy("count", "w").limit(10_000).collect()]
    sets = {n: PatternSet.of(*words[:n]) for n in (10, 100, 1000, 10_000)}
    dense = PatternSet.of(*Q.LITERALS)
    regex = PatternSet.builder().regex("[a-z]{5}[0-9]{3}_[a-z]+").build()
    mixed = PatternSet.builder().literal("password").literal("token").regex(Q.EMAIL).regex(Q.IP).build()
    queries = {
        **{f"scan_{n}": lambda p=p: S.scan(docs, "text", p) for n, p in sets.items()},
        **{f"count_{n}": lambda p=p: S.scan_count(docs, "text", p) for n, p in sets.items()},
        "scan_dense": lambda: S.scan(docs, "text", dense),
        "scan_dense_nested": lambda: S.scan_nested(docs, "text", dense),
        "scan_dense_ci": lambda: S.scan(docs, "text", PatternSet.of(*Q.FOLDED, case_insensitive=True)),
        "scan_1000_arrow": lambda: S.scan(docs, "text", sets[1000], config=ScanConfig(strategy="arrow")),
        "scan_regex": lambda: S.scan(docs, "text", regex),
        "scan_mixed": lambda: S.scan(docs, "text", mixed),
        "any_match": lambda: S.any_match(docs, "text", PatternSet.of(*Q.WORDS)),
        "scan_overlapping": lambda: S.scan_overlapping(docs, "text", PatternSet.of(*Q.OVERLAPPING)),
        "scan_chunked": lambda: chunk.scan_chunked(docs, "text", PatternSet.of(*Q.OVERLAPPING), ["doc_id"], ScanConfig().with_chunk_bytes(1 << 16).with_overlap(64)),
        # from the files
        "docs_by_pattern": lambda: Q.docs_by_pattern(spark, sf),
        "match_rollup": lambda: Q.match_rollup(spark, sf),
        "match_gaps": lambda: Q.match_gaps(spark, sf),
    }
    seconds = {}
    for name, query in queries.items():
        best = None
        for _ in range(3):  # the first run compiles
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "scan_seconds", "value": total, "unit": "sec", "queries": seconds, "mb_per_s": {k: round(megabytes / v, 1) for k, v in seconds.items()}, "input_mb": round(megabytes, 1), "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
