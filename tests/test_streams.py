"""Typed stream state, versions of a set under a running query, windows with late rows."""

from __future__ import annotations

import random
import time as clock
from datetime import datetime, timedelta

import pytest

from needlework.operators.arrow import scan_bytes
from needlework.plans.patterns import HotSwapPatternSet, PatternSet, PatternSetBuilder
from needlework.streaming import keyed, versions, windows
from needlework.streaming.stream import EAGER, scan_each_batch

CHUNKS = "stream_id long, seq int, data binary, eos boolean"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(keyed.STORE, None)
    keyed.use_rocksdb(spark)
    yield
    spark.conf.set(keyed.STORE, before) if before else spark.conf.unset(keyed.STORE)


def feeder(spark, tmp_path, patterns, **options):
    """Puts chunks in and gives all matches so far."""

    def put(*chunks):
        spark.createDataFrame([(i, n, bytearray(d), e) for i, n, d, e in chunks], CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = keyed.scan_keyed_stream(spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in")), patterns, **options)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination(90)
        return sorted(tuple(r) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())

    return put


def held(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "check")).count()


def test_keyed_state(spark, rocksdb, tmp_path):
    """Early chunks wait, repeated ones are left out, and the state goes with the last chunk."""
    put = feeder(spark, tmp_path, PatternSetBuilder().literal("needle").regex("[0-9]{2,3}").build())
    assert put((1, 0, b"a nee", False), (1, 1, b"dle", True), (2, 0, b"xx needl", False), (3, 2, b"dle45", True), (3, 1, b"nee", False)) == [(1, 0, 2, 8)]
    assert held(spark, tmp_path, "tail") == 2
    got = put((2, 0, b"xx needl", False), (2, 1, b"e, 1", False), (3, 1, b"again", False), (3, 0, b"0", False))
    assert got == [(1, 0, 2, 8), (2, 0, 3, 9), (3, 0, 1, 7), (3, 1, 7, 9)]
    assert held(spark, tmp_path, "tail") == 1
    assert put((2, 2, b"23", True))[-3] == (2, 1, 11, 14) and held(spark, tmp_path, "tail") == 0


def test_keyed_streams_end_when_idle(spark, rocksdb, tmp_path):
    put = feeder(spark, tmp_path, PatternSet.of("ab", "abc"), idle_ms=1000)
    assert put((1, 0, b"xab", False)) == []
    clock.sleep(1.5)
    assert put((2, 0, b"-", False)) == [(1, 0, 1, 3)]


def test_early_chunks_expire(spark, rocksdb, tmp_path):
    put = feeder(spark, tmp_path, PatternSet.of("ab"), wait_ms=500, idle_ms=600_000)
    assert put((1, 1, b"ab", True)) == []
    clock.sleep(1)
    assert put((1, 0, b"--", False)) == []
    assert put((1, 1, b"ab", True)) == [(1, 0, 2, 4)]


def test_keyed_stream_equals_scan(spark, rocksdb, tmp_path):
    rng = random.Random(2)
    patterns = PatternSetBuilder().literal("ab").literal("abba").regex("b[ab]{1,2}$").build()
    texts = {i: "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 60))).encode() for i in range(8)}
    chunks = []
    for i, t in texts.items():
        cuts = sorted({0, len(t), *(rng.randint(0, len(t)) for _ in range(6))})
        parts = [t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [b""]
        chunks += [(i, k, p, k == len(parts) - 1) for k, p in enumerate(parts)]
    rng.shuffle(chunks)
    put = feeder(spark, tmp_path, patterns)
    put(*chunks[: len(chunks) // 2])
    got = put(*chunks[len(chunks) // 2 :], *chunks[:3])
    want = sorted((i, p, s, e) for i, t in texts.items() for s, p, e in scan_bytes(t, patterns))
    assert got == want


def test_keyed_arguments(spark):
    df = spark.createDataFrame([], CHUNKS)
    with pytest.raises(ValueError, match="limit"):
        keyed.scan_keyed_stream(df, PatternSetBuilder().regex("a+").build())
    with pytest.raises(ValueError, match="mode"):
        keyed.StreamScanner(PatternSet.of("a"), "other")
    assert keyed.StreamScanner(PatternSet.of("a"), EAGER).feed(b"a") == [(0, 0, 1)]


# -- versions ------------------------------------------------------------------------
def test_a_running_query_follows_versions(spark, tmp_path):
    path, source = str(tmp_path / "sets"), str(tmp_path / "in")
    with pytest.raises(ValueError, match="published"):
        versions.current(spark, path)
    assert versions.publish(spark, PatternSet.of("old"), path) == 1
    put = lambda *texts: spark.createDataFrame([(t,) for t in texts], "hay string").coalesce(1).write.mode("append").parquet(source)
    put("old new")
    out = str(tmp_path / "out")
    sink = lambda hits, number: hits.write.mode("overwrite").parquet(f"{out}/batch={number}")
    query = versions.scan_versions(spark.readStream.schema("hay string").parquet(source), "hay", path, sink).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        assert versions.publish(spark, PatternSet.of("x", "new"), path) == 2
        put("old new new")
        query.processAllAvailable()
        put("new")
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r["version"], r["pattern_id"], r["start"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, 0), (2, 1, 0), (2, 1, 4), (2, 1, 8)]
    assert [r["version"] for r in versions.versions(spark, path).orderBy("version").collect()] == [1, 2]


def test_each_batch_has_the_set_of_its_moment(spark, tmp_path):
    own, seen = HotSwapPatternSet(PatternSet.of("old")), []
    source = str(tmp_path / "in")
    put = lambda text: spark.createDataFrame([(text,)], "hay string").coalesce(1).write.mode("append").parquet(source)
    put("old new")
    sink = lambda hits, number: seen.extend((number, r["start"]) for r in hits.collect())
    query = scan_each_batch(spark.readStream.schema("hay string").parquet(source), "hay", own, sink).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        own.swap(PatternSet.of("new"))
        put("old new")
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [(0, 0), (1, 4)]


# -- windows -------------------------------------------------------------------------
START = datetime(2024, 1, 1)
EVENTS = "id long, at timestamp, who string, props string"


def run_windows(spark, tmp_path, batches, **options):
    source = str(tmp_path / "in")
    spark.createDataFrame([], EVENTS).write.parquet(source)
    found = windows.matches_by_window(spark.readStream.schema(EVENTS).parquet(source), "props", PatternSet.of("hit"), "at", "id", **options)
    query = found.writeStream.format("memory").queryName("windows_test").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for rows in batches:
            spark.createDataFrame([(i, START + timedelta(minutes=m), w, p) for i, m, w, p in rows], EVENTS).repartition(3).write.mode("append").parquet(source)
            query.processAllAvailable()
        got = sorted(tuple(x if isinstance(x, int | str) else int((x - START).total_seconds() // 60) for x in r) for r in spark.table("windows_test").collect())
        return got, windows.late_rows(query)
    finally:
        query.stop()


def test_sessions_merge_and_late_rows_are_counted(spark, tmp_path):
    batches = [
        [(1, 0, "a", "hit"), (2, 20, "a", "hit"), (3, 5, "b", "hit"), (4, 6, "b", "miss")],
        [(5, 10, "a", "hit"), (2, 20, "a", "hit"), (6, 300, "c", "hit")],  # 5 joins two sessions; 2 comes again
        [(7, 15, "a", "hit"), (8, 16, "b", "hit"), (9, 290, "c", "hit")],  # 7 and 8 are too late
        [(10, 1000, "d", "hit")],
    ]
    got, late = run_windows(spark, tmp_path, batches, late="30 minutes", keys=["who"], gap="15 minutes")
    assert got == [("a", 0, 35, 3), ("b", 5, 20, 1), ("c", 290, 315, 2)] and late == 2


def test_sliding_windows(spark, tmp_path):
    batches = [[(1, 5, "a", "hit"), (2, 12, "a", "hit")], [(3, 100, "a", "hit")], [(4, 500, "a", "hit")]]
    got, late = run_windows(spark, tmp_path, batches, late="10 minutes", length="20 minutes", slide="10 minutes")
    assert got == [(-10, 10, 1), (0, 20, 2), (10, 30, 1), (90, 110, 1), (100, 120, 1)] and late == 0


def test_windows_of_a_table(spark):
    df = spark.createDataFrame([(1, START, "a", "hit"), (1, START, "a", "hit"), (2, START, "a", None)], EVENTS)
    assert windows.matches_by_window(df, "props", PatternSet.of("hit"), "at", "id", "1 hour", length="1 hour").select("n_events").collect() == [(1,)]
    with pytest.raises(ValueError, match="gap"):
        windows.window_of("at")
    assert windows.matches_by_window(df.limit(0), "props", PatternSet.of("hit"), "at", "id", "1 hour", gap="1 hour").collect() == []
