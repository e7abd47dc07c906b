"""As-of joins, plans of batches over a whole table, the table function."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from needlework.operators import batch
from needlework.operators import scan as S
from needlework.operators.asof import asof_join
from needlework.plans.planner import ScanConfig

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_asof_join(spark, ranges):
    """As a plain search; one key has most rows, times tie, keys and times are null, rows repeat."""
    rng = random.Random(ranges)
    some = lambda n: [(rng.choice(["hot"] * 6 + ["b", "c", None]), START + timedelta(seconds=rng.randrange(200)) if rng.random() > 0.05 else None, k) for k in range(n)]
    left, right = some(150), some(90)
    left += left[:5]
    a = spark.createDataFrame(left, "who string, at timestamp, n int")
    b = spark.createDataFrame(right, "user string, seen timestamp, m int").selectExpr("user as who", "seen", "m")
    got = sorted(map(str, (tuple(r) for r in asof_join(a, b, "at", "seen", ["who"], ["m"], ranges=ranges).collect())))
    want = []
    for who, at, n in left:
        own = [(t, m) for w, t, m in right if who is not None and at is not None and w == who and t is not None and t <= at]
        want.append(str((who, at, n, max(own)[1] if own else None)))
    assert got == sorted(want)


def test_asof_edges(spark):
    a = spark.createDataFrame([(1, 5), (1, 4)], "k int, t long")
    b = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (2, 1, "z")], "k int, u long, v string")
    assert {tuple(r) for r in asof_join(a, b, "t", "u", ["k"], ["v"]).collect()} == {(1, 5, "y"), (1, 4, None)}
    assert asof_join(a.limit(0), b, "t", "u", ["k"], ["v"]).collect() == []
    assert {r["v"] for r in asof_join(a, b.limit(0), "t", "u", ["k"], ["v"]).collect()} == {None}
    with pytest.raises(ValueError, match="names"):
        asof_join(a, b, "t", "u", ["k"], ["k"])


# -- batches ----------------------------------------------------------------------
def test_fill_is_the_greedy_plan():
    rng = random.Random(1)
    for _ in range(500):
        sizes = [rng.choice([0, 1, 2, 3, 5, 8, 13, 40]) for _ in range(rng.randint(1, 60))]
        config = ScanConfig(batch_inputs=rng.randint(1, 6), batch_bytes=rng.choice([1, 7, 20, 100]))
        want = batch.plan_batches(list(enumerate(sizes)), config)
        runs = sorted({n: sizes.count(n) for n in sizes}.items(), reverse=True)
        got: dict[int, list] = {}
        for n, at, place, first, after, each in batch.fill(runs, config):
            for rank, i in enumerate(i for i, x in enumerate(sizes) if x == n):
                b, p = (at, place + rank) if rank < first else (after + (rank - first) // each, (rank - first) % each)
                got.setdefault(b, []).append((p, i))
        assert [[i for _, i in sorted(got[b])] for b in sorted(got)] == want
        assert all([p for p, _ in sorted(x)] == list(range(len(x))) for x in got.values())


def test_planned_whole(spark):
    df = spark.createDataFrame([(0, "a" * 4), (1, "b" * 6), (2, "c"), (3, "d" * 4)], "id int, hay string")
    plan = batch.planned_whole(df, "id", "hay", ScanConfig(batch_inputs=2, batch_bytes=7)).collect()
    assert sorted((r["batch"], r["place"], r["id"]) for r in plan) == [(0, 0, 1), (1, 0, 0), (2, 0, 3), (2, 1, 2)]
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([0, 3, 3, 3, 9, 20])) for i in range(700)] + [(700, None)]
    config = ScanConfig(batch_inputs=5, batch_bytes=30)
    want = sorted((b, p, i) for b, ids in enumerate(batch.plan_batches([(i, len(t or "")) for i, t in rows], config)) for p, i in enumerate(ids))
    got = batch.planned_whole(spark.createDataFrame(rows, "id long, hay string"), "id", "hay", config).collect()
    assert sorted((r["batch"], r["place"], r["id"]) for r in got) == want
    assert batch.planned_whole(df.limit(0), "id", "hay").collect() == []
    with pytest.raises(ValueError, match="size"):
        batch.planned_whole(df, "id", "hay", ScanConfig(sort_by_size=False))


# -- table function ---------------------------------------------------------------------
def test_scan_table_function(spark):
    S.register_scan_table(spark, "scan_any")
    spark.createDataFrame([(1, "the other", b"x"), (2, None, None), (3, "x 12", b"the")], "id int, text string, raw binary").createOrReplaceTempView("scan_docs")
    got = spark.sql("select * from scan_any(table(scan_docs), 'text', array('the', 'he'))")
    assert got.columns == ["id", "raw", "pattern_id", "start", "end"]
    assert sorted((r["id"], r["pattern_id"], r["start"], r["end"]) for r in got.collect()) == [(1, 0, 0, 3), (1, 0, 5, 8)]
    both = spark.sql("select id, pattern_id, start from scan_any(table(select id, text from scan_docs) partition by (id), 'text', array('th'), array('[0-9]+'))")
    assert sorted(tuple(r) for r in both.collect()) == [(1, 0, 0), (1, 0, 5), (3, 1, 2)]
    assert [r["id"] for r in spark.sql("select id from scan_any(table(select id, raw from scan_docs), 'raw', array('the'))").collect()] == [3]
    for bad in ("table(scan_docs), 'none', array('a')", "table(scan_docs), 'id', array('a')", "table(scan_docs), 'text', array('')", "table(scan_docs), 'text', array('a'), array('(a+)+')", "table(select text, id as start from scan_docs), 'text', array('a')"):
        with pytest.raises(Exception, match="column|neither|empty|repeats|names"):
            spark.sql(f"select * from scan_any({bad})").collect()
