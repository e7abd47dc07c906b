"""Limits, long haystacks in blocks, and literals in a table."""

from __future__ import annotations

import random

import numpy as np
import pytest
from naive import leftmost_longest, overlapping
from pyspark.sql import functions as F

from needlework import errors
from needlework.operators import chunk, greedy, table
from needlework.operators import scan as S
from needlework.operators.arrow import met, scan_bytes
from needlework.plans.patterns import PatternSet, PatternSetBuilder
from needlework.plans.planner import ScanConfig, fallback_reason


# -- limits ----------------------------------------------------------------------
def paths(df):
    few, many = PatternSet.of("ab", "b"), PatternSet.of("ab", *[f"x{i}y" for i in range(100)])
    native = ScanConfig(strategy="native")
    small = lambda n, **more: ScanConfig(**more).with_chunk_bytes(16).with_overlap(4).with_max_matches(n)
    regex = PatternSetBuilder().regex("[ab]b?").build()
    return {
        "scan": (50, lambda n: S.scan(df, "hay", PatternSet.of("ab"), config=ScanConfig().with_max_matches(n))),
        "native": (50, lambda n: S.scan(df, "hay", PatternSet.of("ab"), config=native.with_max_matches(n))),
        "joined": (50, lambda n: S.scan(df, "hay", many, config=native.with_max_matches(n))),
        "joined, given": (50, lambda n: S.scan(df, "hay", many, config=native, max_matches=n)),
        "overlapping": (100, lambda n: S.scan_overlapping(df, "hay", few, config=ScanConfig().with_max_matches(n))),
        "overlapping, native": (100, lambda n: S.scan_overlapping(df, "hay", few, config=native.with_max_matches(n))),
        "nested": (50, lambda n: S.scan_nested(df, "hay", PatternSet.of("ab"), ScanConfig().with_max_matches(n))),
        "nested, native": (50, lambda n: S.scan_nested(df, "hay", PatternSet.of("ab"), native.with_max_matches(n))),
        "chunked": (100, lambda n: chunk.scan_chunked(df, "hay", few, ["id"], small(n))),
        "chunked regex": (50, lambda n: chunk.scan_chunked(df, "hay", regex, ["id"], small(n))),
    }


@pytest.mark.parametrize("name", list(paths(None)))
def test_limits_hold_for_a_haystack(spark, name):
    """So many matches of one haystack fail; one less doesn't, nor do as many of two."""
    df = spark.createDataFrame([(1, "ab" * 50), (2, "ab" * 49), (3, None)], "id int, hay string")
    most, make = paths(df)[name]
    with pytest.raises(Exception, match="MatchBufferOverflow"):
        make(most).collect()
    assert make(most + 1).count()


def test_fallback(spark):
    """What the native strategy can't run goes to Python if that is allowed, else it is an error."""
    df = spark.createDataFrame([(1, "ababab")], "id int, hay string")
    groups = PatternSetBuilder().regex("(?:ab|b){2,100}").build()
    native, falls = ScanConfig(strategy="native"), ScanConfig(strategy="native", fallback=True)
    with pytest.raises(ValueError, match="native"):
        S.scan(df, "hay", groups, config=native)
    assert [tuple(r) for r in S.scan(df, "hay", groups, config=falls).collect()] == [(1, 0, 0, 6)]
    assert "native" in fallback_reason(groups, falls) and fallback_reason(groups, native) is None
    assert fallback_reason(PatternSet.of("a"), falls) is None
    many = PatternSet.of(*[f"a{i}" for i in range(100)])
    assert fallback_reason(many, falls, "nested") and S.scan_nested(df, "hay", many, falls).first()["matches"] == []


def test_size_limits():
    """The limit is on the generated expression: of the literals together, of each regex by itself."""
    with pytest.raises(errors.PatternSetTooLarge):
        PatternSetBuilder().regex_limit(10).literal("a long literal").build()
    with pytest.raises(errors.PatternCompilationFailed):
        PatternSetBuilder().regex_limit(10).regex("[a-z]+long[0-9]{1,3}").build()
    assert PatternSetBuilder().regex_limit(20).literal("ab").build().literal_regex


# -- greedy selection ----------------------------------------------------------------
def plain_pick(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for s, e, i in sorted(hits, key=lambda h: (h[0], -h[1], h[2])):
        if s >= at:
            out.append((s, e, i))
            at = e
    return out


def random_hits(rng: random.Random, length: int, n: int, longest: int) -> list[tuple[int, int, int]]:
    return [(s, s + rng.randint(1, longest), rng.randrange(3)) for s in (rng.randrange(length) for _ in range(n))]


def test_maps_of_blocks():
    """Chained maps say of every entry where a plain walk goes out."""
    rng = random.Random(1)
    for _ in range(200):
        longest, block = rng.randint(1, 8), 8
        hits = random_hits(rng, 40, rng.randint(1, 30), longest)
        numbers = sorted({s // block for s, _, _ in hits})
        maps = []
        for b in numbers:
            own = greedy.best(*(np.array(x) for x in zip(*[h for h in hits if h[0] // block == b], strict=True)))
            maps.append(greedy.summary(own[0], own[1], b * block + longest - 1))
        whole = greedy.chained(maps)
        for entry in range(numbers[0] * block, numbers[0] * block + longest):
            at = entry
            for s, e, _ in sorted(hits, key=lambda h: (h[0], -h[1])):
                at = e if s >= at else at
            assert greedy.through(whole, np.array([entry]))[0] == at


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_leftmost_longest_in_blocks(spark, monkeypatch, fan):
    monkeypatch.setattr(greedy, "FAN", fan)
    rng = random.Random(fan)
    hits = {k: random_hits(rng, n, n, 7) for k, n in ((1, 300), (2, 10), (None, 150), (4, 1))}
    df = spark.createDataFrame([(k, "a", i, s, e) for k, own in hits.items() for s, e, i in own], "id int, more string, pattern_id int, start int, end int")
    got = greedy.leftmost_longest(df, ["id", "more"], longest=7, block=8)
    want = sorted(((k, i, s, e) for k, own in hits.items() for s, e, i in plain_pick(own)), key=str)
    assert sorted(((r["id"], r["pattern_id"], r["start"], r["end"]) for r in got.collect()), key=str) == want
    assert greedy.leftmost_longest(df.limit(0), ["id"], longest=7).collect() == []
    with pytest.raises(Exception, match="MatchTooLong"):
        greedy.leftmost_longest(df, ["id"], longest=2)


def test_a_haystack_of_many_hits_is_many_tasks(spark):
    """A million hits of one haystack: more than one task reads blocks of it, and what stays is what a plain walk keeps."""
    n = 1_000_000
    hits = spark.range(0, n, 1, 8).select(F.lit(7).alias("id"), F.lit(0).alias("pattern_id"), F.col("id").alias("start"), (F.col("id") + 1 + F.pmod(F.xxhash64("id"), F.lit(5))).alias("end"))
    got = greedy.leftmost_longest(hits, ["id"], longest=5)
    starts, ends = (np.array(x) for x in zip(*[(r["start"], r["end"]) for r in hits.select("start", "end").collect()], strict=True))
    want, at, by = [], 0, dict(zip(starts.tolist(), ends.tolist(), strict=True))
    while at < n:
        want.append(at)
        at = by[at]
    assert sorted(r["start"] for r in got.select("start").collect()) == want
    blocks = greedy.by_block(hits, ["id"], greedy.BLOCK)
    assert blocks.count() == n // greedy.BLOCK + 1


def test_met():
    import re

    regex = re.compile(b"ab?c?|b+")
    data = b"abcabbbacb" * 3
    found = met(regex, data, 3, 20, 5, False)
    for entry in range(3, 8):
        at = entry
        while (m := regex.search(data, at)) and m.start() < 20:
            assert found[m.start()] == m.end()
            at = m.end()


def test_chunked_regexes_never_cut_a_match(spark):
    """Ten letters, a hundred digits: as one scan if the limit allows, an error if it doesn't."""
    text = "a" * 10 + "7" * 100 + "b"
    df = spark.createDataFrame([(1, text), (1, text), (2, "12345")], "id int, hay string")
    digits = PatternSetBuilder().regex("[0-9]{4,}").build()
    config = ScanConfig().with_chunk_bytes(16).with_overlap(4)
    got = sorted((r["id"], r["start"], r["end"]) for r in chunk.scan_chunked(df, "hay", digits, ["id"], config, max_match_len=100).collect())
    assert got == [(1, 10, 110), (1, 10, 110), (2, 0, 5)]
    for short in (20, 99):
        with pytest.raises(Exception, match="MatchTooLong"):
            chunk.scan_chunked(df, "hay", digits, ["id"], config, max_match_len=short).collect()


def test_random_regexes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(greedy, "FAN", 3)
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab1\n") for _ in range(rng.choice([0, 5, 200, 900]))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, hay string")
    own = PatternSetBuilder().regex("a[ab]{0,6}").regex("b{2,9}|[0-9]").regex("^[ab]{1,3}$").build()
    want = sorted((i, *m) for i, t in enumerate(texts) for m in ((n, s, e) for s, n, e in scan_bytes(t.encode(), own)))
    got = chunk.scan_chunked(df, "hay", own, ["id"], ScanConfig().with_chunk_bytes(10), spread=3).collect()
    assert sorted((r["id"], r["pattern_id"], r["start"], r["end"]) for r in got) == want


# -- literals in a table -----------------------------------------------------------------
def hits_of(df):
    return sorted((r["id"], r["pattern_id"], r["start"], r["end"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_scan_table(spark, monkeypatch, seed):
    """Two letters and many lengths, in small windows: as the definitions say."""
    monkeypatch.setattr(table, "WINDOW", 16)
    rng = random.Random(seed)
    word = lambda n: bytes(rng.choice(b"abAB\xff") for _ in range(n))
    texts = [word(rng.randint(0, 60)) for _ in range(40)] + [None, b""]
    cuts = [t[k : k + rng.randint(1, 33)] for t in texts if t for k in (0, len(t) // 2)]
    literals = [x for x in cuts if x] + [word(rng.randint(1, 40)) for _ in range(20)] + [b"a", b"a"]
    df = spark.createDataFrame([(i % 30, t if t is None else bytearray(t)) for i, t in enumerate(texts)], "id int, hay binary")
    set_of = spark.createDataFrame([(i, bytearray(x), None) for i, x in enumerate(literals)] + [(999, None, None)], "pattern_id int, literal binary, _key string")
    for fold in (False, True):
        low = (lambda b: b.lower()) if fold else (lambda b: b)
        for every, plain in ((True, overlapping), (False, leftmost_longest)):
            want = sorted((i % 30, *m) for i, t in enumerate(texts) if t is not None for m in plain(low(t), [low(x) for x in literals]))
            assert hits_of(table.scan_table(df, "hay", set_of, overlapping=every, case_insensitive=fold)) == want


def test_scan_table_edges(spark):
    df = spark.createDataFrame([(1, "abab", 5)], "id int, hay string, more int")
    literal = lambda *x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "pattern_id long, literal string")
    assert [tuple(r) for r in table.scan_table(df, "hay", literal("ab"), ["id"], overlapping=True).orderBy("start").collect()] == [(1, 0, 0, 2), (1, 0, 2, 4)]
    assert table.scan_table(df, "hay", literal("x" * 5000), ["id"]).collect() == []
    assert table.scan_table(df.limit(0), "hay", literal("ab"), ["id"]).collect() == []
    long = "y" * 3000 + "z"
    assert hits_of(table.scan_table(spark.createDataFrame([(1, "a" + long + "b")], "id int, hay string"), "hay", literal(long, "y"), ["id"])) == [(1, 0, 1, 3002)]
    with pytest.raises(errors.EmptyPatternSet):
        table.scan_table(df, "hay", literal("ab").limit(0))
    with pytest.raises(Exception, match="EmptyPattern"):
        table.scan_table(df, "hay", literal("ab", ""), ["id"]).collect()
    with pytest.raises(ValueError, match="names"):
        table.scan_table(df.withColumnRenamed("more", "start"), "hay", literal("ab"))


def test_scan_table_sends_common_literals_once_a_batch(spark):
    """A literal in every haystack is a row for each batch of them on its way to the join, not for each hit."""
    df = spark.range(0, 4000, 1, 2).select("id", F.lit("aa bb aa " * 5).alias("hay"))
    literals = spark.createDataFrame([(0, "aa"), (1, "bb")], "pattern_id int, literal string")
    got = table.scan_table(df, "hay", literals, overlapping=True)
    assert got.count() == 4000 * 15
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_bitmaps_rule_out_most_places():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 123) for _ in range(100_000))
    literals = [data[k : k + 9] for k in range(0, 9000, 90)]
    maps = np.zeros((2, 1 << 16), bool)
    for x in literals:
        h = table.rolled(np.frombuffer(x, np.uint8), [8])[8]
        maps[0, table.prefix_bits(h[:1], 8, 16)] = True
        maps[1, table.key_bits(table.keys_of(h[:1], h[-1:], 9), 16)] = True
    found = list(table.candidates(np.frombuffer(data, np.uint8), [8], {8: [9]}, tuple(np.packbits(maps, axis=1)), 16))
    starts = np.concatenate([s for _, s, _ in found])
    assert set(range(0, 9000, 90)) <= set(starts.tolist()) and len(starts) < 110
