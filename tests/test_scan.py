from __future__ import annotations

import random
from pathlib import Path

import pytest
from naive import leftmost_longest, overlapping

from needlework import errors
from needlework.functions import columns as C
from needlework.operators import batch, chunk
from needlework.operators import scan as S
from needlework.operators.arrow import scan_bytes
from needlework.plans.patterns import HotSwapPatternSet, PatternSet, PatternSetBuilder
from needlework.plans.planner import ScanConfig, describe, strategy
from needlework.sources.index import load_index, save_index
from needlework.streaming.stream import EAGER, StreamScanner, scan_stream

ROCKET = "\U0001f680"


def make(patterns, ci=False) -> PatternSet:
    own = PatternSetBuilder().case_insensitive(ci)
    for p in patterns:
        own.literal_bytes(p) if isinstance(p, bytes) else own.regex(p[3:]) if p.startswith("re:") else own.literal(p)
    return own.build()


def rows(df) -> list[tuple[int, int, int]]:
    return sorted(((r["pattern_id"], r["start"], r["end"]) for r in df.collect()), key=lambda m: (m[1], m[0], m[2]))


GOLDEN = [
    # patterns, input, scan, overlapping (None: not asked)
    (["hello"], "say hello world", [(0, 4, 9)], None),
    (["cat", "re:d.g"], "cat dog", [(0, 0, 3), (1, 4, 7)], None),
    (["aa"], "aaaa", [(0, 0, 2), (0, 2, 4)], [(0, 0, 2), (0, 1, 3), (0, 2, 4)]),
    (["ana"], "banana", [(0, 1, 4)], [(0, 1, 4), (0, 3, 6)]),
    (["overlap", "over"], "overlap", [(0, 0, 7)], [(0, 0, 7), (1, 0, 4)]),
    (["abc", "bc"], "abc", [(0, 0, 3)], [(0, 0, 3), (1, 1, 3)]),
    (["DUPE", "DUPE"], "xxDUPEyy", [(0, 2, 6)], [(0, 2, 6), (1, 2, 6)]),
    (["sk_live"], "sk_live SK_LIVE sK_lIvE", [(0, 0, 7)], None),
    (["a", "b", "c"], "c b a", [(2, 0, 1), (1, 2, 3), (0, 4, 5)], None),
    (["sk_live_123", "sk_test_456", "sk_live_abc"], "sk_live_abc and sk_test_456", [(2, 0, 11), (1, 16, 27)], None),
    ([b"\0\0\0"], b"\0" * 10, None, [(0, i, i + 3) for i in range(8)]),
    ([b"\xff\xff"], b"\xff" * 5, [(0, 0, 2), (0, 2, 4)], [(0, i, i + 2) for i in range(4)]),
    ([b"a\0b"], b"x a\0b y", [(0, 2, 5)], None),
    ([ROCKET], f"prefix{ROCKET}suffix", [(0, 6, 10)], [(0, 6, 10)]),
    (["test"], b"test\xfftest", [(0, 0, 4), (0, 5, 9)], None),
    (["re:\\xFF"], b"\0\xff\0", [(0, 1, 2)], None),
    (["re:r[eE]gex"], "regex and rEgex", [(0, 0, 5), (0, 10, 15)], None),
    (["re:a+"], "aaaa", [(0, 0, 4)], None),
    (["re:^abc"], "abc\nxabc", [(0, 0, 3)], None),
    (["re:.*"], "", [(0, 0, 0)], None),
    (["a"], "", [], []),
    (["xa", "aa"], "xaaa", [(0, 0, 2), (1, 2, 4)], None),
    (["ab", "abc"], "abc", [(1, 0, 3)], None),
    (["re:a*"], "aaa", [(0, 0, 3)], None),
    (["re:^"], "a\nb\n", [(0, 0, 0), (0, 2, 2), (0, 4, 4)], None),
    (["foo", "re:foobar"], "foobar", [(1, 0, 6)], None),
    (["re:a\\b"], b"a\xe9", [(0, 0, 1)], None),
    (["re:\\d{4}-\\d{2}"], "on 2024-05 and 1999-12", [(0, 3, 10), (0, 15, 22)], None),
    (["re:(?i)key"], "KEY key", [(0, 0, 3), (0, 4, 7)], None),
    (["re:[[:upper:]]+x"], "ABx", [(0, 0, 3)], None),
    (["re:.", "x"], b"\x85\nx", [(0, 0, 1), (0, 2, 3), (1, 2, 3)], None),
]


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_golden(spark, case):
    patterns, data, plain, over = GOLDEN[case]
    own = make(patterns)
    df = spark.createDataFrame([(1, data if isinstance(data, str) else bytearray(data))], "id int, hay " + ("string" if isinstance(data, str) else "binary"))
    raw = data.encode() if isinstance(data, str) else data
    if plain is not None:
        assert sorted(scan_bytes(raw, own)) == sorted((s, i, e) for i, s, e in plain)
        assert rows(S.scan(df, "hay", own)) == plain
        if own.native:
            assert rows(S.scan(df, "hay", own, config=ScanConfig(strategy="native"))) == plain
        assert S.scan_count(df, "hay", own).first()["n_matches"] == len(plain)
        first = S.first_match(df, "hay", own).first()["first_match"]
        assert (tuple(first) if first else None) == (plain[0] if plain else None)
        assert (S.any_match(df, "hay", own).count() == 1) == bool(plain)
        assert (S.no_match(df, "hay", own).count() == 0) == bool(plain)
    if over is not None:
        assert rows(S.scan_overlapping(df, "hay", own)) == sorted(over, key=lambda m: (m[1], m[0], m[2]))


def test_case_insensitive(spark):
    df = spark.createDataFrame([(1, "hElLo É é")], "id int, hay string")
    assert rows(S.scan(df, "hay", make(["HeLlO", "é"], ci=True))) == [(0, 0, 5), (1, 9, 11)]
    assert rows(S.scan_overlapping(df, "hay", make(["HELLO", "L"], ci=True))) == [(0, 0, 5), (1, 2, 3), (1, 3, 4)]


@pytest.mark.parametrize("seed", range(4))
def test_random_bytes(spark, seed):
    """Two letters, so that overlaps do occur; native, joined and Arrow strategies agree with the definition."""
    rng = random.Random(seed)
    for ci in (False, True):
        literals = [bytes(rng.choice(b"abAB" if ci else b"ab\xe9") for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([2, 5, 9]))]
        texts = [bytes(rng.choice(b"abAB" if ci else b"ab\xe9") for _ in range(rng.randint(0, 30))) for _ in range(30)]
        low = (lambda b: b.lower()) if ci else (lambda b: b)
        df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "id int, hay binary")
        own = make(literals, ci)
        want = sorted((i, *m) for i, t in enumerate(texts) for m in leftmost_longest(low(t), [low(x) for x in literals]))
        for config in (ScanConfig(strategy="native"), ScanConfig(strategy="arrow")):
            got = sorted((r["id"], r["pattern_id"], r["start"], r["end"]) for r in S.scan(df, "hay", own, config=config).collect())
            assert got == want
        joined = S._scan_joined(df.select("id", df["hay"].alias("_hay")), ["id"], own, True)
        assert sorted((r["id"], r["pattern_id"], r["start"], r["end"]) for r in joined.collect()) == want
        want = sorted((i, *m) for i, t in enumerate(texts) for m in overlapping(low(t), [low(x) for x in literals]))
        for found in (S.scan_overlapping(df, "hay", own), S.scan_overlapping(df, "hay", own, config=ScanConfig(strategy="native")), chunk.scan_chunked(df, "hay", own, ["id"], ScanConfig().with_chunk_bytes(3))):
            assert sorted((r["id"], r["pattern_id"], r["start"], r["end"]) for r in found.collect()) == want


def test_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(None, None, "x"), (2, "abab", None)], "pattern_id int, hay string, start string")
    own = make(["ab"])
    assert S.scan(df, "hay", own, keep=[]).count() == 2
    with pytest.raises(ValueError, match="pattern_id"):
        S.scan(df, "hay", own)
    clashing = spark.createDataFrame([("k", "ab", "w")], "text string, hay string, window string")
    assert S.scan_overlapping(clashing, "hay", own).columns == ["text", "window", "pattern_id", "start", "end"]
    assert [r["n_matches"] for r in S.scan_count(df, "hay", own).collect()] == [None, 2]
    for config in (ScanConfig(), ScanConfig(strategy="native"), ScanConfig(strategy="arrow")):
        assert [len(r["matches"]) for r in S.scan_nested(df, "hay", own, config).collect()] == [0, 2]
    assert S.scan(df.limit(0), "hay", own, keep=[]).count() == 0
    assert S.no_match(df, "hay", own).count() == 1


def test_large_sets(spark):
    literals = [f"keyhole_{i:04d}" for i in range(892)]
    df = spark.createDataFrame([(1, " ".join(literals))], "id int, hay string")
    own = PatternSet.of(*literals)
    assert [r[0] for r in rows(S.scan(df, "hay", own))] == list(range(892))
    for n in (4999, 5001):
        big = PatternSet.of("collab%2Enet", *[f"p{i:08x}" for i in range(n)])
        hay = spark.createDataFrame([(1, "a collab%2Enet p00000007 collab%2Enet")], "id int, hay string")
        assert [r[0] for r in rows(S.scan(hay, "hay", big))] == [0, 8, 0]
    assert strategy(PatternSet.of(*[f"p{i:08x}" for i in range(30_000)]), operator="count") == "arrow"


def test_limits(spark):
    df = spark.createDataFrame([(1, "aaaa")], "id int, hay string")
    own = make(["a"])
    assert len(rows(S.scan(df, "hay", own, max_matches=5))) == 4
    assert rows(S.scan(df, "hay", own, first_n=2)) == [(0, 0, 1), (0, 1, 2)]
    with pytest.raises(Exception, match="MatchBufferOverflow"):
        S.scan(df, "hay", own, max_matches=4).collect()
    hits = S.scan(df, "hay", own)
    assert S.max_per_source(hits, ["id"], 5).count() == 4
    with pytest.raises(Exception, match="MatchBufferOverflow"):
        S.max_per_source(hits, ["id"], 4).collect()


def test_early_stops(spark, monkeypatch):
    """Limits end a scan: the rest of the haystack isn't looked at."""
    from needlework.operators import arrow

    own = make(["a", "re:[0-9]x"])
    data = b"a1x" * 100_000
    some = arrow.iterate(data, own)
    assert [next(some) for _ in range(3)] == [(0, 0, 1), (1, 1, 3), (3, 0, 4)]
    df = spark.createDataFrame([(1, "a1x" * 1000), (2, None), (3, "none")], "id int, hay string")
    assert rows(S.scan(df, "hay", own, first_n=3)) == [(0, 0, 1), (1, 1, 3), (0, 3, 4)]
    for config in (ScanConfig().with_max_matches(10), ScanConfig(strategy="native").with_max_matches(10)):
        with pytest.raises(Exception, match="MatchBufferOverflow"):
            S.scan(df, "hay", own, config=config).collect()
        assert S.scan(df.where("id > 1"), "hay", own, config=config).count() == 0
    with pytest.raises(Exception, match="MatchBufferOverflow"):
        S.scan_overlapping(df, "hay", make(["a"]), config=ScanConfig().with_max_matches(1000)).collect()
    loops = make(["re:(?:a|b)+c"])  # Python's
    assert [r["id"] for r in S.any_match(spark.createDataFrame([(1, "abac"), (2, "ab"), (3, None)], "id int, hay string"), "hay", loops).collect()] == [1]
    assert tuple(S.first_match(spark.createDataFrame([(1, "xabac")], "id int, hay string"), "hay", loops).first()["first_match"]) == (0, 1, 5)


def test_sieve_and_totals(spark):
    df = spark.createDataFrame([(i, f"text {i} {'needle ' * (i % 3)}", None) for i in range(30)] + [(99, None, "x")], "id int, hay string, other string")
    own = make(["needle", "text 1"])
    every = rows(S.scan(df, "hay", own, ["id"], ScanConfig(sieve=False)))
    assert rows(S.scan(df, "hay", own, ["id"])) == every
    assert rows(S.scan(S.spread(df), "hay", own, ["id"])) == every and S.spread(df.coalesce(1)).rdd.getNumPartitions() > 1
    totals = S.scan_totals(df, "hay", own, ["id"]).collect()
    hits = S.scan(df, "hay", own, ["id"]).collect()
    for r in totals:
        mine = [(h["start"], h["end"]) for h in hits if (h["id"], h["pattern_id"]) == (r["id"], r["pattern_id"])]
        assert (r["n_matches"], r["n_bytes"], r["least_start"], r["largest_end"]) == (len(mine), sum(e - s for s, e in mine), min(mine)[0], max(e for _, e in mine))
    assert len(totals) == len({(h["id"], h["pattern_id"]) for h in hits})


def test_errors():
    with pytest.raises(errors.EmptyPatternSet):
        PatternSet.builder().build()
    for add in ("literal", "regex"):
        with pytest.raises(errors.EmptyPattern) as e:
            getattr(PatternSet.builder().literal("x"), add)("").build()
        assert e.value.index == 1
    for bad in ("(a+)+", "(a*)*", "([0-9]+)+", "(?:a?){2}"):
        with pytest.raises(errors.PathologicalRegex) as e:
            PatternSet.builder().literal("ok").regex(bad).build()
        assert e.value.index == 1
    for bad in ("(", "a)", "[", "*a", "(?=a)", r"\1", "[é]", "a{2,1}", "(?u)a"):
        with pytest.raises(errors.PatternCompilationFailed):
            PatternSet.builder().regex(bad).build()
    for good in ("a+", "(x+)?", r"\w+\s*->", "(?P<n>a)b", "(?-u:a)", "[^]]"):
        PatternSet.builder().regex(good).build()
    with pytest.raises(ValueError):
        strategy(make(["re:a*"]), ScanConfig(strategy="native"))


def test_planner_and_config():
    assert describe(make(["a", "re:b+"]), operator="count")["strategy"] == "native"
    assert describe(make(["a", "re:b+"]))["strategy"] == "arrow" and describe(make(["a", "re:b+"]))["reason"] == "offsets come with the matches"
    assert describe(make(["re:(?:a|b)+c"]), operator="count")["strategy"] == "arrow"
    assert describe(make(["a"]))["sieve"] and not describe(make(["a", "re:b+"]))["sieve"]
    many = make([f"{i:03d}" for i in range(65)])
    assert describe(many, operator="first")["reason"] == "more than 64 literals" and describe(many, ScanConfig(strategy="native"))["ids"] == "join"
    own = ScanConfig().with_chunk_bytes(0)
    assert (own.chunk_bytes, own.overlap) == (1, 0)
    assert ScanConfig().with_chunk_bytes(10).with_overlap(99).overlap == 9
    assert make(["abc", "re:[0-9]{2,5}"]).max_match_len == 5


def test_deep_repetition(spark):
    df = spark.createDataFrame([(1, "ab" * 100_000)], "id int, hay string")
    assert rows(S.scan(df, "hay", make(["re:(?:a|b)+"]))) == [(0, 0, 200_000)]


def test_batches(spark):
    df = spark.createDataFrame([(100, "none"), (200, "a needle nn"), (300, "needle"), (400, None)], "id int, hay string")
    hits = S.scan(df, "hay", make(["needle"]))
    assert sorted((r["id"], r["start"]) for r in hits.collect()) == [(200, 2), (300, 0)]
    nested = batch.tagged_to_nested(hits, df, ["id"])
    assert {r["id"]: len(r["matches"]) for r in nested.collect()} == {100: 0, 200: 1, 300: 1, 400: 0}
    sizes = list(enumerate([4, 6, 1, 4]))
    assert batch.plan_batches(sizes, ScanConfig(batch_inputs=2, batch_bytes=7)) == [[1], [0], [3, 2]]
    items = spark.createDataFrame([(0, "abc"), (1, "def"), (2, "")], "id int, hay string")
    offsets = batch.coalesce_map(items, "id", "hay")
    found = spark.createDataFrame([(0, 2, 5), (0, 3, 5), (0, 0, 3)], "pattern_id int, start int, end int")
    assert sorted((r["id"], r["start"], r["end"]) for r in batch.decoalesce(found, offsets, bucket=2).collect()) == [(0, 0, 3), (1, 0, 2)]
    with pytest.raises(Exception, match="InputTooLarge"):
        batch.coalesce_map(items, "id", "hay", limit=6).collect()
    names = spark.createDataFrame([(f"k{i * 7 % 1000:03d}", "x" * (i % 9)) for i in range(1000)] + [(None, "null")], "id string, hay string")
    at = 0
    for r in sorted(batch.coalesce_map(names, "id", "hay").collect(), key=lambda r: (r["id"] is not None, r["id"])):
        assert r["offset"] == at
        at += r["length"]
    planned = batch.planned_batches(df, "id", "hay", ScanConfig(batch_inputs=2, batch_bytes=100))
    assert sorted((r["batch"], r["place"]) for r in planned.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_chunks(spark):
    assert chunk.shard_plan(100, 3, 8) == [(0, 33, 41), (33, 66, 74), (66, 100, 100)]
    hits = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 0, 5), (1, 0, 4, 6)], "id int, pattern_id int, start int, end int")
    assert chunk.shortest_by_start(hits, ["id"]).count() == 2
    assert rows(chunk.leftmost_longest(hits, ["id"])) == [(0, 0, 5)]


def test_regexes_in_chunks(spark):
    """As one scan of the whole haystack, wherever the chunks begin."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1\n") for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["1" * 25, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, hay string")
    own = make(["ab", "re:[0-9]{2,4}", "re:^a[ab]?", "re:b$", "re:\\bb{1,2}\\b"])
    literal = {"ab": 0}
    want = sorted((i, *m) for i, t in enumerate(texts) if t is not None for m in [(n, s, e) for s, n, e in scan_bytes(t.encode(), own) if n] + overlapping(t.encode(), [k.encode() for k in literal]))
    for size in (1, 2, 5, 100):
        got = chunk.scan_chunked(df, "hay", own, ["id"], ScanConfig().with_chunk_bytes(size)).collect()
        assert sorted((r["id"], r["pattern_id"], r["start"], r["end"]) for r in got) == want
    limited = chunk.scan_chunked(df, "hay", make(["re:1+"]), ["id"], ScanConfig().with_chunk_bytes(7), max_match_len=40).collect()
    assert sorted((r["id"], r["start"], r["end"]) for r in limited) == sorted((i, s, e) for i, t in enumerate(texts) for s, _, e in (scan_bytes(t.encode(), make(["re:1+"])) if t else []))
    for bad in (["re:1+"], ["re:1{0,2}"]):
        with pytest.raises(ValueError, match="limit|empty"):
            chunk.scan_chunked(df, "hay", make(bad), ["id"])


def test_index(spark, tmp_path):
    own = PatternSetBuilder().literal("a").literal_bytes(b"\xff\x00").named_regex("n", "b+").case_insensitive().build()
    save_index(spark, own, str(tmp_path / "x"))
    again = load_index(spark, str(tmp_path / "x"))
    assert again == own and again.names == (None, None, "n")
    meta = next((tmp_path / "x/metadata").glob("*.txt"))
    text = meta.read_text()
    for crc in (tmp_path / "x/metadata").glob(".*.crc"):
        crc.unlink()
    for bad in (text.replace("crc32\": ", "crc32\": 1"), text.replace("patterns\"", "other\""), text.replace("format_version\": 1", "format_version\": 2"), "{"):
        meta.write_text(bad)
        with pytest.raises(errors.IndexCorrupt):
            load_index(spark, str(tmp_path / "x"))
    with pytest.raises(errors.IndexCorrupt):
        load_index(spark, str(tmp_path / "none"))
    assert Path(tmp_path / "x/patterns").is_dir()


def feed(patterns, parts, mode="exact", **more):
    own = StreamScanner(make(patterns), mode, **more)
    out = [own.feed(p.encode()) for p in parts]
    return [[(i, s, e) for s, i, e in found] for found in [*out, own.finish()]]


def test_stream_scanner():
    flat = lambda *a, **k: [m for part in feed(*a, **k) for m in part]
    assert flat(["boundary"], ["boun", "dary"]) == [(0, 0, 8)]
    assert feed(["boundary"], ["boun", "dary"], EAGER) == [[], [(0, 0, 8)], []]
    assert flat(["abcd"], ["xxab", "cdyy"]) == [(0, 2, 6)]
    assert flat(["needle"], list("needle")) == [(0, 0, 6)]
    assert flat(["ab", "abc"], ["ab", "c"]) == [(1, 0, 3)]
    assert flat(["ab", "abc"], ["ab", "c"], EAGER) == [(0, 0, 2), (1, 0, 3)]
    assert flat(["ab", "ba"], list("abab")) == [(0, 0, 2), (0, 2, 4)]
    assert flat(["re:[0-9]{2,3}"], list("12345")) == [(0, 0, 3), (0, 3, 5)]
    assert flat(["re:^a"], ["b\n", "a", "a"]) == [(0, 2, 3)]
    with pytest.raises(ValueError):
        StreamScanner(make(["re:a+"]))


def test_stream_equals_scan():
    rng = random.Random(5)
    for _ in range(300):
        literals = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
        patterns = [*literals, *(["re:b[ab]{1,2}$", "re:^a"] if rng.random() < 0.3 else [])]
        data = "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 25)))
        parts, at = [], 0
        while at < len(data):
            n = rng.randint(1, 4)
            parts.append(data[at : at + n])
            at += n
        got = sorted(m for part in feed(patterns, parts) for m in part)
        assert got == sorted((i, s, e) for s, i, e in scan_bytes(data.encode(), make(patterns))), (patterns, parts)


def test_stream_state(spark, tmp_path):
    """A stream's state goes with its last chunk, or when nothing came for a while; chunks may come again."""
    import time

    schema = "stream_id long, seq int, data binary, eos boolean"

    def put(*chunks):
        spark.createDataFrame([(i, n, bytearray(d), e) for i, n, d, e in chunks], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = scan_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), make(["needle"]), idle_ms=1000)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination(60)
        got = sorted((r["stream_id"], r["start"]) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())
        return got, spark.read.format("statestore").load(str(tmp_path / "check")).count()

    assert put((1, 0, b"a nee", False), (1, 1, b"dle", True), (2, 0, b"xx needl", False), (3, 1, b"needle", True)) == ([(1, 2)], 2)
    assert put((2, 0, b"xx needl", False), (2, 1, b"e, needl", False), (3, 0, b"", False)) == ([(1, 2), (2, 3), (3, 0)], 1)
    time.sleep(1.5)
    assert put((4, 0, b"x", True))[1] == 0


def test_stream_limit():
    own = StreamScanner(make(["ab"]), limit=10)
    own.feed(b"12345")
    with pytest.raises(errors.InputTooLarge):
        own.feed(b"67890")
    again = StreamScanner(make(["ab"])).restore(own.state())
    assert [*again.feed(b"ab"), *again.finish()] == [(5, 0, 7)]


def test_hot_swap_and_udtf(spark):
    one, two = make(["a"]), make(["b"])
    own = HotSwapPatternSet(one)
    df = spark.createDataFrame([(1, "ab")], "id int, hay string")
    assert rows(df.transform(S.scanner("hay", own))) == [(0, 0, 1)]
    assert not own.swap(one) and own.swap(two)
    assert rows(df.transform(S.scanner("hay", own))) == [(0, 1, 2)]
    S.register_udtf(spark, "scan_test", two)
    df.createOrReplaceTempView("hays")
    assert rows(spark.sql("select pattern_id, start, end from hays, lateral scan_test(encode(hay, 'utf-8'))")) == [(0, 1, 2)]


def test_compat(spark):
    df = spark.createDataFrame([(1, "xaaa"), (2, "abcabc")], "id int, hay string")
    multi = lambda *p: sorted((r["id"], r["pattern_id"], r["start"], r["end"]) for r in S.scan(df, "hay", make(p), config=ScanConfig(compat="needle_by_needle")).collect())
    short = lambda *p: sorted((r["id"], r["pattern_id"], r["start"], r["end"]) for r in S.scan(df, "hay", make(p), config=ScanConfig(compat="shortest_all")).collect())
    assert multi("xa", "aa") == [(1, 0, 0, 2)]
    assert multi("ab", "abc") == [(2, 1, 0, 3), (2, 1, 3, 6)]
    assert short("abc", "ab", "ab", "bc") == [(2, 1, 0, 2), (2, 1, 3, 5), (2, 2, 0, 2), (2, 2, 3, 5)]
    with pytest.raises(ValueError):
        S.scan(df, "hay", make(["a"]), config=ScanConfig(compat="other"))
    assert [r["n"] for r in df.select(C.byte_count("hay", 97).alias("n")).collect()] == [3, 2]


def test_columns(spark):
    df = spark.createDataFrame([("aé foobar", b"\xff"), (None, None)], "t string, b binary")
    got = df.select(C.fnv1a32(F_lit("foobar")).alias("h"), C.fnv1a32(F_lit("")).alias("e"), C.redact("t", make(["foo", "é"]), "$1").alias("r"), C.match_texts("t", make(["é"])).alias("m")).first()
    assert got["h"] == 0xBF9CF968 and got["e"] == 2166136261 and got["r"] == "a$1 $1bar" and bytes(got["m"][0]).decode() == "é"


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)
