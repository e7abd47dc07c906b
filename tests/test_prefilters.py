"""What is left out before the exact scan: regexes without a needed literal, stretches without a literal."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from needlework.operators import ensemble, regions
from needlework.operators import scan as S
from needlework.operators.arrow import compiled
from needlework.plans.factors import LONGEST, MOST, required_of
from needlework.plans.patterns import PatternSet, PatternSetBuilder
from needlework.plans.planner import ScanConfig


# -- needed literals -------------------------------------------------------------------
@pytest.mark.parametrize(
    ("regex", "want"),
    [
        ("abc[0-9]+", {b"abc"}), ("[0-9]+abc", {b"abc"}), ("a[0-9]bcd", {b"bcd"}), ("foo|bar", {b"foo", b"bar"}), ("(?:foo|bar)[a-z]", {b"foo", b"bar"}), ("foo|[a-z]+", None), ("(?:abc)?d", {b"d"}),
        ("a*", None), ("[a-z]+", None), ("x[ab]y", {b"xay", b"xby"}), ("(?:ab){3}", {b"ababab"}), ("(?:ab){2,}c", {b"abab"}), ("\\bword\\b", {b"word"}), ("^$", None), ("[^a]b.", {b"b"}), ("(?i)ab", {b"ab", b"Ab", b"aB", b"AB"}),
        ("[a-c]{2}z", {b"aaz", b"abz", b"acz", b"baz", b"bbz", b"bcz", b"caz", b"cbz", b"ccz"}), ("https?://", {b"http://", b"https://"}), ("a.{3}long", {b"long"}), ("(?:a|b|){2}q", {b"q"}),
    ],
)
def test_required(regex, want):
    assert required_of(regex) == want


def random_regex(rng: random.Random, depth: int = 3) -> str:
    kind = rng.randrange(7 if depth else 2)
    if kind < 2:
        return rng.choice(["a", "b", "ab", "[ab]", "c", ".", "[^a]", "bca", "\\b"])
    if kind == 2:
        return f"(?:{random_regex(rng, depth - 1)}|{random_regex(rng, depth - 1)})"
    if kind == 3:
        return rng.choice(["a", "b", "[bc]", "(?:abc)"]) + rng.choice(["?", "{2}", "{1,3}", "+", "*", "{2,}"])
    return random_regex(rng, depth - 1) + random_regex(rng, depth - 1)


def test_required_is_in_every_match():
    rng = random.Random(3)
    known = 0
    for _ in range(3000):
        source = random_regex(rng)
        try:
            own = PatternSetBuilder().regex(source).build()
        except Exception:
            continue
        if not own.regexes:
            continue
        needed, regex = required_of(source), compiled(own)[2][0][1]
        if needed is None:
            continue
        known += 1
        assert 0 < len(needed) <= MOST and all(0 < len(x) <= LONGEST * 2 for x in needed)
        for _ in range(10):
            for m in regex.finditer("".join(rng.choices("abcd\n", k=30)).encode()):
                assert any(x in m.group() for x in needed), (source, needed, m.group())
    assert known > 1000


@pytest.mark.parametrize("fold", [False, True])
def test_flags_indexed(spark, fold):
    """500 regexes and literals: as each by itself."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdE", k=rng.randint(2, 5))) for _ in range(120)]
    own = PatternSetBuilder().case_insensitive(fold)
    sources = []
    for k in range(500):
        w, v = rng.choice(words), rng.choice(words)
        kind = k % 5
        source = (f"{w}[0-9]+", f"(?:{w}|{v})\\b", f"{w}.?{v}", f"[a-c]{{2}}{w}", "[d-e]{3,5}")[kind]
        if k % 50 == 7:
            own.literal(w)
            sources.append(re.escape(w))
        else:
            own.regex(source)
            sources.append(source)
    patterns = own.build()
    texts = ["".join(rng.choices("abcdeE1 ", k=rng.randint(0, 80))) for _ in range(60)] + [None, "", words[0] + words[1]]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id int, hay string, flags string")
    plain = [re.compile(s.encode(), re.IGNORECASE if fold and i in {x for x, _ in patterns.literals} else 0) for i, s in enumerate(sources)]
    for r in ensemble.flags_indexed(df, "hay", patterns).collect():
        t = texts[r["id"]]
        assert r["flags"] == (None if t is None else [bool(p.search(t.encode())) for p in plain])
    assert ensemble.flags_indexed(df.limit(0), "hay", patterns).collect() == []


def test_few_regexes_run():
    patterns = PatternSetBuilder().regex("needle[0-9]").regex("hay[a-z]+stack").regex("[0-9]{3}").literal("pin").build()
    assert ensemble.named(b"nothing here", patterns) == {2}
    assert ensemble.named(b"a needle and a pin", patterns) == {0, 2, 3}
    long = "x" * 200
    assert ensemble.named(long.encode(), PatternSet.of(long)) == {0}


# -- stretches ---------------------------------------------------------------------------
def as_scan(spark, texts, patterns, window, monkeypatch):
    monkeypatch.setattr(regions, "WINDOW", window)
    df = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)], "id int, hay binary").coalesce(1)
    key = lambda r: tuple(r)
    return sorted(map(key, regions.scan_regions(df, "hay", patterns).collect())), sorted(map(key, S.scan(df, "hay", patterns).collect())), df


@pytest.mark.parametrize("seed", range(4))
def test_regions_equal_scan(spark, monkeypatch, seed):
    rng = random.Random(seed)
    word = lambda n, of=b"abcAB": bytes(rng.choice(of) for _ in range(n))
    texts = [word(rng.randint(0, 300), rng.choice([b"abcAB", b"abc" + bytes(range(128, 200)), b"z"])) for _ in range(40)] + [None, b""]
    literals = [word(rng.randint(1, 6)) for _ in range(rng.choice([1, 5, 80]))]
    for fold in (False, True):
        got, want, _ = as_scan(spark, texts, PatternSet.of(*literals, case_insensitive=fold), rng.choice([7, 32, 4096]), monkeypatch)
        assert got == want


def test_regions_across_haystacks_and_windows(spark, monkeypatch):
    texts = [b"nee", b"dle", b"x" * 60 + b"needle" + b"x" * 60 + b"needleneedle", b"needle"]
    got, want, df = as_scan(spark, texts, PatternSet.of("needle", "needles", "e"), 64, monkeypatch)
    assert got == want and len(want)
    with pytest.raises(ValueError, match="literals only"):
        regions.scan_regions(df, "hay", PatternSetBuilder().regex("a+").build())
    with pytest.raises(Exception, match="MatchBufferOverflow"):
        regions.scan_regions(df, "hay", PatternSet.of("needle"), config=ScanConfig().with_max_matches(3)).collect()
    with pytest.raises(ValueError, match="names"):
        regions.scan_regions(df.withColumn("start", F.lit(1)), "hay", PatternSet.of("a"))


def test_little_is_read(spark):
    """Random bytes with one needle in 100 KB: less than a hundredth of them is scanned, and all needles are found."""
    rng = random.Random(9)
    texts = [rng.randbytes(100_000) + b"S3CR3T_K3Y" + rng.randbytes(1000) for _ in range(8)] + [b"\x00" * 50_000]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "id int, hay binary")
    patterns = PatternSet.of("S3CR3T_K3Y", "AKIAQ9")
    assert regions.scan_regions(df, "hay", patterns).count() == 8
    share = regions.bytes_read(df, "hay", patterns).agg(F.sum("n_bytes").alias("a"), F.sum("n_read").alias("b")).first()
    assert share["a"] == sum(map(len, texts)) and share["b"] < share["a"] / 100
