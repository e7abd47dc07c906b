"""Resampling, the audit of filters and token counts, against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from needlework.llm import audit, counting, resampling
from needlework.llm import queries as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", "  \n", "One two, ONE two one-two", "ÉCOLE école Straße x1 _ y", "a" * 50, "\x00\x7f", "日本 語テスト　日本", "word " * 30, "Word wörd " * 20]


def plain_features(text: str | None) -> tuple[int, list[int]]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    runs = words + [f"{a} {b}" for a, b in itertools.pairwise(words)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain_resample(docs: list[tuple], target: list[str | None]) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) in the order of ``docs``."""
    found = [plain_features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for (i, _), (n_words, f) in zip(docs, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    eligible = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = Counter()
    out = []
    ranks: dict[tuple, list[int]] = {}
    for k, r in enumerate(eligible[: 25 * len(eligible) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    for r in rows:
        own = ranks.get(r, [])
        out.append((*r[:4], own[drawn[r]] if drawn[r] < len(own) else None))
        drawn[r] += 1
    return out


key = lambda r: tuple((x is None, x or 0) for x in r)


def check_resample(spark, docs, target, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int")
    got = [tuple(r) for r in resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **options).collect()]
    assert sorted(got, key=key) == sorted(plain_resample(docs, target), key=key)


def test_resample_odd(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("ab cd efg Hé 12 x-y".split()) for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(5, "tie " * 25)] * 3 + [(None, "word " * 30)] * 2
    check_resample(spark, docs, ["ab cd", None, "one two"])
    check_resample(spark, docs, [])
    check_resample(spark, [], ["ab"])
    check_resample(spark, [(1, None)], ["ab"])


def test_resample_long(spark, monkeypatch):
    """Texts of several slices and blocks, among short ones."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=700_000 if i in (3, 4) else 50))) for i in range(9)] + [(4, "x" * 5_000_000 + " y")]
    check_resample(spark, docs, [" ".join(words[:500])])


def test_feature_hashes_in_slices(monkeypatch):
    text = " ".join(random.Random(5).choices("ab c defg hi".split(), k=500)).encode()
    whole = [sorted(np.concatenate([h for _, h in resampling.feature_hashes(text, g)]).tolist()) for g in (1, 2, 3, 5)]
    for size in (1, 7, 100):
        monkeypatch.setattr(resampling, "SLICE", size)
        for g, want in zip((1, 2, 3, 5), whole, strict=True):
            parts = list(resampling.feature_hashes(text, g))
            assert sum(n for n, _ in parts) == 500 and sorted(np.concatenate([h for _, h in parts]).tolist()) == want


def test_op11(spark, data_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").select("text").collect()]
    got = [tuple(r) for r in Q.op11_importance_resampling(spark, data_dir).collect()]
    assert sorted(got, key=key) == sorted(plain_resample(docs, target), key=key)
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_drawn_rows_alone_are_shuffled(spark):
    df = spark.range(1000).select("id", F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), (F.col("id") % 100).alias("score"))
    drawn = resampling.draw(df, F.col("id") >= 0, 10)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 90" in plan and "Window" in plan
    assert sorted(r["id"] for r in drawn.where("rank is not null").collect()) == sorted(i for i in range(1000) if i % 100 >= 90)


# -- 12 --------------------------------------------------------------------------
@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for k in audit.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == math.factorial(n)


def plain_walk(cells: dict[int, list[int]]) -> list[tuple]:
    rows, shapley = [], Counter()
    for order in itertools.permutations(range(5)):
        live = dict(cells)
        for k, f in enumerate(order):
            gone = {m: c for m, c in live.items() if m >> f & 1}
            live = {m: c for m, c in live.items() if not m >> f & 1}
            sums = [sum(c[j] for c in gone.values()) for j in range(3)]
            shapley[f] += sums[0]
            fails = sum(c[0] for m, c in cells.items() if m >> f & 1)
            rows.append(["".join("ABCDE"[x] for x in order), k + 1, sum(c[0] for c in live.values()), sums[0], fails - sums[0], cells.get(1 << f, [0])[0], sums[1], sums[2], f])
    return sorted((*r[:-1], shapley[r[-1]]) for r in rows)


def test_walk():
    rng = random.Random(6)
    for _ in range(20):
        cells = {m: [rng.randrange(9) for _ in range(3)] for m in rng.sample(range(32), rng.randrange(1, 33))}
        assert sorted(audit.walk(cells)) == plain_walk(cells)


def test_shapley_sums_to_what_is_removed():
    cells = {m: [m + 1, 0, 0] for m in range(32)}
    rows = audit.walk(cells)
    assert sum(r[-1] for r in rows[:5]) == 120 * sum(c[0] for m, c in cells.items() if m)


def test_audit_odd(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    texts = [None, "", " \t\n", "AB" * 5, "a$b", "x y " * 120, long, long, "word " * 150] + [f"w{i} " * 3 for i in range(40)]
    rows = [(i if i % 9 else None, ("en", None, "", "de")[i % 4], t, "clash", 1) for i, t in enumerate(texts * 2)] + [(3, "en", "AB" * 5, "again", 2)] * 2
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (None, 1, 1), (77, None, None), (5, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, part string, mask int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first: dict[str, int] = {}
    for i, _, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    cells: dict[str, dict[int, list[int]]] = {}
    for i, lang, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
        own = cells.setdefault(lang or "", {}).setdefault(sum(1 << k for k, x in enumerate(fails) if x), [0, 0, 0])
        good, toxic = (i is not None and any(a == i and x[k] == 1 for a, *x in labels) for k in (0, 1))
        for k, x in enumerate((1, good, toxic)):
            own[k] += x
    want = sorted((part, *r) for part, c in cells.items() for r in plain_walk(c))
    assert sorted(tuple(r) for r in audit.audit_filters(docs, marks).collect()) == want
    assert audit.audit_filters(docs.limit(0), marks).collect() == []
    assert len(audit.audit_filters(docs, marks.limit(0)).collect()) == 600 * len(cells)


def test_op12(spark, data_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    got = Q.op12_filter_audit(spark, data_dir).toPandas()
    want = con.sql(Q.ORACLE_SQL["op12_filter_audit"]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names and sorted(map(tuple, got[names].values.tolist())) == sorted(map(tuple, want[names].values.tolist()))


# -- 13 --------------------------------------------------------------------------
@pytest.fixture(scope="module")
def byte_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(byte_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_path)


ALPHABET = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　​﻿᠎abstLLve1²½,.!?'’-_<|>éΣ日🚀́"


def test_safe_pieces(library):
    rng = random.Random(8)
    count = lambda t: len(library.encode(t, add_special_tokens=False))
    texts = ["".join(rng.choices(ALPHABET + " " * 8 + rng.choice(["'", "<|endoftext|>", "a"]), k=rng.randrange(60))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "it's we'll I'LL 'd", "\n\n\n x  y \n", " " * 9, "a" + " " * 9]
    for t in texts:
        pieces = counting.safe_pieces(t)
        assert "".join(pieces) == t and sum(map(count, pieces)) == count(t), t


def test_long_pieces_and_slices(library, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(counting, "LONG", 8)
    count = lambda t: len(library.encode(t, add_special_tokens=False))
    for _ in range(800):
        t = "".join(rng.choice(["ab", "Z9", "'s", "x'll1", "<|endoftext|>", "/=+", "12", "é", "　", " ", "\n"]) for _ in range(rng.randrange(40)))
        parts = list(counting.slices(t, 5))
        pieces = [p for x in parts for p in counting.safe_pieces(x)]
        assert "".join(pieces) == t and sum(map(count, pieces)) == count(t), t


def test_balanced():
    texts = ["x" * n for n in (5, 900, 40, 1, 3000, 300, 12)] + ["é" * 100]
    batches = list(counting.balanced(texts, 1000))
    assert sorted(t for b in batches for t in b) == sorted(texts)
    assert all(len(b) == 1 or sum(len(t.encode()) + 100 for t in b) <= 1100 for b in batches)
    assert list(counting.balanced([])) == []


def test_memory_is_bounded(byte_path):
    own = counting.Counter(byte_path, keep=10)
    texts = [f"w{i} x{i} y" for i in range(50)]
    assert own.counts(texts, budget=20) == counting.Counter(byte_path).counts(texts)
    assert len(own.known) <= 20


def test_count_tokens_odd(spark, byte_path, library):
    texts = [None, "", " ", "<|endoftext|>", "a" * 100_000, "ab1" * 50_000, "word " * 300_000, "日本" * 500, "x\x1c!y", "it's"] * 2
    df = spark.createDataFrame([(i if i % 3 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in counting.count_tokens(df, byte_path).collect()), key=key)
    n = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    want = sorted(((i if i % 3 else None, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(enumerate(texts), n, strict=True)), key=key)
    assert got == want
    assert counting.count_tokens(df.limit(0), byte_path).collect() == []


def test_other_files_are_refused(path):
    with pytest.raises(ValueError):
        counting.check(path)


def test_op13(spark, data_dir, library):
    rows = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False))) for r in rows)
    got = sorted(tuple(r) for r in Q.op13_token_counts(spark, data_dir).collect())
    assert [g[:3] for g in got] == want and all(g[3] == (g[2] > 1024) for g in got)
