"""Operators that compare documents with each other, and the pipeline."""

from __future__ import annotations

import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from needlework.llm import common, language, packing, probminhash, search, substring, words
from needlework.llm import queries as Q

ROOT = Path(__file__).resolve().parents[2]
VOCABULARY = [f"w{i}" for i in range(2000)]


def prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(VOCABULARY) for _ in range(n)]


def frame(spark, rows, parts: int = 3):
    """(doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, d int").repartition(parts)


# -- common ------------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(200 + i, 200 + (i * 7) % 31) for i in range(31)] + [(5, 5), (rng.randrange(300, 320), rng.randrange(300, 320))]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_of_key(spark):
    rows = [(i, "hot" if i % 2 else f"k{i % 11}") for i in range(300)] + [(7, "hot"), (None, "k1")]
    got = common.first_of_key(spark.createDataFrame(rows, "id long, key string"), "key", "id", salts=8).collect()
    least = {k: min(i for i, x in rows if x == k and i is not None) for _, k in rows}
    assert Counter((r["id"], r["key"], r["first_id"]) for r in got) == Counter((i, k, least[k]) for i, k in rows)


# -- 4 -------------------------------------------------------------------------------
def brute_search(rows, queries, k):
    docs = [(i, Counter(search.terms_of(t or "")[0].repeat(search.terms_of(t or "")[1]).tolist())) for i, t in rows if i is not None]
    df = Counter(t for _, c in docs for t in c)
    mean = sum(sum(c.values()) for _, c in docs) / len(docs)
    out = set()
    for q, text in queries:
        if q is None or text is None:
            continue
        terms = set(search.terms_of(text)[0].tolist())
        scored = []
        for i, c in docs:
            s = sum(np.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in terms if t in c)
            if s > 0:
                scored.append((-round(s, 6), i))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize(("shard_docs", "query_terms"), [(1 << 16, 1_000_000), (40, 300)])
def test_search(spark, monkeypatch, shard_docs, query_terms):
    monkeypatch.setattr(search, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(search, "QUERY_TERMS", query_terms)
    rng = random.Random(4)
    common_words = [f"c{i}" for i in range(8)]
    rows = [(i, " ".join(rng.choice(common_words) if rng.random() < 0.6 else rng.choice(VOCABULARY[:300]) for _ in range(rng.randint(0, 80)))) for i in range(250)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, ""), (None, rows[5][1]), (1004, "c1 " * 20_000), (7, "c1 c2")]
    queries = [r for r in rows if r[0] is not None and r[0] % 25 == 0] + [(5, rows[5][1]), (9001, "nowhere else"), (9002, None), (9003, "!")]
    got = search.top_k(frame(spark, rows), spark.createDataFrame(queries, "doc_id long, text string"), k=5).collect()
    want = brute_search(rows, queries, 5)
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in got} == {x[:3] for x in want}
    scores = {x[:3]: x[3] for x in want}
    assert all(abs(r["score"] - scores[r["query_id"], r["rank"], r["doc_id"]]) < 2e-6 for r in got)


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search.top_k(none, some).count() == 0 == search.top_k(some, none).count()


def test_pruning_is_used():
    rng = np.random.default_rng(1)
    docs = [" ".join(f"t{int(x)}" for x in np.minimum(rng.zipf(1.3, 60), 5000)) for _ in range(3000)]
    row = {"ids": np.arange(3000).tobytes()}
    found = [search.terms_of(t) for t in docs]
    lengths = np.array([c.sum() for _, c in found])
    term, count, doc = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found]), np.repeat(np.arange(3000), [len(t) for t, _ in found])
    order = np.argsort(term, kind="stable")
    first = np.flatnonzero(np.diff(term[order], prepend=term[order][0] ^ np.uint64(1)))
    row |= {"lengths": lengths.tobytes(), "terms": term[order][first].tobytes(), "offsets": np.append(first, len(term)).tobytes(), "posting_docs": doc[order].astype(np.uint16).tobytes(), "posting_counts": count[order].astype(np.uint32).tobytes()}
    shard = search.Shard(row, lengths.mean())
    idf = np.log1p((3000 - np.diff(shard.offsets) + 0.5) / (np.diff(shard.offsets) + 0.5))
    tried = []
    shard._full = lambda docs, *a, f=shard._full: tried.append(len(docs)) or f(docs, *a)
    every = lambda at: np.bincount(shard.docs, shard.impacts * np.repeat(np.isin(np.arange(len(shard.terms)), at) * idf, np.diff(shard.offsets)), 3000)
    with_floor = [0, 0]
    for q in range(50):
        terms = found[q][0]
        at = np.searchsorted(shard.terms, terms)
        ids, scores = shard.search(terms, idf[at], 10)
        full = np.round(every(at), search.DECIMALS)
        best = np.lexsort((shard.ids, -full))[:10]
        assert ids.tolist() == shard.ids[best].tolist() and np.allclose(scores, full[best], atol=2e-6)
        floor = float(scores[4])
        before = shard.postings, shard.decoded
        ids, scores = shard.search(terms, idf[at], 10, floor)
        with_floor = [with_floor[0] + shard.postings - before[0], with_floor[1] + shard.decoded - before[1]]
        assert [i for i, s in zip(ids.tolist(), scores, strict=True) if s >= floor] == [i for i in shard.ids[best].tolist() if full[np.flatnonzero(shard.ids == i)[0]] >= floor]
    assert tried and np.mean(tried) < 1500
    # most of the lists lies in blocks, and in terms, that can't reach the threshold
    assert with_floor[1] < 0.5 * with_floor[0]


@pytest.mark.parametrize("dense", [1, 40, 256])
def test_many_queries_at_once(monkeypatch, dense):
    """Results are those of one query at a time, with any threshold; the lists of frequent terms aren't decoded for each."""
    monkeypatch.setattr(search, "DENSE_TERMS", dense)
    monkeypatch.setattr(search, "PRODUCT_SIZE", 7 * 2000)
    rng = np.random.default_rng(2)
    found = [search.terms_of(" ".join(f"t{int(x)}" for x in np.minimum(rng.zipf(1.3, 40), 3000))) for _ in range(2000)]
    lengths = np.array([c.sum() for _, c in found])
    term, count, doc = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found]), np.repeat(np.arange(2000), [len(t) for t, _ in found])
    order = np.argsort(term, kind="stable")
    first = np.flatnonzero(np.diff(term[order], prepend=term[order][0] ^ np.uint64(1)))
    row = {"ids": np.arange(2000).tobytes(), "lengths": lengths.tobytes(), "terms": term[order][first].tobytes(), "offsets": np.append(first, len(term)).tobytes(), "posting_docs": doc[order].astype(np.uint16).tobytes(), "posting_counts": count[order].astype(np.uint32).tobytes()}
    shard = search.Shard(row, lengths.mean())
    idf = np.log1p((2000 - np.diff(shard.offsets) + 0.5) / (np.diff(shard.offsets) + 0.5))
    asked = [*[t for t, _ in found[:60]], found[0][0] ^ np.uint64(5)]  # the last one has terms that the shard hasn't
    weights = [idf[np.minimum(np.searchsorted(shard.terms, t), len(idf) - 1)] for t in asked]
    one = [shard.search(t, w, 10) for t, w in zip(asked, weights, strict=True)]
    decoded = []
    for floors in ([0.0] * 61, [float(s[n % 10]) if len(s) else 1.0 for n, (_, s) in enumerate(one)]):
        before = shard.decoded
        single = [shard.search(t, w, 10, f) for t, w, f in zip(asked, weights, floors, strict=True)]
        middle = shard.decoded
        got = {q: (i, s) for q, i, s in shard.search_all(np.cumsum([0, *map(len, asked)]).tolist(), np.concatenate(asked), np.concatenate(weights), 10, floors)}
        decoded.append((middle - before, shard.decoded - middle))
        for q, (ids, scores) in enumerate(single):
            mine = got.get(q, (np.zeros(0, np.int64), np.zeros(0)))
            reached = lambda i, s, f=floors[q]: [(int(x), round(float(y), 6)) for x, y in zip(i, s, strict=True) if y >= f]
            assert reached(*mine) == reached(ids, scores)
    assert not len(one[60][0]) and (dense < 256 or all(y < x / 2 for x, y in decoded))


def test_blocks_are_skipped():
    """Documents of two kinds that share some terms: the blocks of the other kind are no pivots."""
    kinds = [" ".join(["all"] * (n % 3 + 1) + [f"{'ab'[n >= 640]}{n % 40 + i}" for i in range(12)]) for n in range(1280)]
    found = [search.terms_of(t) for t in kinds]
    term, count, doc = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found]), np.repeat(np.arange(1280), [len(t) for t, _ in found])
    order = np.argsort(term, kind="stable")
    first = np.flatnonzero(np.diff(term[order], prepend=term[order][0] ^ np.uint64(1)))
    lengths = np.array([c.sum() for _, c in found])
    row = {"ids": np.arange(1280).tobytes(), "lengths": lengths.tobytes(), "terms": term[order][first].tobytes(), "offsets": np.append(first, len(term)).tobytes(), "posting_docs": doc[order].astype(np.uint16).tobytes(), "posting_counts": count[order].astype(np.uint32).tobytes()}
    shard = search.Shard(row, lengths.mean())
    idf = np.log1p((1280 - np.diff(shard.offsets) + 0.5) / (np.diff(shard.offsets) + 0.5))
    seen = []
    shard._decode = lambda entries, *a, f=shard._decode: seen.extend(shard.block_of[entries].tolist()) or f(entries, *a)
    ids, _ = shard.search(found[5][0], idf[np.searchsorted(shard.terms, found[5][0])], 10)
    assert len(ids) == 10 and max(ids) < 640 and seen and max(seen) < 640 // search.BLOCK


@pytest.mark.parametrize("waves", [1, 4])
def test_search_of_tables(spark, monkeypatch, data_dir, waves):
    """The registered query against brute force over the whole table, in one wave and in several."""
    if waves > 1:
        monkeypatch.setattr(search, "SHARD_DOCS", 9)
        monkeypatch.setattr(search, "FIRST_WAVE", 1)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    got = Q.op4_topk_search(spark, data_dir).collect()
    want = brute_search(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in got} == {x[:3] for x in want}


# -- 5 -------------------------------------------------------------------------------
def test_chains_are_optimal():
    """Against a quadratic definition of the best score."""
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 9)
        s = sorted(rng.randrange(60) for _ in range(n))
        e = [x + rng.randint(6, 15) for x in s]
        r = [rng.randrange(60) for _ in range(n)]
        cost, slack = 0.25, 5
        score = []
        for i in range(n):
            ends = [(e[j] - slack, r[j] + e[j] - s[j] - slack) for j in range(i)]
            gains = [score[j] - cost * (s[i] - e[j] + r[i] - (r[j] + e[j] - s[j])) for j, (x, y) in enumerate(ends) if x <= s[i] and y <= r[i]]
            score.append(e[i] - s[i] + max([0, *gains]))
        found = substring.chains(s, e, r, slack, cost)
        assert sorted(i for c in found for i in c) == list(range(n))
        own = found[0]
        total = sum(e[i] - s[i] for i in own) - sum(cost * (s[b] - e[a] + r[b] - (r[a] + e[a] - s[a])) for a, b in zip(own, own[1:], strict=False))
        assert abs(total - max(score)) < 1e-9


def test_seeds_guarantee():
    rng = random.Random(3)
    for _ in range(100):
        run = prose(rng, substring.K + substring.WINDOW - 1)
        sets = []
        for _ in range(2):
            text = " ".join([*prose(rng, rng.randint(0, 50)), *run, *prose(rng, rng.randint(0, 50))])
            sets.append(set(substring.seeds(words.words_of(text)[3])[1].tolist()))
        assert sets[0] & sets[1]


def covered(rows, found):
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append((r["start_char"], r["end_char"]))
    return {i: [t[a:b] for a, b in sorted(by[i])] for i, t in rows if i in by}


@pytest.mark.parametrize("batch", [substring.BATCH_SEEDS, 60])
def test_passages(spark, monkeypatch, batch):
    monkeypatch.setattr(substring, "BATCH_SEEDS", batch)
    rng = random.Random(5)
    passage, other, short = prose(rng, 70), prose(rng, 120), prose(rng, 40)
    fuzzy = list(other)
    for k in (20, 50, 51, 90):
        fuzzy[k] = "edited"
    del fuzzy[70]
    around = lambda mid: " ".join([*prose(rng, 30), *mid, *prose(rng, 25)])
    rows = [(i, " ".join(prose(rng, 80))) for i in range(40)]
    rows += [(100 + i, around(["STARTS.", *passage, "ends;"])) for i in range(15)]
    rows += [(200, around(other)), (201, around(fuzzy)), (202, around(short)), (203, around(short))]
    rows += [(204, " ".join(prose(rng, 60) * 1)), (205, None), (206, ""), (None, " ".join(passage)), (207, "ab " * 30_000), (208, "ab " * 30_000)]
    mosaic = [*passage[:35], *other[-35:]]
    rows += [(209, around(mosaic))]
    found = substring.repeated_passages(frame(spark, rows)).collect()
    got = covered([r for r in rows if r[0] is not None], found)
    assert set(got) == {*range(101, 115), 201, 208}  # 209 is of two documents, of which neither has 50 words of it
    for i in range(101, 115):
        assert got[i] == ["STARTS. " + " ".join(passage) + " ends"]
    assert len(got[201]) == 1 and got[201][0].split()[5:-5] == fuzzy[5:-5]
    ids = {r["doc_id"]: set(r["other_ids"]) for r in found}
    assert all(x < i for i, own in ids.items() for x in own) and 200 in ids[201]
    left = {r["doc_id"]: r["text"] for r in substring.remove_passages(frame(spark, rows), substring.repeated_passages(frame(spark, rows))).collect()}
    assert 208 not in left and len(left) == len(rows) - 1
    for i, t in rows:
        if i in got and i != 208:
            want = t
            for piece in got[i]:
                want = want.replace(piece, "", 1)
            assert left[i] == want
        elif i != 208:
            assert left[i] == t
    assert substring.repeated_passages(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("batch", [substring.BATCH_SEEDS, 60])
def test_passages_of_scattered_seeds(spark, monkeypatch, batch):
    """An exact passage whose seeds were all seen earlier, each in another document."""
    monkeypatch.setattr(substring, "BATCH_SEEDS", batch)
    rng = random.Random(15)
    passage = prose(rng, 60)
    around = lambda mid: " ".join([*prose(rng, 30), *mid, *prose(rng, 30)])
    rows = []
    for i in range(120):
        k = rng.randrange(51) if i > 50 else i
        rows.append((i, around(passage[k : k + 10])))
    rows += [(200, around(passage[:45])), (300, around(passage)), (301, around(passage)), (302, around(passage[5:57]))]
    found = substring.repeated_passages(frame(spark, rows)).collect()
    got = covered(rows, [r for r in found if r["doc_id"] > 300])
    assert got == {301: [" ".join(passage)], 302: [" ".join(passage[5:57])]}


@pytest.mark.parametrize(("length", "edits", "even", "least"), [(60, 3, True, 0.95), (60, 5, False, 0.95), (60, 5, True, 0.95), (60, 8, False, 0.9), (60, 8, True, 0.9), (52, 5, False, 0.9), (80, 16, False, 0.9), (80, 16, True, 0.9), (100, 19, True, 0.9), (200, 40, False, 0.9)])
def test_passages_that_are_edited(spark, length, edits, even, least):
    """Share of the passages found, of substitutions in one of two documents."""
    rng = random.Random(length * 100 + edits)
    rows = []
    for i in range(60):
        passage = [f"p{i}x{k}" for k in range(length)]
        copy = list(passage)
        for n, k in enumerate([(n + 1) * (length + 1) // (edits + 1) - 1 for n in range(edits)] if even else rng.sample(range(1, length - 1), edits)):
            copy[k] = f"e{i}x{n}"
        around = lambda mid, name, i=i: " ".join([*[f"{name}{i}x{k}" for k in range(30)], *mid, *[f"{name}{i}y{k}" for k in range(30)]])
        rows += [(i, around(passage, "a")), (1000 + i, around(copy, "b"))]
    found = substring.repeated_passages(frame(spark, rows)).collect()
    assert all(r["other_ids"] == [r["doc_id"] - 1000] for r in found)
    assert len({r["doc_id"] for r in found}) >= least * 60


@pytest.mark.parametrize("batch", [substring.BATCH_SEEDS, 60])
@pytest.mark.parametrize("size", [8, 16])
def test_edited_passages_of_scattered_seeds(spark, monkeypatch, batch, size):
    """Edited passages of which one document has all, and many later ones a part that has its seeds too."""
    monkeypatch.setattr(substring, "BATCH_SEEDS", batch)
    rng = random.Random(17)
    around = lambda mid: " ".join([*prose(rng, 70), *mid, *prose(rng, 70)])
    rows, want = [], {}
    for i in range(5):
        passage = prose(rng, 70)
        copy = [f"e{i}x{k}" if k % 9 == 8 else w for k, w in enumerate(passage)]
        rows.append((i, around(passage)))
        # each part is had by several documents, and what starts in one ends in another
        rows += [(100 * i + 10 + n, around(passage[k : k + size])) for n, k in enumerate([*range(0, 70, size // 2)] * 2)]
        rows.append((1000 + i, around(copy)))
        want[1000 + i] = " ".join(copy)
    found = substring.repeated_passages(frame(spark, rows)).collect()
    got = covered(rows, found)
    assert set(got) == set(want)
    for i, text in want.items():
        assert len(got[i]) == 1 and text in got[i][0] and len(got[i][0].split()) < 80
    assert all(r["doc_id"] - 1000 in r["other_ids"] for r in found)


def test_pipeline_cuts_edited_passages_of_scattered_seeds(spark):
    """The stage removes an edited passage whose seeds later documents have too, each a part."""
    rng = random.Random(19)
    passage = prose(rng, 70)
    copy = [f"e{k}" if k % 9 == 8 else w for k, w in enumerate(passage)]
    around = lambda mid: " ".join([*prose(rng, 70), *mid, *prose(rng, 70)])
    rows = [(1, around(passage)), *[(10 + n, around(passage[k : k + 8])) for n, k in enumerate([*range(0, 70, 4)] * 2)], (100, around(copy))]
    docs = frame(spark, rows).selectExpr("*", "length(text) as n_chars")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert all(left[i] == text for i, text in rows[:-1])
    assert left[100] != rows[-1][1] and not {w for k, w in enumerate(copy) if k % 9 == 8} & set(left[100].split())


@pytest.mark.parametrize("repeats", [40, 3000])
def test_edited_passages_of_texts_that_repeat(spark, repeats):
    """What repeats is compared as a whole, also where later texts have a part of it."""
    rng = random.Random(18)
    unit = prose(rng, 30)
    long = unit * repeats
    edited = [f"e{k}" if k % 9 == 8 else w for k, w in enumerate(long)]
    around = lambda mid: " ".join([*prose(rng, 70), *mid, *prose(rng, 70)])
    rows = [(1, around(long)), *[(10 + n, around(unit[k : k + 8])) for n, k in enumerate(range(0, 24, 4))], (100, around(edited))]
    found = [r for r in substring.repeated_passages(frame(spark, rows)).collect() if r["doc_id"] == 100]
    assert sum(r["n_words"] for r in found) >= 0.95 * len(edited) and all(r["other_ids"] == [1] for r in found)


def test_requests_to_all_are_slim(spark, monkeypatch):
    """A line that a text has twice is no pair of one that has it once; where texts repeat, a place has two seeds of the other at most."""
    made = []
    asked_of_all = substring._asked_of_all

    def kept(*args):
        out = asked_of_all(*args)
        made.append(out.collect())
        return out

    monkeypatch.setattr(substring, "_asked_of_all", kept)
    rng = random.Random(20)
    line = prose(rng, 13)
    rows = [(i, " ".join([*prose(rng, 30), *line, *prose(rng, 30)])) for i in range(20)]
    rows += [(100, " ".join([*line, *prose(rng, 11), *line]))]
    unit = prose(rng, 30)
    edited = lambda n, step: [f"e{n}x{k}" if k % step == step - 1 else w for k, w in enumerate(unit * 20)]
    rows += [(200 + n, " ".join(edited(n, 31 + 6 * n))) for n in range(2)]
    assert {r["doc_id"] for r in substring.repeated_passages(frame(spark, rows)).collect()} <= {201}
    assert made and all(r["d"] != 100 for r in made[0])
    for r in made[0]:
        p = np.frombuffer(r["seeds"], np.int32).reshape(2, -1)[0]
        assert np.unique(p, return_counts=True)[1].max() <= 2


@pytest.mark.parametrize("repeated", [False, True])
def test_lines_that_many_have_are_no_requests(spark, monkeypatch, repeated):
    """Texts that share a line, or a word that repeats, but not 40 words of 50, aren't compared, however many there are; those that do are found."""
    made = []
    asked_of_all = substring._asked_of_all

    def kept(*args):
        out = asked_of_all(*args)
        made.append({(r["d"], r["rd"]) for r in out.collect()})
        return out

    monkeypatch.setattr(substring, "_asked_of_all", kept)
    monkeypatch.setattr(substring, "PAIR_DOCS", 7)
    rng = random.Random(21)
    line = ["la"] * 42 if repeated else prose(rng, 33)
    own = lambda name, n: [f"{name}x{k}" for k in range(n)]
    rows = [(i, " ".join([*own(f"a{i}", 50), *line, *own(f"b{i}", 50)])) for i in range(40)]
    # after the line the passage of document 20 goes on, in eight words of ten
    after = [f"e{k}" if k % 5 == 4 else w for k, w in enumerate(own("b20", 40))]
    rows += [(100, " ".join([*own("c", 50), *line, *after, *own("d", 30)]))]
    found = substring.repeated_passages(frame(spark, rows)).collect()
    assert [(r["doc_id"], r["other_ids"]) for r in found] == [(100, [20])] and found[0]["n_words"] > 60
    assert made and made[0] <= {(100, 20)}


def test_no_passage_of_phrases(spark):
    """A text of phrases, each from another document, isn't a passage, however they tile; nor are phrases of one document in another order."""
    rng = random.Random(16)
    phrases = [prose(rng, 10) for _ in range(6)]
    around = lambda mid: " ".join([*prose(rng, 30), *mid, *prose(rng, 30)])
    rows = [(i, around(x)) for i, x in enumerate(phrases)]
    rows += [(10, around([w for x in phrases for w in x]))]
    rows += [(20, around([w for x in phrases[::-1] for w in [*x, *prose(rng, 20)]]))]
    assert substring.repeated_passages(frame(spark, rows)).collect() == []


def test_passages_are_in_one_document(spark, data_dir):
    """Of every passage one document that it names has 50 words or more in order, four fifths of a stretch of as many."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    found = Q.op5_substring_dedup(spark, data_dir).collect()
    assert found
    for r in found:
        own = substring._positions(texts[r["doc_id"]][r["start_char"] : r["end_char"]])[0].tolist()
        best = 0
        for other in r["other_ids"]:
            theirs = substring._positions(texts[other])[0].tolist()
            best = max(best, substring.common_words(own, theirs))
        assert best >= 40, (r["doc_id"], best, len(own))


def test_passages_of_tables(spark, data_dir):
    """Every exact run of 50 words that an earlier document has is covered."""
    found = Q.op5_substring_dedup(spark, data_dir).collect()
    spans = defaultdict(list)
    for r in found:
        spans[r["doc_id"]].append((r["start_char"], r["end_char"]))
    seen: dict[int, int] = {}
    for doc, text in sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()):
        h, begins, ends = substring._positions(text)
        runs = words.shingles(h, 50).tolist()
        for k, v in enumerate(runs):
            if seen.get(v, doc) != doc:
                assert all(any(a <= begins[w] and ends[w] <= b for a, b in spans[doc]) for w in range(k, k + 50))
        for v in runs:
            seen.setdefault(v, doc)


# -- 10 ------------------------------------------------------------------------------
def test_probminhash_estimates():
    rng = random.Random(6)
    errors = []
    for _ in range(60):
        a = prose(rng, rng.choice([9, 80, 500]))
        b = list(a)
        for _ in range(max(1, len(a) // rng.choice([20, 60]))):
            b[rng.randrange(len(b))] = "edit"
        one, two = probminhash.weighted_set(" ".join(a)), probminhash.weighted_set(" ".join(b))
        exact = probminhash.probability_jaccard(*one, *two)
        x, y = dict(zip(one[0].tolist(), one[1], strict=True)), dict(zip(two[0].tolist(), two[1], strict=True))
        if len(x) < 100:
            plain = sum(1 / sum(max(x.get(q, 0) / x[d], y.get(q, 0) / y[d]) for q in set(x) | set(y)) for d in x if d in y)
            assert abs(plain - exact) < 1e-9
        errors.append((probminhash.signature(*one) == probminhash.signature(*two)).mean() - exact)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def brute_classes(rows):
    texts = {i: t for i, t in rows if i is not None}
    sets = {i: probminhash.weighted_set(t or "") for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a][0]) and len(sets[b][0]) and probminhash.similarity(sets[a], sets[b]) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def near_rows(seed=7):
    rng = random.Random(seed)
    rows = [(i, " ".join(prose(rng, rng.randint(1, 120)))) for i in range(40)]
    base = prose(rng, 200)
    for i in range(60):  # a large group: copies of one base, most of them too far from each other
        own = list(base)
        for _ in range(3 if i != 37 else 0):
            own[rng.randrange(200)] = f"e{rng.random()}"
        rows.append((100 + i, " ".join(own)))
    step = prose(rng, 300)
    for i in range(12):  # a chain
        step = list(step)
        for k in range(5):
            step[i * 20 + k] = f"s{i}{k}"
        rows.append((200 + i, " ".join(step)))
    rows += [(300 + i, "Exactly the same few words, again and again!") for i in range(50)] + [(400, "exactly THE same few words again and again")]
    return rows + [(500, None), (501, ""), (502, "..."), (503, "one two"), (504, "One, two"), (505, "x " * 50_000), (506, "x " * 50_000), (None, "one two"), (503, "one two")]


def test_near_duplicates(spark):
    rows = near_rows()
    found = probminhash.near_duplicates(frame(spark, rows)).collect()
    want = brute_classes(rows)
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    for r in found:
        assert r["class_id"] == want.get(r["doc_id"])
    assert all(r["n_links"] > 0 for r in found if r["doc_id"] != r["class_id"])
    assert all(r["n_links"] == 0 for r in found if r["doc_id"] is not None and list(want.values()).count(r["class_id"]) == 1)
    kept = probminhash.deduplicate(frame(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([*{c for c in want.values()}, None])
    assert probminhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    assert probminhash.near_duplicates(frame(spark, rows[:3])).count() == 3


def test_near_duplicates_of_families(spark):
    """Edited copies of texts that aren't in the table, many of them too far from each other."""
    rng = random.Random(1)
    rows = []
    for f in range(6):
        for c in range(60):
            own = [f"b{f}x{i}" for i in range(300)]
            for _ in range(3 + c % 2):
                own[rng.randrange(300)] = f"e{rng.getrandbits(50)}"
            rows.append((f * 1000 + c, " ".join(own)))
    found = probminhash.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_duplicates_of_tables(spark, sf):
    data = Path("/root/testdata") / sf
    if not data.is_dir():
        pytest.skip("no test tables here")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = Q.op10_probminhash(spark, str(data)).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(rows)


def test_block():
    """Links of an inverted index against all pairs, weighted sets among them."""
    rng = random.Random(12)
    base = prose(rng, 60)
    sets = []
    for i in range(60):
        own = list(base) + base[: i % 3 * 10]
        for _ in range(i % 5):
            own[rng.randrange(len(own))] = f"e{rng.random()}"
        sets.append(probminhash.weighted_set(" ".join(own)))
    classes = [i % 4 for i in range(60)]
    block = probminhash.Block(list(range(60)), classes, [c != 0 for c in classes], sets)
    for i in range(60):
        want = {j for j in range(60) if classes[j] != classes[i] and (classes[j] == 0 or j < i) and probminhash.similarity(sets[i], sets[j]) >= 0.8}
        got = block.links(i, classes[i], sets[i], 0.8)
        assert {j for j, _ in got} == want and all(s >= 0.8 for _, s in got)


# -- pipeline ------------------------------------------------------------------------
def test_pipeline(spark, tmp_path, path):
    """The stages one by one, and ``run`` as a whole, against their parts' definitions."""
    from tokenizers import Tokenizer

    rng = random.Random(9)
    rows = [(i, t, rng.choice(["en", "de", None]), "s", len(t or "")) for i, t in near_rows(8) if i is not None and (i, t) != (503, "dup")]
    passage = " ".join(prose(rng, 80))
    rows += [(600 + i, " ".join(prose(rng, 40)) + " " + passage, "en", "s", 1) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "packing"]
    texts = {r[0]: r[1] for r in rows}

    docs = common.materialize(corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)), "one")
    kept = {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == kept and docs.where("lang is null").count() == 0
    docs = common.materialize(corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)), "two")
    classes = brute_classes([(i, texts[i]) for i in kept])
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == sorted(set(classes.values()))
    docs = common.materialize(corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)), "three")
    left = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == columns and set(left) == set(classes.values())
    assert left[600]["text"] == texts[600] and all(left[600 + i]["text"] == texts[600 + i].removesuffix(passage) for i in range(1, 5))
    assert all(r["n_chars"] == len(r["text"]) for r in left.values())
    packed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(path)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for own in (packed, whole):
        pieces = defaultdict(list)
        for r in own:
            pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        assert {i: np.frombuffer(b"".join(b for _, b in sorted(p)), "<u4").tolist() for i, p in pieces.items()} == {i: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1] for i, r in left.items()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Columns whose names the stages use stay as they are; an empty table gives an empty result."""
    rng = random.Random(11)
    passage = " ".join(prose(rng, 70))
    rows = [(i, " ".join(prose(rng, 60)) + (" " + passage if i % 3 == 0 else ""), "en" if i % 2 else None, f"s{i}") for i in range(12)] + [(50, None, "en", "s"), (51, "", "en", "s"), (7, "again the same id", "en", "t"), (None, "no id has this one", "en", "u")]
    rows += [(60, rows[4][1], "en", "copy")]
    names = ["score", "lang_pred", "languages", "row", "listed", "cut_id", "cuts", "number", "key", "d", "body", "id", "_id", "_cuts", "_gone", "_number"]
    docs = spark.createDataFrame([(*r, *[f"{n} {r[3]}" for n in names]) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = common.materialize(stage(spark, docs, ""), name)
        got = docs.collect()
        assert docs.columns == columns and all(r[n] == f"{n} {r['source']}" for r in got for n in names)
    assert {r["doc_id"] for r in got} == {*range(12), None} and len(got) == 13
    assert sum(passage in r["text"] for r in got) == 1
    docs.drop(*names).withColumn("n_chars", docs.doc_id).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    """Queries that SQL can express against it."""
    import os

    import duckdb

    data = f"/root/testdata/{sf}"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name, sql in Q.ORACLE_SQL.items():
        got, want = Q.QUERIES[name](spark, data).toPandas(), duck.sql(sql).df()
        one = lambda v: "-" if str(v) in ("None", "nan", "<NA>") else f"{v:.6f}" if isinstance(v, float) else f"{int(v)}.000000" if isinstance(v, (int, np.integer)) else str(v)
        plain = lambda x: sorted(tuple(map(one, r)) for r in x[sorted(x.columns)].astype(object).itertuples(index=False, name=None))
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want), name


def test_pipeline_keeps_multilingual(spark):
    rng = random.Random(10)
    letters = ["abcde", "fghij", "klmno", "pqrst"]
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(6)) for _ in range(n))
    rows = [(i, text(i % 4, 60), f"l{i % 4}") for i in range(80)] + [(1000, " ".join(text(k, 60) for k in range(4)), None), (1001, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_languages(spark, docs, "").collect()}
    assert kept == {*range(80), 1000}


def test_entry_without_llm():
    """The entry point works where the subpackage and the pipeline are gone."""
    code = """
import importlib.util, sys
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name in ("needlework.llm", "corpus_pipeline") else real(name, *a)
import __spark_entry__ as e
assert "scan_literals" in e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
assert not any(m.startswith("needlework.llm") for m in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert language.UNKNOWN == "und" and packing.FAN_IN > 1
