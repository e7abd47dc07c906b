"""Operators that treat each row, page or conversation by itself, or place them."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from needlework.llm import bpe, chat, digest, hilbert, language, packing, warc, words
from needlework.llm import queries as Q

ODD = [
    None, "", "  \n", "it's don't we'll X'S", "ΑΣ ΣΑΣ. İstanbul", "é ́x", "<|endoftext|>hi<|startoftext|> <|ENDOFTEXT|>", "x\x1cy \x1f z", "日本語テスト 12½Ⅳ _-_ a_b",
    "a" * 3000 + "b" * 2000, "the" * 500, "É×é÷x ÷!", "word, word. word", "12.5, 3.", "🚀🚀!!<|endo", "\x85next\x0bvt \xa0q",
]


def random_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(" \nsdtlrevmAÉéΣ1½,.!|>endoft-_́\x1c" + rng.choice(["'", "×", "<|", "İ"])) for _ in range(rng.randrange(40))) for _ in range(n)]


# -- 1 ---------------------------------------------------------------------------
@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_hilbert_curve(spark, dims, bits):
    """A bijection whose neighbours differ by one in one axis."""
    from pyspark.sql import functions as F

    n = 1 << bits * dims
    df = spark.range(n).select(*[F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).cast("int").alias(f"x{i}") for i in range(dims)])
    got = sorted(tuple(r) for r in df.select(hilbert.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits).alias("h"), *df.columns).collect())
    assert [r[0] for r in got] == list(range(n))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:], strict=True)) == 1 for x, y in zip(got, got[1:], strict=False))


def test_hilbert_shards(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", i * 37 % 100 if i % 5 else None, "extra") for i in range(203)] + [(None, None, None, None)] * 2 + [(7, "s0", 1, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, n long, shard string")
    got = hilbert.hilbert_shards(df, ["source", "n"], 16).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append((r["slot"], r["hilbert"]))
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for shard in by.values():
        assert sorted(s for s, _ in shard) == list(range(len(shard)))
    along = [h for s in range(16) for _, h in sorted(by[s])]
    assert along == sorted(along)
    assert hilbert.hilbert_shards(df.limit(0), ["n"]).collect() == []
    few = hilbert.hilbert_shards(df.limit(3), ["n"]).collect()
    assert len({(r["shard"], r["slot"]) for r in few}) == 3


def test_hilbert_cuts_are_those_of_all_rows(spark):
    """Exact quantiles of strings and numbers, and a cell for each of a few values, however rare."""
    df = spark.range(30_000).selectExpr("sha2(string(id), 256) as s", "id * id as n", "case when id < 12 then concat('rare', id) else 'often' end as few", "string(null) as none")
    n, cuts = hilbert.cut_points(df, df.columns, [df["n"]], 5)
    rows = df.collect()
    for name, own in zip(["s", "n"], cuts, strict=False):
        values = sorted(r[name] for r in rows)
        want = [values[k * n // 31] for k in range(1, 31)]
        assert own == ([v.encode() for v in want] if name == "s" else want)
    assert n == 30_000 and cuts[2] == sorted({r["few"].encode() for r in rows})[:-1] and cuts[3] == []


def test_hilbert_shards_plainly(spark):
    """Cells, places on the curve, ranks, shards and slots, one after the other in Python."""
    import bisect

    rng = random.Random(4)
    values = ["common_crawl", "common_voice", "common_z", "", "é", "a", None]
    rows = [(i, rng.choice(values), rng.choice([None, *range(9)]), "row", 1, 2.0, "r") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long, row string, salt int, start double, rank string")
    got = hilbert.hilbert_shards(df, ["source", "n"], 7, bits=4, tie=["doc_id"]).collect()
    n, cuts = hilbert.cut_points(df, ["source", "n"], [df["doc_id"]], 4)
    assert n == 300 and [bytes(c).decode() for c in cuts[0]] == ["", "a", "common_crawl", "common_voice", "common_z"]
    cell = lambda v, own: 0 if v is None else 1 + bisect.bisect_left(own, v)
    place = {r[0]: (cell(r[1] and r[1].encode() if r[1] else None if r[1] is None else b"", cuts[0]), cell(r[2], cuts[1])) for r in rows}
    by_cell = defaultdict(set)
    for r in got:
        by_cell[r["hilbert"]].add(place[r["doc_id"]])
    assert all(len(c) == 1 for c in by_cell.values()) and len(by_cell) == len(set(place.values()))
    # along the curve; rows of a cell by salt, as they are ranked in parts
    ranked = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in ranked] == sorted(r["hilbert"] for r in got)
    for rank, r in enumerate(ranked):
        assert r["shard"] == rank * 7 // 300 and r["slot"] == rank - -(-r["shard"] * 300 // 7)
    for r in got:  # all other columns stay
        assert tuple(r[c] for c in df.columns) == rows[r["doc_id"]]


def test_pruning(spark):
    """Rows by shard whose ranges of both columns admit a value: far fewer than by any one column's order."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, f"site{rng.randrange(1000):04d}", rng.randrange(1000)) for i in range(4000)], "doc_id long, host string, n long")
    got = hilbert.hilbert_shards(df, ["host", "n"], 64, tie=["doc_id"]).toPandas()
    read = {"host": [], "n": []}
    spans = got.groupby("shard").agg(a=("host", "min"), b=("host", "max"), c=("n", "min"), d=("n", "max"))
    for k in range(0, 1000, 50):
        read["host"].append(((spans.a <= f"site{k:04d}") & (spans.b >= f"site{k:04d}")).mean())
        read["n"].append(((spans.c <= k) & (spans.d >= k)).mean())
    assert all(np.mean(v) < 0.25 for v in read.values())  # a random order reads all


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 10) for i in range(100)], "id long, n long")
    hilbert.write_shards(hilbert.hilbert_shards(df, ["n"], 4), str(tmp_path / "x"), 8)
    assert spark.read.parquet(str(tmp_path / "x")).groupBy("shard").count().where("count = 25").count() == 4


def test_op1(spark, data_dir):
    got = Q.op1_hilbert_sharding(spark, data_dir).toPandas()
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").toPandas().set_index("doc_id")
    raw = {i: t.encode() for i, t in docs["text"].items()}
    for r in got.to_dict("records"):
        assert r["size"] == len(raw[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(raw[r["doc_id"]])
        assert r["law"] == "rows" and r["grown_shard"] is None or r["grown_shard"] != r["grown_shard"]
    assert sorted(got["doc_id"]) == sorted(raw)
    shards = {s: sorted(g["slot"]) for s, g in got.groupby("shard")}
    sizes = [len(v) for v in shards.values()]
    assert sorted(shards) == list(range(16)) and max(sizes) - min(sizes) <= 1
    assert all(v == list(range(len(v))) for v in shards.values())
    along = got.sort_values(["shard", "slot"])["hilbert"].tolist()
    assert along == sorted(along)


# -- 2 ---------------------------------------------------------------------------
def test_language(spark):
    rng = random.Random(3)
    parts = {"aa": ["lo", "mi", "ra"], "bb": ["sch", "ung", "ei"], "cc": ["ción", "ñe", "que"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", None), (None, text("bb", 50), None), (1003, text("aa", 80) + " " + text("bb", 40), None), (1004, text("cc", 100_000), None), (0, rows[0][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.languages == ["aa", "bb", "cc"]
    got = language.identify(df.withColumnRenamed("lang", "score"), model, ["doc_id"]).collect()
    assert len(got) == len(rows)
    for (_, t, lang), r in zip(rows, got, strict=True):
        if t is None or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"], r["languages"]) == ("und", 0.0, [])
        elif lang:
            assert r["lang_pred"] == lang and 0.9 < r["score"] <= 1
    mixed = next(r for r in got if r["doc_id"] == 1003)
    assert {x["lang"] for x in mixed["languages"]} == {"aa", "bb"} and 0.55 < mixed["score"] < 0.8 and mixed["lang_pred"] == "aa"
    none = language.train(df.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, none, ["doc_id"]).collect()} == {"und"}


def test_grams_in_pieces(monkeypatch):
    text = "Ünder the wörld, and 12 so on. " * 50
    whole = language.grams(text)
    for piece in (1, 2, 3, 7, 100, 1 << 30):
        monkeypatch.setattr(language, "PIECE", piece)
        for own in (text, "ΑΣ ΣΑΣ.", " a", "a ", "ab", "", " ", "12"):
            monkeypatch.setattr(language, "PIECE", 1 << 20)
            whole = language.grams(own)
            monkeypatch.setattr(language, "PIECE", piece)
            again = language.grams(own)
            assert len(whole[0]) == len(again[0]) and all((a == b).all() for a, b in zip(whole, again, strict=True))


def test_training_rows_that_repeat(spark):
    """Bounds hold where a language is ten texts, or one, many times."""
    rows = [(i, f"uno dos tres {'abcdefghij'[i % 10] * 3}", "es") for i in range(3000)] + [(5000 + i, "eins zwei drei", "de") for i in range(3000)] + [(9000, "12", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, rows_per_language=200)
    assert model.languages == ["de", "es"]
    got = language.identify(spark.createDataFrame([(1, "dos tres", 1), (2, "zwei drei", 2)], "doc_id long, text string, body int"), model, ["doc_id", "body"]).collect()
    assert [(r["lang_pred"], r["body"]) for r in got] == [("es", 1), ("de", 2)]


def test_mixture_plainly():
    """Proportions against expectation-maximisation gram by gram, and the set against all sets."""
    import itertools
    import math

    rng = np.random.default_rng(2)
    counts = rng.integers(0, 60, (4, language.BUCKETS // 512)) * rng.integers(0, 2, (4, language.BUCKETS // 512))
    whole = np.zeros((4, language.BUCKETS))
    whole[:, : counts.shape[1]] = counts
    model = language.Model.of(["a", "b", "c", "d"], whole)
    for shares in ([1, 0, 0, 0], [0.6, 0.4, 0, 0], [0.3, 0.3, 0.4, 0], [0, 0.25, 0, 0.75]):
        p = (np.array(shares) @ model.probability)[: counts.shape[1]].astype(float)
        drawn = np.bincount(rng.choice(counts.shape[1], 4000, p=p / p.sum()), minlength=counts.shape[1])
        found = np.flatnonzero(drawn)
        best = None
        for size in range(1, 5):
            for chosen in itertools.combinations(range(4), size):
                w = {k: 1 / size for k in chosen}
                for _ in range(200):
                    new = dict.fromkeys(chosen, 0.0)
                    for g in found.tolist():
                        total = sum(w[k] * float(model.probability[k, g]) for k in chosen)
                        for k in chosen:
                            new[k] += drawn[g] * w[k] * float(model.probability[k, g]) / total / drawn.sum()
                    w = new
                fit = sum(int(drawn[g]) * math.log(sum(w[k] * float(model.probability[k, g]) for k in chosen)) for g in found.tolist())
                score = fit - 3.0 * math.log1p(drawn.sum()) * (size - 1)
                if best is None or score > best[0]:
                    best = score, w
        got = model.mixture(found, drawn[found], 3.0)
        assert set(got) == set(best[1]) == {k for k, s in enumerate(shares) if s}
        assert all(abs(got[k] - best[1][k]) < 0.02 for k in got)


def test_op2(spark):
    import os

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    got = Q.op2_language_id(spark, data).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas().set_index("doc_id")
    held = [i for i in docs.index if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(got.index[got["held_out"]]) == held
    assert (got.loc[held, "lang_pred"] == docs.loc[held, "lang"]).mean() > 0.96


# -- 3 ---------------------------------------------------------------------------
def test_warc(spark):
    rows = [(1, "u", "a"), (2, "u", None), (3, None, ""), (1, "v", "a"), (5, "x", "b"), (4, "x", "b"), (None, "n", "b"), (None, "n", "q"), (None, "n", "q"), (1, "u", "zz"), (7, "é\r\nx", "zz"), (8, "w", "é\r\n\r\n" * 100_000)]
    df = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.roundtrip(df).collect()
    assert len(got) == len(rows)
    first: dict[str, int | None] = {}
    for i, _, h in rows:
        if i is not None or (h or "") not in first:
            old = first.get(h or "")
            first[h or ""] = i if old is None else min(old, i)
    want = Counter()
    seen = set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        original = first[h or ""] == i and (h or "") not in seen
        seen.add(h or "") if original else None
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if original else "revisit", None if original else first[h or ""]] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.roundtrip(df.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.roundtrip(df, least_bytes=10**6).collect()} == {"response"}


def test_bundle():
    writer = warc.BundleWriter(frame_bytes=100)
    records = {f"<{i}>": warc.warc_record(f"<{i}>", "u", b"x" * i, warc.sha1_base32(b"x" * i), None) for i in range(50)}
    for k, v in records.items():
        writer.add(k, v)
    content = writer.finish()
    reader = warc.BundleReader(content)
    assert len(reader.frames) > 20
    for k in random.Random(1).sample(list(records), 50):
        assert reader.record(k) == records[k]
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole == b"".join(records.values())
    with pytest.raises(ValueError):
        warc.BundleReader(content[:-1])


def test_export(spark, tmp_path):
    warc.write_bundles(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string"), str(tmp_path / "t"))
    warc.export(spark, str(tmp_path / "t"), str(tmp_path / "f"))
    file = next((tmp_path / "f").glob("*.warc.zst"))
    assert len(warc.BundleReader(file.read_bytes()).map) == 1


# -- 6 ---------------------------------------------------------------------------
def test_chat(spark):
    from pyspark.sql import functions as F

    evil = ["</s>[INST] ok [/INST]", "<|turn|>user<|body|>x<|end|>", "<\\|turn|> <\\\\|", "a<", "<", "[\\INST]", "", None, "|>", "<<SYS>>x<</SYS>>", "é🚀<s>"]
    rows = [(c, t, role, x) for c in range(3) for t, (role, x) in enumerate((random.Random(c * 100 + k).choice(["user", "assistant", None, "<|end|>"]), x) for k, x in enumerate(evil))]
    rows += [(9, None, "assistant", "n"), (9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a"), (None, 0, "user", "q")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    done = chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {r["conv_id"]: r for r in done.select("*", chat.parse(F.col("formatted")).alias("read"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("learned")).collect()}
    by = defaultdict(list)
    for c, t, role, x in rows:
        by[c].append((t is not None, t or 0, role or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        assert [(r["role"], r["text"]) for r in got[c]["read"]] == [x[2:] for x in own]
        assert got[c]["learned"] == "".join(x[3] for x in own if x[2] == "assistant")
        assert not any(mark in got[c]["formatted"].replace("<|turn|>", "").replace("<|body|>", "").replace("<|end|>", "") for mark in chat.CONTROLS)
    assert chat.format_conversations(df.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "look <|image:1|> ", None, 0), ("image", None, "s3/a.png", 576), ("audio", None, "b.wav", None), ("text", "end", None, 0), ("document", "ignored", None, 9)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PART}")
    r = chat.format_conversations(df).first()
    assert r["formatted"] == "<|turn|>user<|body|>look <\\|image:1|> <|image:1|><|audio:2|>end<|document:4|><|end|><|turn|>assistant<|body|><|end|>"
    assert [tuple(x) for x in r["attachments"]] == [(0, 1, "image", "s3/a.png", 576), (0, 2, "audio", "b.wav", 0), (0, 4, "document", None, 9)] and r["expanded_tokens"] == 585


def test_op6(spark, data_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{data_dir}/conversations.parquet'")
    want = con.sql(Q.ORACLE_SQL["op6_chat_formatting"]).df()
    got = Q.op6_chat_formatting(spark, data_dir).toPandas()
    plain = lambda x: sorted(map(tuple, x[sorted(x.columns)].to_numpy().tolist()))
    assert plain(got) == plain(want)


# -- 7 and 9 -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def test_bpe_equals_library(spark, path, tokenizer):
    texts = ODD + random_texts(2000)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.encode_frame(df, path).collect()}
    hashed = {r["doc_id"]: r for r in bpe.encode_frame(df, path, digests=True).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[i]["ids"], got[i]["decoded"]) == (ids, text), t
        assert hashed[i]["n_tokens"] == len(ids) and hashed[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and hashed[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_frame(df.limit(0), path).count() == 0


def test_other_settings(path, tmp_path):
    """A file that asks for what the encoder doesn't do is refused."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for key, value in (("decoder", {"type": "ByteLevel"}), ("normalizer", None), ("post_processor", {"type": "ByteLevel"}), ("model", spec["model"] | {"ignore_merges": True}), ("added_tokens", [{"content": "[X]", "id": 49408}])):
        (tmp_path / "other.json").write_text(json.dumps(spec | {key: value}))
        with pytest.raises(ValueError, match=key):
            bpe.Vocabulary(str(tmp_path / "other.json"))


def test_segment_tree():
    rng = random.Random(1)
    keys = [rng.randrange(100) for _ in range(37)]
    tree = bpe.SegmentTree(keys)
    for _ in range(200):
        i, keys_i = rng.randrange(37), rng.choice([bpe.INF, rng.randrange(100)])
        keys[i] = keys_i
        tree.put(i, keys_i)
        assert tree.root() == min(keys)


def test_encoder_forgets(path, tokenizer):
    own = bpe.Encoder(path, keep=50)
    texts = [t or "" for t in ODD] + random_texts(300, 4)
    assert [a for a, _ in own.rows(texts, budget=200)] == [" ".join(map(str, tokenizer.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_token_table(path, tokenizer):
    own = packing.TokenTable(path, keep=100)
    texts = [t or "" for t in ODD] + random_texts(1000, 2)
    assert [x.tolist() for x in own.texts(texts, budget=500)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packer():
    rng = random.Random(2)
    own, fill = packing.Packer(100, 5, least=10), defaultdict(int)
    for _ in range(500):
        n = rng.randint(1, 250)
        open_ = own.leftovers()
        placed = own.place(n)
        assert sum(x for _, _, x in placed) == n
        for w, offset, size in placed:
            assert offset == fill[w]
            fill[w] += size
        fits = [v for v in open_.values() if v + n % 100 <= 100]
        if n < 100 and fits:
            assert placed == [(placed[0][0], max(fits), n)]
        assert len(own.leftovers()) <= 5 and max(fill.values()) <= 100
    emitted = [v for w, v in fill.items() if w not in own.leftovers()]
    assert min(emitted) > 90


@pytest.mark.parametrize(("slots", "fan_in"), [(32, 8192), (3, 4)])
def test_pack(spark, path, tokenizer, monkeypatch, slots, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rng = random.Random(6)
    texts = [*ODD, *[" ".join(rng.choice(["the", "and", "word", "thing"]) for _ in range(rng.randint(0, 300))) for _ in range(200)], "long " * 5000]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part int").repartition(7)
    got = packing.pack(df, path, capacity=256, slots=slots).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i if i else None])
        assert np.concatenate([np.frombuffer(x[2], "<u4") for x in own]).tolist() == ids and {x[3] for x in own} == {len(ids)}
        assert [x[0] for x in own] == np.cumsum([0, *[x[1] for x in own]])[:-1].tolist()
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 256
    total = sum(r["length"] for r in got)
    assert slots < 32 or total / (256 * len(sequences)) > 0.95
    assert packing.pack(df.limit(0), path).count() == 0


# -- 8 ---------------------------------------------------------------------------
def test_fingerprints(spark, monkeypatch):
    rng = random.Random(8)
    texts = [None, "", "a", "é" * 7, "x" * 50_000, "same text here", "same text here"] + ["".join(rng.choice("abcdé 🚀") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(None if i == 3 else i // 2 * 3 if i < 10 else i * 5, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(5)

    def check(own, found):
        own = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in own))
        want = Counter()
        for k, (has, key, text) in enumerate(own):
            after = own[(k + 1) % len(own)][2]
            changed = digest.edited(text, after)
            a, b, c = digest.digest(text), digest.digest(changed), digest.digest(after)
            want[key if has else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), digest.likeness(a, b), digest.likeness(a, c)] += 1
        assert Counter(tuple(r) for r in found.collect()) == want

    check(rows, digest.fingerprints(df))
    check(rows[4:5], digest.fingerprints(df.where("length(text) = 50000")))
    assert digest.fingerprints(df.limit(0)).count() == 0


def test_likeness():
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa"]) + str(rng.randrange(99)) for _ in range(400))
    a, b = text(), text()
    x, y, z = digest.digest(a), digest.digest(digest.edited(a, b)), digest.digest(b)
    assert digest.likeness(x, x) == 1 and 0 <= digest.likeness(x, z) < digest.likeness(x, y) < 1
    assert digest.difference(digest.digest(""), digest.digest("")) == 0
    for _ in range(50):
        p, q = rng.randbytes(1 + digest.BUCKETS // 4), rng.randbytes(1 + digest.BUCKETS // 4)
        assert 0 <= digest.difference(p, q) <= 1 and digest.difference(p, q) == digest.difference(q, p)


def test_likeness_of_short_texts():
    of = lambda a, b: digest.likeness(digest.digest(a), digest.digest(b))
    for a, b in (("cat", "dog"), ("hello world", "zebra quartz"), ("", "one sentence of some words"), ("", "abc")):
        assert of(a, b) == of(b, a) < 0.2
    assert of("hello world", "hello worlds") > 0.6 and of("ab", "ab") == of("", "") == 1


# -- the registered queries over whole tables --------------------------------------
def texts_of(spark, data_dir) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}


def test_op7(spark, data_dir, tokenizer):
    texts = texts_of(spark, data_dir)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in Q.op7_packing(spark, data_dir).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    total = 0
    for i, own in pieces.items():
        ids, at = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
        total += at
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert 1 - total / (2048 * len(sequences)) < 0.03


def test_op8(spark, data_dir):
    texts = texts_of(spark, data_dir)
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in Q.op8_fingerprints(spark, data_dir).collect()}
    assert sorted(got) == ids
    for i, then in zip(ids, [*ids[1:], ids[0]], strict=True):
        half = len(texts[i]) // 2
        other = texts[i][: len(texts[i]) - half] + texts[then][:half]
        own = digest.digest(texts[i])
        assert got[i]["n_chars"] == len(texts[i]) and got[i]["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        assert got[i]["fingerprint"] == own.hex() and got[i]["edited_fingerprint"] == digest.digest(other).hex()
        assert got[i]["near_edited"] == digest.likeness(own, digest.digest(other)) and got[i]["near_next"] == digest.likeness(own, digest.digest(texts[then]))


def test_op9(spark, data_dir, tokenizer):
    texts = texts_of(spark, data_dir)
    got = {r["doc_id"]: r for r in Q.op9_bpe(spark, data_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


# -- words -------------------------------------------------------------------------
def test_words():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("ab AÉ İ,.\n日1_") for _ in range(rng.randrange(40)))
        x, starts, ends, h = words.words_of(text)
        points = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        plain, at = [], ""
        for c in points + " ":
            if c.isascii() and not c.isalnum():
                plain += [at] * bool(at)
                at = ""
            else:
                at += c
        assert [x[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == plain
        assert len(set(zip(plain, h.tolist(), strict=True))) == len(set(plain)) == len(set(h.tolist()))


def test_hashes_of_long_words():
    x = np.frombuffer(b"a" * (3 * words.BLOCK) + b"b", np.uint8)
    one = words.hashes(x, np.array([0]), np.array([len(x) - 1]))
    two = words.hashes(x, np.array([0, len(x) - 1]), np.array([len(x) - 1, len(x)]))
    assert one[0] == two[0] != words.hashes(x, np.array([0]), np.array([len(x)]))[0]
