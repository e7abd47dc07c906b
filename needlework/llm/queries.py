"""Queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, counting, digest, hilbert, language, packing, probminhash, resampling, search, substring, warc
from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    sharded = hilbert.hilbert_shards(docs, ["source", "lang", "n_chars"], n_shards=16, tie=["doc_id", "size", "text_crc32"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    found = language.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.where("doc_id % 100 = 0"), k=10)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    turns = given.unionByName(own).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    done = chat.format_conversations(turns).withColumns({"read": chat.parse(F.col("formatted")), "learned": chat.masked_text(F.col("formatted"), F.col("loss_mask"))})
    return done.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path(), payload=packing.crc_payload, payload_type="ids_crc32 bigint")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_frame(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), digests=True)


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_sharding": op1_hilbert_sharding,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_topk_search": op4_topk_search,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_packing": op7_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_bpe": op9_bpe,
    "op10_probminhash": op10_probminhash,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op4_topk_search": r"""
        with words as (select doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+')) as w from documents),
        found as (select doc_id, w, count(*) as c from words group by all),
        sizes as (select doc_id, coalesce(n, 0) as n from documents left join (select doc_id, count(*) as n from words group by doc_id) using (doc_id)),
        whole as (select count(*) as docs, sum(n) / count(*) as mean from sizes),
        known as (select w, count(*) as df from found group by w),
        scored as (
            select q.doc_id as query_id, t.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * t.c * 2.2 / (t.c + 1.2 * (0.25 + 0.75 * n / mean))), 6) as score
            from found q join found t on t.w = q.w join known on known.w = q.w join sizes on sizes.doc_id = t.doc_id, whole where q.doc_id % 100 = 0 group by q.doc_id, t.doc_id
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored qualify rank <= 10
    """,
    "op3_warc": """
        with rows as (select page_id, encode(coalesce(html, '')) as payload from pages),
        firsts as (select *, sha1(payload) as h, min(page_id) over (partition by payload) as first_id from rows),
        five as (select *, list_transform(range(8), lambda g: cast('0x' || substr(h, 1 + 5 * g, 5) as bigint)) as v from firsts)
        select page_id, octet_length(payload) as payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 as bigint), 1)), 'string_agg', '') as payload_digest,
            case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to
        from five
    """,
    "op6_chat_formatting": """
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
            union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), marked as (
            select *, regexp_replace(text, '(<|\\[)(\\\\*)(\\||s>|/s>|<SYS>>|</SYS>>|INST\\]|/INST\\])', '\\1\\\\\\2\\3', 'g') as escaped from rows
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum(length('<|turn|>') + length(role) + length('<|body|>') + length(escaped) + length('<|end|>')) as bigint) as formatted_chars
        from marked group by conv_id
    """,
    "op12_filter_audit": r"""
        with docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as first_id from documents),
        words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from docs),
        flags as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
        judged as (
            select part, coalesce(good, false)::int as good, coalesce(toxic, false)::int as toxic,
                (case when len(w) < 100 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end)
                + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end)
                + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > first_id then 16 else 0 end) as mask
            from words left join flags using (doc_id)
        ),
        cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by all),
        letters as (select unnest(range(5)) as f),
        orders as (
            select [a.f, b.f, c.f, d.f, e.f] as o from letters a, letters b, letters c, letters d, letters e
            where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ),
        steps as (select o, s, o[s] as f, list_sum(list_prepend(0, list_transform(o[:s - 1], lambda x: 1 << x))) as before from orders, (select unnest(range(1, 6)) as s)),
        counted as (
            select part, o, s, f,
                sum(case when mask & (before + (1 << f)) = 0 then n else 0 end) as kept,
                sum(case when mask & before = 0 and mask & (1 << f) > 0 then n else 0 end) as removed,
                sum(case when mask & before > 0 and mask & (1 << f) > 0 then n else 0 end) as redundant,
                sum(case when mask = 1 << f then n else 0 end) as unique_fails,
                sum(case when mask & before = 0 and mask & (1 << f) > 0 then good else 0 end) as good_lost,
                sum(case when mask & before = 0 and mask & (1 << f) > 0 then toxic else 0 end) as toxic_lost
            from cells, (select o, s, f, before::bigint as before from steps) group by all
        )
        select part, list_aggregate(list_transform(o, lambda x: substr('ABCDE', x::int + 1, 1)), 'string_agg', '') as filter_order, s::int as step,
            kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
            good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley
        from counted
    """,
}
