"""The query catalogue: every operator over whole tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import batch, chunk, ensemble, regions
from .operators import scan as S
from .operators.asof import asof_join
from .operators.scan import NO_LIMIT
from .operators.table import scan_table
from .plans.patterns import HotSwapPatternSet, PatternSet
from .plans.planner import ScanConfig, fallback_reason
from .sources.index import load_index, save_index
from .sources.scratch import lasting, passing, scratch, written
from .streaming.keyed import STORE, scan_keyed_stream, use_rocksdb
from .streaming.stream import scan_stream
from .streaming.versions import publish, scan_versions
from .streaming.windows import late_rows, matches_by_window

LITERALS = ("tion", "the", "thea", "ment", "ê", "sch", "ción", "ere")
FOLDED = ("the", "and", "nicht", "que")
OVERLAPPING = ("an", "ana", "anan", "ere", "re", "èr", "heit", "an")
WORDS = ("password", "token", "secret", "AKIA", "ghp_", "Bearer ", "example.com")
EMAIL = r"[a-z0-9._]+@[a-z0-9.-]+\.[a-z]{2,}"
IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
URL = r"https?://[a-z0-9./?=&#-]+"
DIGITS = r"[0-9]{4,}"
SHORTEST = ("the", "thea", "ment", "the", "me", "en")
NEEDLES = ("ana", "lan", "ere", "der", "nan", "and")


#: Literals that few pages have.
RARE = ("/search?", "copyright", "Lorem", "&amp;", "<table", "utf-8", "http://", "<h3", "href=\"/p", "</nav><")
#: 500 regexes: stems with what may follow, be between or come before, and a few without any literal.
STEMS = ("ab", "an", "be", "con", "de", "en", "er", "est", "in", "ion", "ker", "lan", "ment", "nd", "on", "per", "que", "re", "sch", "ter", "un", "ver", "wi", "zu", "al")
REGEXES = tuple(
    form.replace("S", a).replace("T", STEMS[(i + 7) % len(STEMS)])
    for i, a in enumerate(STEMS)
    for form in (
        "S[0-9]+", "S[a-z]T", "ST", "(?:S|T)x", "[0-9]S", "S S", "\\bS\\b", "S[a-z ]{2}T", "[xyz]S", "ST?[.,]", "S[^a-z ]", "qS", "S-T", "S@[a-z]+", "k{2}S",
        "[aeiou]S[aeiou]T", "SS", "S{2}[a-z]", "xS?z", "[A-Z][0-9]{2}S",
    )
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return S.spread(table(spark, d, "documents").select("doc_id", "text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return S.spread(table(spark, d, "pages").select("page_id", "html"))


# -- scans -------------------------------------------------------------------
def scan_literals(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(documents(spark, d), "text", PatternSet.of(*LITERALS))


def scan_single_literal(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(documents(spark, d), "text", PatternSet.of("anan"))


def scan_literals_ci(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(documents(spark, d), "text", PatternSet.of(*FOLDED, case_insensitive=True))


def scan_count(spark: SparkSession, d: str) -> DataFrame:
    return S.scan_count(documents(spark, d), "text", PatternSet.of(*LITERALS)).drop("text")


def scan_visitor_limit(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(documents(spark, d), "text", PatternSet.of(*LITERALS), first_n=3)


def any_match(spark: SparkSession, d: str) -> DataFrame:
    return S.any_match(documents(spark, d), "text", PatternSet.of(*WORDS)).select("doc_id")


def no_match(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return S.no_match(turns, "text", PatternSet.of("tion", "sch")).select("conv_id", "turn")


def first_match(spark: SparkSession, d: str) -> DataFrame:
    found = S.first_match(pages(spark, d), "html", PatternSet.of("<article>", "<p>", "</nav>"))
    return found.where("first_match is not null").select("page_id", "first_match.pattern_id", "first_match.start", "first_match.end")


def pattern_flags(spark: SparkSession, d: str) -> DataFrame:
    found = S.pattern_flags(documents(spark, d), "text", PatternSet.builder().literal("tion").regex(EMAIL).regex(IP).build())
    return found.select("doc_id", *[F.col("flags")[i].alias(f"f{i}") for i in range(3)])


def scan_overlapping(spark: SparkSession, d: str) -> DataFrame:
    return S.scan_overlapping(documents(spark, d), "text", PatternSet.of(*OVERLAPPING))


def scan_regex(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(documents(spark, d), "text", PatternSet.builder().regex(EMAIL).regex(IP).regex(DIGITS).build())


def scan_regex_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(table(spark, d, "pages").select("page_id", "url"), "url", PatternSet.builder().regex(URL).regex(DIGITS).build())


def scan_mixed(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(pages(spark, d), "html", PatternSet.builder().literal("<p>").literal("</p>").regex(r"<h[1-6]>").literal("<").build())


def scan_regex_arrow(spark: SparkSession, d: str) -> DataFrame:
    """A repetition of a group, which goes to the Arrow strategy."""
    return S.scan(documents(spark, d), "text", PatternSet.builder().regex(r"(?:an|on){2,100}").regex(IP).build())


def scan_nested(spark: SparkSession, d: str) -> DataFrame:
    found = S.scan_nested(documents(spark, d), "text", PatternSet.of(*LITERALS))
    return found.select("doc_id", F.concat_ws(";", F.transform("matches", lambda m: F.concat_ws(",", m["pattern_id"], m["start"], m["end"]))).alias("matches"))


def batch_nested(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    found = batch.tagged_to_nested(S.scan(docs, "text", PatternSet.of(*WORDS)), docs, ["doc_id"])
    return found.select("doc_id", F.concat_ws(";", F.transform("matches", lambda m: F.concat_ws(",", m["pattern_id"], m["start"], m["end"]))).alias("matches"))


def scan_chunked(spark: SparkSession, d: str) -> DataFrame:
    return chunk.scan_chunked(documents(spark, d), "text", PatternSet.of(*OVERLAPPING), ["doc_id"], ScanConfig().with_chunk_bytes(4096).with_overlap(16))


def scan_chunked_leftmost(spark: SparkSession, d: str) -> DataFrame:
    hits = chunk.scan_chunked(pages(spark, d), "html", PatternSet.of("<p>", "<p><b>", "</p>"), ["page_id"], ScanConfig().with_chunk_bytes(1000).with_overlap(8))
    return chunk.leftmost_longest(hits, ["page_id"], longest=6)


def large_set(spark: SparkSession, d: str) -> PatternSet:
    """The benchmark's words of five ASCII letters or more: the table is a fixed list of test items."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", "[^a-z]+")).alias("w")).where("length(w) >= 5").distinct().orderBy("w").collect()
    return PatternSet.of(*[r["w"] for r in words])


def scan_large_set(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(documents(spark, d), "text", large_set(spark, d))


def scan_large_set_arrow(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(documents(spark, d), "text", large_set(spark, d), config=ScanConfig(strategy="arrow"))


def scan_joined(spark: SparkSession, d: str) -> DataFrame:
    """A large set in the native strategy: ids by a join on the matched text."""
    return S.scan(documents(spark, d), "text", large_set(spark, d), config=ScanConfig(strategy="native"))


def scan_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.scan_totals(documents(spark, d), "text", PatternSet.of(*LITERALS), ["doc_id"])


def scan_limited(spark: SparkSession, d: str) -> DataFrame:
    """A scan under the least limit that its largest document allows: one match more would fail it."""
    docs, words = documents(spark, d), PatternSet.of(*WORDS)
    most = S.scan_count(docs, "text", words).agg(F.max("n_matches")).first()[0] or 0
    return S.scan(docs, "text", words, config=ScanConfig().with_max_matches(most + 1))


def scan_shortest_all(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(documents(spark, d), "text", PatternSet.of(*SHORTEST), config=ScanConfig(compat="shortest_all"))


def scan_needle_by_needle(spark: SparkSession, d: str) -> DataFrame:
    """Needles that overlap each other: ``lan`` ahead of ``ana`` hides an ``ana`` further on, which another rule would find."""
    return S.scan(documents(spark, d), "text", PatternSet.of(*NEEDLES), config=ScanConfig(compat="needle_by_needle"))


def scan_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Asked to be native, but a repeated group isn't: the plan goes to Python and says why."""
    patterns = PatternSet.builder().regex(r"(?:an|on){2,100}").regex(IP).build()
    config = ScanConfig(strategy="native", fallback=True)
    found = S.scan(documents(spark, d), "text", patterns, config=config)
    return found.withColumn("reason", F.lit(fallback_reason(patterns, config)))


def scan_bytes_and_names(spark: SparkSession, d: str) -> DataFrame:
    """Literals given as bytes and a regex with a name, which the result carries."""
    patterns = PatternSet.builder().literal_bytes("ê".encode()).named_regex("digits", DIGITS).literal_bytes(b"tion").build()
    hits = S.scan(documents(spark, d), "text", patterns)
    return hits.join(F.broadcast(S.pattern_table(spark, patterns).select("pattern_id", "name")), "pattern_id").select("doc_id", "pattern_id", "start", "end", F.coalesce("name", F.lit("-")).alias("name"))


def any_match_arrow(spark: SparkSession, d: str) -> DataFrame:
    """A test that stops at the first match of a regex that only Python runs."""
    return S.any_match(documents(spark, d), "text", PatternSet.builder().regex(r"(?:an|on){2,100}").build()).select("doc_id")


def scan_sql_function(spark: SparkSession, d: str) -> DataFrame:
    S.register_udtf(spark, "scan_words", PatternSet.of(*WORDS))
    documents(spark, d).createOrReplaceTempView("needlework_documents")
    return spark.sql("select doc_id, pattern_id, start, end from needlework_documents, lateral scan_words(encode(text, 'UTF-8'))")


def scan_table_function(spark: SparkSession, d: str) -> DataFrame:
    """The table function that takes any table: its schema, patterns and column come from the query."""
    S.register_scan_table(spark, "needlework_scan")
    documents(spark, d).createOrReplaceTempView("needlework_documents")
    return spark.sql("select * from needlework_scan(table(needlework_documents), 'text', array('the', 'thea', 'ment'), array('[0-9]{4,}'))")


def scan_chunked_regex(spark: SparkSession, d: str) -> DataFrame:
    patterns = PatternSet.builder().regex(IP).regex(DIGITS).build()
    return chunk.scan_chunked(documents(spark, d), "text", patterns, ["doc_id"], ScanConfig().with_chunk_bytes(4096), max_match_len=1000)


def shortest_by_start(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping hits in chunks that share bytes, each once."""
    return chunk.shortest_by_start(S.scan_overlapping(documents(spark, d), "text", PatternSet.of("anan", "heit", "ere")), ["doc_id"])


def matched_by_one_only(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a match of one set and none of another."""
    docs = documents(spark, d)
    one, two = (S.any_match(docs, "text", PatternSet.of(*x)).select("doc_id") for x in (("tion",), ("sch", "ment")))
    return one.subtract(two)


# -- tables of literals, many regexes, stretches ------------------------------------
def scan_word_table(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's words of five ASCII letters or more as a table, leftmost-longest."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", "[^a-z]+")).alias("literal")).where("length(literal) >= 5").distinct()
    words = words.withColumn("pattern_id", F.xxhash64("literal"))
    hits = scan_table(documents(spark, d), "text", words)
    return hits.join(words, "pattern_id").select("doc_id", "literal", "start", "end")


#: Literals of a table that are looked for at once: so many are a part, up to ``PARTS`` parts, and so many a part at most.
PART_LITERALS, PARTS, MOST_LITERALS = 100_000, 10, 8_000_000


def scan_pair_table(spark: SparkSession, d: str) -> DataFrame:
    """All neighbouring words of documents that make 11 to 15 bytes, wherever they occur: 100,000 literals and more, none of them collected.

    Literals are dealt into parts by their first bytes, each of which is looked for in all documents and summed
    up before the next one: what is on disk at once is the share of a part. In a part's scan the places where
    others begin are left at the first test.
    """
    w = F.split("text", " ")
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    with passing(spark):
        literals = written(table(spark, d, "documents").where(F.size(w) > 1).select(F.explode(pairs).alias("literal")).where(F.octet_length("literal").between(11, 15)).distinct(), "pairs")
        literals = literals.withColumn("pattern_id", F.xxhash64("literal"))
        n_literals = literals.count()
        parts = max(1, min(PARTS, -(-n_literals // PART_LITERALS)), -(-n_literals // MOST_LITERALS))
        part = F.pmod(F.xxhash64(F.substring(F.col("literal").cast("binary"), 1, 8)), F.lit(parts))
        sums = None
        for n in range(parts):
            with passing(spark):
                hits = scan_table(documents(spark, d), "text", literals.where(part == n), overlapping=True)
                # a literal is in one part
                own = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matches"), F.countDistinct("pattern_id").alias("n_literals"), F.sum(F.col("start").cast("long")).alias("sum_start"))
                own = lasting(own, "sums")
                sums = own if sums is None else sums.unionByName(own)
    return sums.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_matches", "n_literals", "sum_start")])


def regex_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Which of 500 regexes each document has: how many, and the sum of their ids."""
    own = PatternSet.builder()
    for r in REGEXES:
        own.regex(r)
    found = ensemble.flags_indexed(documents(spark, d), "text", own.build())
    ids = F.filter(F.transform("flags", lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    return found.select("doc_id", F.size(ids).cast("long").alias("n_regexes"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, i: a + i).alias("sum_ids"))


def scan_regions(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of pages that may hold one of a few rare literals, scanned exactly."""
    return regions.scan_regions(pages(spark, d), "html", PatternSet.of(*RARE))


def scan_whole_buffer(spark: SparkSession, d: str) -> DataFrame:
    """All documents as one haystack: overlapping hits at their places in the buffer, picked from left to right in blocks, and mapped back."""
    docs = documents(spark, d)
    offsets = written(batch.coalesce_map(docs, "doc_id", "text", limit=NO_LIMIT).select(F.col("id").alias("doc_id"), "offset"), "offsets")
    hits = S.scan_overlapping(docs, "text", PatternSet.of(*LITERALS)).join(offsets, "doc_id")
    moved = hits.select(F.lit(0).alias("buffer"), "pattern_id", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"), "doc_id", "offset")
    kept = chunk.leftmost_longest(moved.select("buffer", "pattern_id", "start", "end"), ["buffer"], PatternSet.of(*LITERALS).max_pattern_len)
    back = kept.join(moved.drop("buffer"), ["pattern_id", "start", "end"])
    return back.select("doc_id", "pattern_id", (F.col("start") - F.col("offset")).cast("int").alias("start"), (F.col("end") - F.col("offset")).cast("int").alias("end"))


# -- batches -------------------------------------------------------------------
def coalesce_map(spark: SparkSession, d: str) -> DataFrame:
    return batch.coalesce_map(documents(spark, d), "doc_id", "text", limit=NO_LIMIT).withColumnRenamed("id", "doc_id")


def decoalesce(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a scan, put at their places in the buffer and mapped back."""
    docs = documents(spark, d)
    offsets = batch.coalesce_map(docs, "doc_id", "text", limit=NO_LIMIT)
    hits = S.scan(docs, "text", PatternSet.of(*WORDS)).join(offsets.withColumnRenamed("id", "doc_id"), "doc_id")
    moved = hits.select("pattern_id", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"))
    return batch.decoalesce(moved, offsets).withColumnRenamed("id", "doc_id")


def planned_batches(spark: SparkSession, d: str) -> DataFrame:
    """The greedy plan of every 256 ids, whatever the size of the table."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return batch.planned_batches(docs, "doc_id", "text", ScanConfig(batch_inputs=64, batch_bytes=200_000), F.floor(F.col("doc_id") / 256)).withColumnRenamed("id", "doc_id")


def planned_table(spark: SparkSession, d: str) -> DataFrame:
    """The greedy plan of the whole table as one group."""
    return batch.planned_whole(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ScanConfig(batch_inputs=64, batch_bytes=200_000)).withColumnRenamed("id", "doc_id")


# -- stored and swapped sets, streams --------------------------------------------
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "index")
    save_index(spark, PatternSet.of(*LITERALS), path)
    return S.scan(documents(spark, d), "text", load_index(spark, path))


def index_names(spark: SparkSession, d: str) -> DataFrame:
    """What a stored set of the benchmark's words, named by what they are, says of its patterns, and how often each is found in documents."""
    own = PatternSet.builder()
    for k, p in enumerate(large_set(spark, d).patterns):
        own.named_literal(f"word:{p.literal.decode()}", p.literal.decode()) if k % 2 else own.literal(p.literal.decode())
    path = scratch(spark, "index")
    save_index(spark, own.named_regex("digits", DIGITS).build(), path)
    found = load_index(spark, path)
    totals = S.scan_totals(documents(spark, d), "text", found, [], places=False).groupBy("pattern_id").agg(F.sum("n_matches").alias("n_matches"))
    known = S.pattern_table(spark, found).join(totals, "pattern_id", "left")
    return known.select("pattern_id", "kind", F.coalesce("name", F.lit("-")).alias("name"), F.coalesce(F.octet_length("literal"), F.lit(0)).alias("n_bytes"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "props")


ODD_KEY = PatternSet.builder().regex("[13579]").build()


def _run(spark: SparkSession, parts: list[DataFrame], found: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, int]:
    """A stream that gets ``parts`` one after the other: what it wrote, and how many rows came too late."""
    base = scratch(spark, name)
    parts[0].limit(0).write.parquet(f"{base}/in")
    out = found(spark.readStream.schema(parts[0].schema).parquet(f"{base}/in"))
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").start()
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{base}/in")
            query.processAllAvailable()
        return spark.read.schema(out.schema).parquet(f"{base}/out"), late_rows(query)
    finally:
        query.stop()


def windowed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Matching events by hour, from a stream with a watermark: the hours that it has passed."""
    found, _ = _run(spark, [_events(spark, d)], lambda s: matches_by_window(s, "props", ODD_KEY, "ts", "event_id", "2 hours", length="1 hour"), "events")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("hour"), "n_events")


def late_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by sliding windows of two hours, where errors come after all others: those behind the watermark are left out and counted."""
    events = _events(spark, d)
    parts = [events.where("event_type <> 'error'"), events.where("event_type = 'error'")]
    found, late = _run(spark, parts, lambda s: matches_by_window(s, "props", ODD_KEY, "ts", "event_id", "200 hours", length="2 hours", slide="1 hour"), "late")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_events", F.lit(late).cast("long").alias("late_rows"))


def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user's matching events, half an hour without one apart, as far as the watermark has passed them."""
    found, _ = _run(spark, [_events(spark, d)], lambda s: matches_by_window(s, "props", ODD_KEY, "ts", "event_id", "2 hours", keys=["user_id"], gap="30 minutes"), "sessions")
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "n_events")


def swapped_stream(spark: SparkSession, d: str) -> DataFrame:
    """A running query that finds a new version of its set between two batches: English documents by the first, others by the second."""
    path, base = scratch(spark, "sets"), scratch(spark, "swapped")
    publish(spark, PatternSet.of(*LITERALS), path)
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    parts = [docs.where("lang = 'en'"), docs.where("lang is null or lang <> 'en'")]
    docs.limit(0).drop("lang").write.parquet(f"{base}/in")
    sink = lambda hits, number: hits.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
    source = spark.readStream.schema(docs.drop("lang").schema).parquet(f"{base}/in")
    query = scan_versions(source, "text", path, sink, keep=["doc_id"]).option("checkpointLocation", f"{base}/checkpoint").start()
    try:
        for k, part in enumerate(parts):
            if k:
                publish(spark, PatternSet.of(*OVERLAPPING[:3]), path)
            part.drop("lang").write.mode("append").parquet(f"{base}/in")
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{base}/out").drop("batch")


def keyed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as streams of turns that come in two batches, the second turns first, with typed state."""
    given = table(spark, d, "conversations")
    last = given.groupBy("conv_id").agg(F.max("turn").alias("last"))
    chunks = given.join(last, "conv_id").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), (F.col("turn") == F.col("last")).alias("eos"))
    before = spark.conf.get(STORE)
    use_rocksdb(spark)
    try:
        found, _ = _run(spark, [chunks.where("seq > 0"), chunks.where("seq = 0")], lambda s: scan_keyed_stream(s, PatternSet.of(*LITERALS)), "keyed")
    finally:
        spark.conf.set(STORE, before)
    return found.withColumnRenamed("stream_id", "conv_id")


def hot_swap(spark: SparkSession, d: str) -> DataFrame:
    patterns = HotSwapPatternSet(PatternSet.of("nothing"))
    patterns.swap(PatternSet.of("anan"))
    return documents(spark, d).transform(S.scanner("text", patterns))


def stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as streams of turns, read and scanned by Structured Streaming."""
    given = table(spark, d, "conversations")
    last = given.groupBy("conv_id").agg(F.max("turn").alias("last"))
    chunks = given.join(last, "conv_id").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), (F.col("turn") == F.col("last")).alias("eos"))
    base = scratch(spark, "stream")
    chunks.write.parquet(f"{base}/in")
    source = spark.readStream.schema(chunks.schema).parquet(f"{base}/in")
    found = scan_stream(source, PatternSet.of(*LITERALS))
    query = found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/out").withColumnRenamed("stream_id", "conv_id")


# -- matches as tables -----------------------------------------------------------
def pattern_names_join(spark: SparkSession, d: str) -> DataFrame:
    own = PatternSet.builder()
    for w in WORDS:
        own.named_literal(f"word:{w.strip()}", w)
    patterns = own.build()
    hits = S.scan(documents(spark, d), "text", patterns)
    names = S.pattern_table(spark, patterns).select("pattern_id", "name")
    return hits.join(F.broadcast(names), "pattern_id").groupBy("name").agg(F.count(F.lit(1)).alias("n_matches"), F.countDistinct("doc_id").alias("n_docs"))


def match_topk(spark: SparkSession, d: str) -> DataFrame:
    counts = S.scan_count(table(spark, d, "documents").select("doc_id", "lang", "text"), "text", PatternSet.of(*LITERALS))
    order = W.partitionBy("lang").orderBy(F.col("n_matches").desc(), "doc_id")
    return counts.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("lang", "rank", "doc_id", "n_matches")


def match_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = S.spread(table(spark, d, "documents").select("lang", "text"))
    totals = S.scan_totals(docs, "text", PatternSet.of(*LITERALS), ["lang"], places=False)
    out = totals.rollup("lang", "pattern_id").agg(F.sum("n_matches").alias("n_matches"), F.sum("n_bytes").alias("n_bytes"), F.grouping_id().alias("level"))
    return out.select("lang", F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id"), "n_matches", "n_bytes", F.col("level").cast("long").alias("level"))


def match_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Largest gap between neighbouring matches of a document, and matches by kilobyte; a document's matches stay together."""
    found = S.scan_nested(documents(spark, d), "text", PatternSet.of("tion", "ment", "sch")).where(F.size("matches") > 0)
    m = F.col("matches")
    gaps = F.zip_with(F.slice(m, 2, F.size(m)), F.slice(m, 1, F.size(m) - 1), lambda b, a: b["start"] - a["end"])
    kilobytes = F.array_distinct(F.transform(m, lambda x: F.floor(x["start"] / 1024)))
    return found.select("doc_id", F.coalesce(F.array_max(gaps), F.lit(-1)).cast("long").alias("largest_gap"), F.size(m).cast("long").alias("n_matches"), F.size(kilobytes).cast("long").alias("n_kilobytes"))


def match_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality")
    counts = S.scan_count(documents(spark, d), "text", PatternSet.of(*WORDS)).select("doc_id", "n_matches")
    return labels.join(counts, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_matches").alias("n_matches"))


def docs_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Matches by language and pattern, counted where they are found."""
    totals = S.scan_totals(S.spread(table(spark, d, "documents").select("lang", "text")), "text", PatternSet.of(*LITERALS), ["lang"])
    return totals.groupBy("lang", "pattern_id").agg(F.sum("n_matches").alias("n_matches"), F.min("least_start").alias("least_start"), F.max("largest_end").alias("largest_end"))


def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    patterns = PatternSet.builder().regex(EMAIL).regex(IP).build()
    return documents(spark, d).select("doc_id", F.md5(C.redact("text", patterns, "[x]").cast("binary")).alias("text_md5"))


def asof_matches(spark: SparkSession, d: str) -> DataFrame:
    """Of each event the last one of its user, not later, that matches."""
    events = _events(spark, d)
    hits = S.any_match(events, "props", ODD_KEY).select("user_id", F.col("ts").alias("match_ts"), F.col("event_id").alias("match_id"))
    found = asof_join(events.select("event_id", "user_id", "ts"), hits, "ts", "match_ts", ["user_id"], ["match_id"])
    return found.select("event_id", F.coalesce("match_id", F.lit(-1)).alias("match_id"))


def events_window_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = S.any_match(table(spark, d, "events"), "props", PatternSet.builder().regex("[13579]").build())
    return rows.groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n_events"))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return docs.select("doc_id", C.byte_count("text", 0x65).alias("n_e"), C.fnv1a32(F.substring("text", 1, 8)).alias("fnv1a32"), F.length(C.byte_view("text")).cast("long").alias("n_bytes"), F.size(C.match_texts("text", PatternSet.of(*LITERALS))).cast("long").alias("n_texts"), C.contains_any("text", PatternSet.of(*WORDS)).alias("has_word"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        docs_by_pattern, scan_literals, scan_single_literal, scan_literals_ci, scan_count, scan_visitor_limit, any_match, no_match, first_match, pattern_flags, scan_overlapping, scan_regex, scan_regex_pages,
        scan_mixed, scan_regex_arrow, scan_nested, batch_nested, scan_chunked, scan_chunked_leftmost, scan_large_set, scan_large_set_arrow, coalesce_map, decoalesce, planned_batches, index_roundtrip, hot_swap,
        scan_joined, scan_totals, scan_limited, scan_shortest_all, scan_needle_by_needle, scan_fallback, scan_bytes_and_names, any_match_arrow, scan_sql_function, scan_chunked_regex, shortest_by_start, matched_by_one_only, index_names, windowed_stream,
        scan_word_table, scan_pair_table, regex_ensemble, scan_regions, scan_whole_buffer, scan_table_function, planned_table, asof_matches, late_stream, session_stream, swapped_stream, keyed_stream,
        stream_scan, pattern_names_join, match_topk, match_rollup, match_gaps, match_labels, redacted_text, events_window_matches, scalar_functions,
    )
}


# -- SQL --------------------------------------------------------------------------
def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(literal: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in literal)


def _alternation(literals: tuple[str, ...]) -> str:
    return "|".join(_escaped(x) for x in sorted(literals, key=lambda x: -len(x.encode())))


def _hits(source: str, key: str, text: str, regex: str, ids: str) -> str:
    """Non-overlapping matches of a regex with byte offsets; ``ids`` makes the pattern id of the text w."""
    return f"""
        select {key}, {ids} as pattern_id, cast(e - strlen(w) as integer) as start, cast(e as integer) as "end" from (
            select {key}, w, sum(strlen(g) + strlen(w)) over (partition by {key} order by i) as e from (
                select {key}, unnest(m) as w, unnest(g[1:len(m)]) as g, unnest(range(len(m))) as i from (
                    select {key}, regexp_extract_all({text}, {_quote(regex)}) as m, string_split_regex({text}, {_quote(regex)}) as g from {source}
                )
            )
        )"""


def _ids(literals: tuple[str, ...], text: str = "w") -> str:
    return "cast(case " + " ".join(f"when {text} = {_quote(x)} then {i}" for i, x in enumerate(literals)) + " end as integer)"


def _literal_sql(literals: tuple[str, ...], source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return _hits(source, key, text, _alternation(literals), _ids(literals))


def _overlap_sql(literals: tuple[str, ...]) -> str:
    one = """select doc_id, cast({i} as integer) as pattern_id, cast(s as integer) as start, cast(s + {n} as integer) as "end" from (
        select doc_id, b, unnest(range(octet_length(b) - {n} + 1)) as s from (select doc_id, encode(text) as b from documents)) where b[s + 1:s + {n}] = encode({q})"""
    return " union all ".join(one.format(i=i, n=len(x.encode()), q=_quote(x)) for i, x in enumerate(literals))


def _nested_sql(hits: str) -> str:
    return f"""select d.doc_id, coalesce(m, '') as matches from documents d left join (
        select doc_id, string_agg(pattern_id || ',' || start || ',' || "end", ';' order by start, pattern_id) as m from ({hits}) group by doc_id) using (doc_id)"""


_any_word = f"regexp_matches(text, {_quote(_alternation(WORDS))})"
_regex = lambda i, r, source="documents", key="doc_id", text="text": _hits(source, key, text, r, f"cast({i} as integer)")
_count = lambda words: f"len(regexp_extract_all(text, {_quote(_alternation(words))}))"
_words = "select distinct w from (select unnest(string_split_regex(text, '[^a-z]+')) as w from benchmark) where length(w) >= 5"
_large_sql = f"""
    with words as (select w, cast(row_number() over (order by w) - 1 as integer) as pattern_id from ({_words})), one as (select string_agg(w, '|' order by length(w) desc) as r from words),
    found as (select doc_id, regexp_extract_all(text, r) as m, string_split_regex(text, r) as g from documents, one),
    hits as (select doc_id, unnest(m) as w, unnest(g[1:len(m)]) as g, unnest(range(len(m))) as i from found),
    ends as (select doc_id, w, sum(strlen(g) + strlen(w)) over (partition by doc_id order by i) as e from hits)
    select doc_id, pattern_id, cast(e - strlen(w) as integer) as start, cast(e as integer) as "end" from ends join words using (w)"""

_odd = "regexp_matches(props, '[13579]')"

ORACLE_SQL: dict[str, str] = {
    "scan_word_table": f"""select doc_id, w as literal, cast(e - strlen(w) as integer) as start, cast(e as integer) as "end" from ({_large_sql.split("select doc_id, pattern_id")[0]} select doc_id, w, e from ends)""",
    "scan_pair_table": """
        with words as (select string_split(text, ' ') as w from documents),
        pairs as (select distinct encode(p) as p from (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as p from words) where strlen(p) between 11 and 15),
        places as (select doc_id, b, unnest(range(octet_length(b))) as s from (select doc_id, encode(text) as b from documents)),
        pieces as (select doc_id, s, b[s + 1:s + n] as p from places, (select unnest(range(11, 16)) as n) where s + n <= octet_length(b))
        select doc_id, count(*) as n_matches, count(distinct p) as n_literals, sum(s)::bigint as sum_start from pieces join pairs using (p) group by doc_id""",
    "regex_ensemble": "select doc_id, " + ", ".join(f"{what} as {name}" for name, what in (("n_regexes", "list_sum(f)::bigint"), ("sum_ids", "list_sum(list_transform(f, lambda x, i: x * (i - 1)))::bigint"))) + " from (select doc_id, [" + ", ".join(f"regexp_matches(text, {_quote(r)})::int" for r in REGEXES) + "] as f from documents)",
    "scan_regions": _literal_sql(RARE, "pages", "page_id", "html"),
    "scan_whole_buffer": _literal_sql(LITERALS),
    "docs_by_pattern": f"""select lang, pattern_id, count(*) as n_matches, cast(min(start) as bigint) as least_start, cast(max("end") as bigint) as largest_end from ({_literal_sql(LITERALS)}) join (select doc_id, lang from documents) using (doc_id) group by lang, pattern_id""",
    "scan_literals": _literal_sql(LITERALS),
    "scan_single_literal": _literal_sql(("anan",)),
    "scan_literals_ci": _hits("documents", "doc_id", "text", "|".join("".join(f"[{c}{c.upper()}]" for c in x) for x in FOLDED), _ids(FOLDED, "lower(w)")),
    "scan_count": f"select doc_id, {_count(LITERALS)} as n_matches from documents",
    "scan_visitor_limit": f"""select * from ({_literal_sql(LITERALS)}) qualify row_number() over (partition by doc_id order by start) <= 3""",
    "any_match": f"select doc_id from documents where {_any_word}",
    "no_match": "select conv_id, turn from conversations where not coalesce(regexp_matches(text, 'tion|sch'), false)",
    "first_match": f"""select * from ({_literal_sql(("<article>", "<p>", "</nav>"), "pages", "page_id", "html")}) qualify row_number() over (partition by page_id order by start) = 1""",
    "pattern_flags": f"select doc_id, contains(text, 'tion') as f0, regexp_matches(text, {_quote(EMAIL)}) as f1, regexp_matches(text, {_quote(IP)}) as f2 from documents",
    "scan_overlapping": _overlap_sql(OVERLAPPING),
    "scan_regex": " union all ".join(_regex(i, r) for i, r in enumerate((EMAIL, IP, DIGITS))),
    "scan_regex_pages": " union all ".join(_regex(i, r, "pages", "page_id", "url") for i, r in enumerate((URL, DIGITS))),
    "scan_mixed": _hits("pages", "page_id", "html", "</p>|<p>|<", "cast(case w when '<p>' then 0 when '</p>' then 1 else 3 end as integer)") + " union all " + _regex(2, "<h[1-6]>", "pages", "page_id", "html"),
    "scan_regex_arrow": _regex(0, "(?:an|on){2,100}") + " union all " + _regex(1, IP),
    "scan_nested": _nested_sql(_literal_sql(LITERALS)),
    "batch_nested": _nested_sql(_literal_sql(WORDS)),
    **dict.fromkeys(("scan_large_set", "scan_large_set_arrow"), _large_sql),
    "scan_joined": _large_sql,
    "scan_totals": f"""select doc_id, pattern_id, count(*) as n_matches, cast(sum("end" - start) as bigint) as n_bytes, cast(min(start) as bigint) as least_start, cast(max("end") as bigint) as largest_end from ({_literal_sql(LITERALS)}) group by doc_id, pattern_id""",
    "scan_limited": _literal_sql(WORDS),
    "scan_shortest_all": f"""select doc_id, cast(i as integer) as pattern_id, start, "end" from ({_hits("documents", "doc_id", "text", "me|en|the|ment|thea", "w")}) join (values ('the', 0), ('thea', 1), ('ment', 2), ('the', 3), ('me', 4), ('en', 5)) as t(p, i) on p = pattern_id""",
    "scan_needle_by_needle": f"""
        with recursive found as ({" union all ".join(_regex(i, x) for i, x in enumerate(NEEDLES))}),
        sorted as (select *, row_number() over (partition by doc_id order by start, "end" desc, pattern_id) as k from found),
        walk as (
            select doc_id, pattern_id, start, "end", k, true as kept, "end" as reached from sorted where k = 1
            union all
            select s.doc_id, s.pattern_id, s.start, s."end", s.k, s.start >= w.reached, if(s.start >= w.reached, s."end", w.reached) from walk w join sorted s on s.doc_id = w.doc_id and s.k = w.k + 1
        ) select doc_id, pattern_id, start, "end" from walk where kept""",
    "scan_fallback": f"""select *, 'a regex of the set can''t run in the native strategy' as reason from ({_regex(0, "(?:an|on){2,100}")} union all {_regex(1, IP)})""",
    "scan_bytes_and_names": " union all ".join(f"select *, {_quote(n)} as name from ({_hits('documents', 'doc_id', 'text', r, f'cast({i} as integer)')})" for i, r, n in ((0, "ê", "-"), (1, DIGITS, "digits"), (2, "tion", "-"))),
    "any_match_arrow": "select doc_id from documents where regexp_matches(text, '(?:an|on){2,100}')",
    "scan_sql_function": _literal_sql(WORDS),
    "scan_chunked_regex": " union all ".join(_regex(i, r) for i, r in enumerate((IP, DIGITS))),
    "shortest_by_start": _overlap_sql(("anan", "heit", "ere")),
    "matched_by_one_only": "select doc_id from documents where contains(text, 'tion') and not regexp_matches(text, 'sch|ment')",
    "index_names": f"""
        with words as (select w, cast(row_number() over (order by w) - 1 as integer) as pattern_id from ({_words})), hits as ({_large_sql.strip()}), n as (select pattern_id, count(*) as n from hits group by pattern_id),
        digits as (select sum(len(regexp_extract_all(text, {_quote(DIGITS)})))::bigint as n from documents)
        select pattern_id, 'literal' as kind, if(pattern_id % 2 = 1, 'word:' || w, '-') as name, strlen(w)::integer as n_bytes, coalesce(n, 0)::bigint as n_matches from words left join n using (pattern_id)
        union all select (select count(*) from words)::integer, 'regex', 'digits', 0, n from digits""",
    "planned_table": """
        with recursive sized as (select doc_id, coalesce(octet_length(encode(text)), 0) as n, row_number() over (order by coalesce(octet_length(encode(text)), 0) desc, doc_id) as k from documents),
        plan as (
            select doc_id, n, k, 0 as batch, 0 as place, n as total from sized where k = 1
            union all
            select s.doc_id, s.n, s.k, if(p.place + 1 >= 64 or p.total + s.n > 200000, p.batch + 1, p.batch), if(p.place + 1 >= 64 or p.total + s.n > 200000, 0, p.place + 1), if(p.place + 1 >= 64 or p.total + s.n > 200000, s.n, p.total + s.n)
            from plan p join sized s on s.k = p.k + 1
        ) select doc_id, cast(batch as integer) as batch, cast(place as integer) as place from plan""",
    "scan_table_function": f"""select * from ({_literal_sql(("the", "thea", "ment"))}) union all {_regex(3, DIGITS)}""",
    "asof_matches": f"""select e.event_id, coalesce(m.event_id, -1) as match_id from events e asof left join (select * from events where {_odd}) m on e.user_id = m.user_id and e.ts >= m.ts""",
    "late_stream": f"""
        with found as (select *, event_type = 'error' as late from events where {_odd}), first as (select max(ts) - interval 200 hours as mark from found where not late),
        kept as (select ts from found, first where not late or ts > mark), last as (select max(ts) - interval 200 hours as mark from found),
        slid as (select date_trunc('hour', ts) - to_hours(k) as window_start from kept, (select unnest([0, 1]) as k))
        select window_start, count(*) as n_events, (select count(*) from found, first where late and ts <= mark) as late_rows from slid, last group by window_start, mark having window_start + interval 2 hours <= mark""",
    "session_stream": f"""
        with found as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as gap from events where {_odd}), last as (select max(ts) - interval 2 hours as mark from found),
        numbered as (select user_id, ts, sum(case when gap is null or gap > interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts) as k from found)
        select user_id, min(ts) as window_start, max(ts) + interval 30 minutes as window_end, count(*) as n_events from numbered, last group by user_id, k, mark having max(ts) + interval 30 minutes <= mark""",
    "swapped_stream": " union all ".join(f"select h.*, cast({v} as bigint) as version from ({_literal_sql(words)}) h join documents d using (doc_id) where {which}" for v, words, which in ((1, LITERALS, "lang = 'en'"), (2, OVERLAPPING[:3], "lang is null or lang <> 'en'"))),
    "windowed_stream": "select date_trunc('hour', ts) as hour, count(*) as n_events from events where regexp_matches(props, '[13579]') group by all having date_trunc('hour', any_value(ts)) + interval 1 hour <= (select max(ts) from events where regexp_matches(props, '[13579]')) - interval 2 hour",
    "planned_batches": """
        with recursive sized as (
            select doc_id, doc_id // 256 as "group", coalesce(octet_length(encode(text)), 0) as n, row_number() over (partition by doc_id // 256 order by coalesce(octet_length(encode(text)), 0) desc, doc_id) as k from documents
        ), plan as (
            select doc_id, "group", n, k, 0 as batch, 0 as place, n as total from sized where k = 1
            union all
            select s.doc_id, s."group", s.n, s.k, if(p.place + 1 >= 64 or p.total + s.n > 200000, p.batch + 1, p.batch), if(p.place + 1 >= 64 or p.total + s.n > 200000, 0, p.place + 1), if(p.place + 1 >= 64 or p.total + s.n > 200000, s.n, p.total + s.n)
            from plan p join sized s on s."group" = p."group" and s.k = p.k + 1
        ) select doc_id, "group", cast(batch as integer) as batch, cast(place as integer) as place from plan
    """,
    "scan_chunked": _overlap_sql(OVERLAPPING),
    "scan_chunked_leftmost": _literal_sql(("<p>", "<p><b>", "</p>"), "pages", "page_id", "html"),
    "coalesce_map": 'select doc_id, coalesce(sum(strlen(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", strlen(text) as length from documents',
    "decoalesce": _literal_sql(WORDS),
    "index_roundtrip": _literal_sql(LITERALS),
    "hot_swap": _literal_sql(("anan",)),
    "stream_scan": _literal_sql(LITERALS, "(select conv_id, string_agg(coalesce(text, ''), '' order by turn) as text from conversations group by conv_id)", "conv_id").replace("cast(e - strlen(w) as integer)", "cast(e - strlen(w) as bigint)").replace('cast(e as integer) as "end"', 'cast(e as bigint) as "end"'),
    "pattern_names_join": f"""select 'word:' || trim(list_extract([{', '.join(map(_quote, WORDS))}], pattern_id + 1)) as name, count(*) as n_matches, count(distinct doc_id) as n_docs from ({_literal_sql(WORDS)}) group by pattern_id""",
    "match_topk": f"select lang, row_number() over (partition by lang order by n_matches desc, doc_id)::integer as rank, doc_id, n_matches from (select lang, doc_id, {_count(LITERALS)} as n_matches from documents) qualify rank <= 10",
    "match_rollup": f"""select lang, coalesce(pattern_id, -1) as pattern_id, count(*) as n_matches, sum("end" - start)::bigint as n_bytes, grouping(lang, pattern_id)::bigint as level from ({_literal_sql(LITERALS)}) join (select doc_id, lang from documents) using (doc_id) group by rollup (lang, pattern_id)""",
    "match_gaps": f"""select doc_id, coalesce(max(gap), -1)::bigint as largest_gap, count(*) as n_matches, count(distinct start // 1024) as n_kilobytes from (select *, start - lag("end") over (partition by doc_id order by start) as gap from ({_literal_sql(("tion", "ment", "sch"))})) group by doc_id""",
    "match_labels": f"select quality, count(*) as n_docs, sum({_count(WORDS)})::bigint as n_matches from labels join documents using (doc_id) group by quality",
    "redacted_text": f"select doc_id, md5(regexp_replace(regexp_replace(text, {_quote(EMAIL)}, '[x]', 'g'), {_quote(IP)}, '[x]', 'g')) as text_md5 from documents",
    "events_window_matches": "select date_trunc('hour', ts) as hour, event_type, count(*) as n_events from events where regexp_matches(props, '[13579]') group by all",
    "scalar_functions": f"select doc_id, len(text) - len(replace(text, 'e', '')) as n_e, list_reduce(list_prepend(2166136261::bigint, list_transform(range(octet_length(encode(text[1:8]))), lambda i: cast('0x' || substr(hex(encode(text[1:8])), 2 * i + 1, 2) as bigint))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) as fnv1a32, strlen(text) as n_bytes, {_count(LITERALS)} as n_texts, {_any_word} as has_word from documents",
}
ORACLE_SQL["keyed_stream"] = ORACLE_SQL["stream_scan"]
