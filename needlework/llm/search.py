"""Exact top-k search by BM25 over inverted indexes with block maxima.

Every shard of documents has its own index: postings by term, with the largest
impact of a term in the shard and in each block of documents. Global numbers
(documents, mean length, documents by term) weigh the terms, so that scores of
different shards compare and the best of all shards are the best of all.

A shard is searched as in block-max WAND, with cursors over blocks of documents
that are all at the same block: the pivots are the blocks in which the block
maxima of a query's terms sum to the threshold, the k-th best score so far. All
other blocks are skipped, nothing of them is decoded. In a pivot block the terms
of the largest bounds come first; a document is scored in full only if their sum
and the block maxima of the rest still reach the threshold. Documents of a shard
are ordered so that like ones share blocks.

Queries are searched many at a time. What a shard's most frequent terms add,
which are most of the postings that a query meets, is then one product of
matrices for all of them, of single precision: with its error it bounds blocks
and documents from above. Blocks and rows of the other terms are as above, and
every document that may reach the threshold is scored in full.

Shards are searched in waves, each about three times as many as all before it,
so that most begin with a threshold that is close to the last one, and return
few documents. A query is its set of terms. Scores are rounded to six decimals;
ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .common import Scratch, scratch_path

K1, B = 1.2, 0.75
BLOCK = 64
#: Limits of a shard.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1_500_000
#: Terms of the queries that are searched at once, about; so much is broadcast.
QUERY_TERMS = 1_000_000
DECIMALS, MARGIN = 6, 1e-5
#: What the terms after the first ones may add at most in a pivot block, as a share of the threshold.
REST = 0.2
#: Terms of a shard that are held as a matrix at most, numbers in it, and in a product (of queries and documents).
DENSE_TERMS, DENSE_SIZE, PRODUCT_SIZE = 256, 1 << 22, 1 << 19
#: Shards of the first wave at most, and of one task.
FIRST_WAVE, TASK_SHARDS = 16, 4

_INDEX = "docs bigint, words bigint, ids binary, lengths binary, terms binary, offsets binary, posting_docs binary, posting_counts binary"


def terms_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different terms (hashes, ascending) and their counts."""
    terms, counts = np.unique(words.words_of(text)[3], return_counts=True)
    return terms, counts.astype(np.uint32)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard. Rows with a null id aren't indexed; a null text has no terms."""
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")).where("id is not null")
    names = [c.split()[0] for c in _INDEX.split(", ")]
    types = [pa.int64()] * 2 + [pa.binary()] * 6

    def shard(ids: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        # like documents share blocks: those with one most frequent term (so of one language), by length
        like = [(int(t[c.argmax()]) if len(t) else 0, int(c.sum()), key) for key, (t, c) in zip(ids, found, strict=True)]
        order = sorted(range(len(ids)), key=like.__getitem__)
        ids, found = [ids[k] for k in order], [found[k] for k in order]
        sizes = np.array([len(t) for t, _ in found], np.int64)
        lengths = np.array([c.sum(dtype=np.int64) for _, c in found], np.int64)
        term = np.concatenate([t for t, _ in found])
        count = np.concatenate([c for _, c in found])
        doc = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
        order = np.argsort(term, kind="stable")
        term, count, doc = term[order], count[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        row = [len(ids), int(lengths.sum()), np.array(ids, np.int64), lengths, term[first], np.append(first, len(term)), doc, count]
        return pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, int) else x.tobytes()], t) for x, t in zip(row, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, total = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = terms_of(text.as_py())
                ids.append(key)
                found.append(own)
                total += len(own[0])
                if total >= SHARD_POSTINGS or len(ids) == SHARD_DOCS:
                    yield shard(ids, found)
                    ids, found, total = [], [], 0
        if ids:
            yield shard(ids, found)

    return frame.mapInArrow(run, _INDEX)


class Shard:
    """An index in memory, its impacts for a mean length; by term, and by document for scoring in full."""

    def __init__(self, row: dict, mean_length: float):
        self.ids = np.frombuffer(row["ids"], np.int64)
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.docs = np.frombuffer(row["posting_docs"], np.uint16)
        self.impacts = np.frombuffer(row["posting_counts"], np.uint32).astype(np.float64)
        norms = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        self.impacts *= (K1 + 1) / (self.impacts + norms[self.docs])
        self.weights = np.zeros(len(self.terms))
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.offsets))
        # block maxima: runs of one term and one block
        block = (self.docs // BLOCK).astype(np.int32)
        heads = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.block_of, self.blocks = block[heads], -(-len(self.ids) // BLOCK)
        self.block_starts = np.append(heads, len(term))
        self.block_most = np.maximum.reduceat(self.impacts, heads) if len(heads) else np.zeros(0)
        self.block_offsets = np.searchsorted(term[heads], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impacts, self.offsets[:-1]) if len(self.terms) else np.zeros(0)
        # the same postings by document
        order = np.argsort(self.docs, kind="stable")
        self.doc_terms, self.doc_impacts = term[order], self.impacts[order]
        self.doc_offsets = np.searchsorted(self.docs[order], np.arange(len(self.ids) + 1))
        #: Postings in the blocks of all searches' terms, and how many of them were decoded.
        self.postings = self.decoded = 0

    @staticmethod
    def _gather(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the chosen lists, and the entries of each."""
        sizes = offsets[which + 1] - offsets[which]
        ends = np.cumsum(sizes)
        return np.repeat(offsets[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes

    def _decode(self, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the chosen blocks of lists add to every document."""
        at, sizes = self._gather(self.block_starts, entries)
        self.decoded += len(at)
        return np.bincount(self.docs[at], self.impacts[at] * np.repeat(weights, sizes), len(self.ids))

    def _full(self, docs: np.ndarray, which: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of the given documents by all terms of the query."""
        self.weights[which] = weights
        at, sizes = self._gather(self.doc_offsets, docs)
        total = np.bincount(np.repeat(np.arange(len(docs)), sizes), self.weights[self.doc_terms[at]] * self.doc_impacts[at], len(docs))
        self.weights[which] = 0
        return total

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` documents, best first; such as have less than ``floor`` may be left out."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(self.terms) or not len(terms):
            return none
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[at] == terms
        at, weights = at[hit], weights[hit]
        if not len(at):
            return none
        bound = weights * self.most[at]
        order = np.argsort(-bound, kind="stable")
        at, weights = at[order], weights[order]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)  # bounds of the terms from here on
        least = floor - MARGIN
        if rest[0] < least:
            return none
        # where the cursors may stop: blocks by the sum of their maxima
        entries, sizes = self._gather(self.block_offsets, at)
        blocks, by_entry = self.block_of[entries], np.repeat(weights, sizes)
        most = self.block_most[entries] * by_entry
        bounds = np.bincount(blocks, most, self.blocks)
        self.postings += int((self.offsets[at + 1] - self.offsets[at]).sum())
        if floor <= 0 and len(self.ids) > k:
            # a threshold from the most promising blocks
            few = np.zeros(self.blocks, bool)
            few[np.argsort(-bounds, kind="stable")[: 1 + -(-2 * k // BLOCK)]] = True
            own = few[blocks]
            best = self._decode(entries[own], by_entry[own])
            least = max(least, np.partition(best, -k)[-k] - MARGIN)
        pivots = bounds >= least
        done = min(len(at), max(1, int(np.searchsorted(-rest, -REST * least)))) if least > 0 else len(at)
        first = int(sizes[:done].sum())
        own = pivots[blocks[:first]]
        scores = self._decode(entries[:first][own], by_entry[:first][own])
        left = np.bincount(blocks[first:], most[first:], self.blocks)
        block_of_doc = np.arange(len(self.ids)) // BLOCK
        docs = np.flatnonzero(pivots[block_of_doc] & (scores + left[block_of_doc] >= least) & ((scores > 0) | (left[block_of_doc] > 0)))
        if len(docs) > k:  # the k-th best so far may say more
            least = max(least, np.partition(scores[docs], -k)[-k] - MARGIN)
            docs = docs[scores[docs] + left[docs // BLOCK] >= least]
        total = np.round(self._full(docs, at, weights) if done < len(at) else scores[docs], DECIMALS)
        keep = total > 0
        if len(docs) > k:
            keep &= total >= np.partition(total, -k)[-k]
        docs, total = docs[keep], total[keep]
        best = np.lexsort((self.ids[docs], -total))[:k]
        return self.ids[docs[best]], total[best]

    def _dense(self) -> None:
        """Impacts of the most frequent terms by document, and their maxima by block."""
        n = min(DENSE_TERMS, DENSE_SIZE // max(1, len(self.ids)), len(self.terms))
        frequent = np.sort(np.argsort(self.offsets[:-1] - self.offsets[1:], kind="stable")[:n])
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[frequent] = np.arange(n)
        self.by_doc, self.by_block = np.zeros((n, len(self.ids)), np.float32), np.zeros((n, self.blocks), np.float32)
        at, sizes = self._gather(self.offsets, frequent)
        self.by_doc[np.repeat(np.arange(n), sizes), self.docs[at]] = self.impacts[at]
        at, sizes = self._gather(self.block_offsets, frequent)
        self.by_block[np.repeat(np.arange(n), sizes), self.block_of[at]] = self.block_most[at]
        #: Sums of positive numbers of single precision, rounded twice, are off by this share at most.
        self.off = (n + 3) * 2.0**-23

    def search_all(self, starts: list[int], terms: np.ndarray, weights: np.ndarray, k: int, floors: list[float]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As ``search`` for many queries, the terms of query q from ``starts[q]`` to ``starts[q + 1]``: q, ids and scores, where there are any."""
        if not len(self.terms) or not len(terms):
            return
        self._dense()
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hits = np.flatnonzero(self.terms[place] == terms)
        cuts = np.searchsorted(hits, starts)
        some = max(1, PRODUCT_SIZE // len(self.ids))
        n = len(self.by_doc)
        doc_blocks = np.arange(len(self.ids)) // BLOCK
        for first in range(0, len(floors), some):
            last = min(len(floors), first + some)
            own = hits[cuts[first] : cuts[last]]
            column = self.column[place[own]]
            of = np.repeat(np.arange(last - first), np.diff(cuts[first : last + 1]))
            asked = np.zeros((last - first, n), np.float32)
            asked[of[column >= 0], column[column >= 0]] = weights[own[column >= 0]]
            by_doc, by_block = (asked @ self.by_doc).astype(np.float64), asked @ self.by_block
            for q in range(first, last):
                mine = hits[cuts[q] : cuts[q + 1]]
                if not len(mine):
                    continue
                least = floors[q] - MARGIN
                rare = mine[self.column[place[mine]] < 0]
                entries, sizes = self._gather(self.block_offsets, place[rare])
                by_entry = np.repeat(weights[rare], sizes)
                blocks = self.block_of[entries]
                bounds = np.bincount(blocks, self.block_most[entries] * by_entry, self.blocks) + by_block[q - first] * (1 + self.off)
                pivots = bounds >= least
                if not pivots.any():
                    continue
                whole = pivots.all()
                if not whole:
                    inside = pivots[blocks]
                    entries, by_entry = entries[inside], by_entry[inside]
                dense = by_doc[q - first]
                most = self._decode(entries, by_entry) + dense * (1 + self.off)
                docs = np.flatnonzero((most >= least) & (most > 0))
                docs = docs if whole else docs[pivots[doc_blocks[docs]]]
                if len(docs) > k:  # the k-th best so far may say more
                    at_least = most[docs] - 2 * self.off * dense[docs]
                    docs = docs[most[docs] >= np.partition(at_least, -k)[-k] - MARGIN]
                if not len(docs):
                    continue
                total = np.round(self._full(docs, place[mine], weights[mine]), DECIMALS)
                keep = total > 0
                if len(docs) > k:
                    keep &= total >= np.partition(total, -k)[-k]
                docs, total = docs[keep], total[keep]
                best = np.lexsort((self.ids[docs], -total))[:k]
                if len(best):
                    yield q, self.ids[docs[best]], total[best]


def _query_rows(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    frame = queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).where("id is not null and body is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t.as_py())[0].view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["query_id", "n", "terms"])

    return frame.mapInArrow(run, "query_id bigint, n bigint, terms array<bigint>").where("n > 0").dropDuplicates(["query_id", "terms"])


def _document_counts(index: DataFrame) -> DataFrame:
    """(term, n): in how many documents of all shards each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, offsets in zip(batch.column(0), batch.column(1), strict=True):
                own, sizes = np.frombuffer(own.as_py(), np.int64), np.diff(np.frombuffer(offsets.as_py(), np.int64))
                for c in range(0, len(own), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(own[c : c + 100_000]), pa.array(sizes[c : c + 100_000])], ["term", "n"])

    return index.select("terms", "offsets").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _weighted(asked: DataFrame, index: DataFrame, docs: int) -> DataFrame:
    """``asked`` with the weights of its terms; terms of no document are left out."""
    term = asked.select("query_id", F.xxhash64("terms").alias("key"), F.explode("terms").alias("term"))
    known = term.join(_document_counts(index), "term").withColumn("idf", F.log1p((docs - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    whole = known.groupBy("query_id", "key").agg(F.collect_list(F.struct("term", "idf")).alias("own"))
    return whole.select("query_id", F.size("own").cast("long").alias("n"), F.col("own.term").alias("terms"), F.col("own.idf").alias("weights"))


def _search_wave(index: DataFrame, shards: int, held, mean_length: float, k: int) -> DataFrame:
    """(query_id, doc_id, score): of each task's shards the best ``k`` documents for each query of ``held``, if they reach its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, terms, weights, floors = held.value
        best: list[list[tuple[float, int]]] = [[] for _ in ids]  # of all shards so far: (-score, id)
        least = list(floors)
        for batch in batches:
            for n in range(batch.num_rows):
                shard = Shard(batch.slice(n, 1).to_pylist()[0], mean_length)
                for q, docs, scores in shard.search_all(starts, terms, weights, k, least):
                    own = best[q] = sorted([*best[q], *zip((-scores).tolist(), docs.tolist(), strict=True)])[:k]
                    if len(own) == k:
                        least[q] = max(least[q], -own[-1][0])
        rows = [(i, doc, -score) for i, own, floor in zip(ids, best, least, strict=True) for score, doc in own if -score >= floor]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "doc_id", "score"])

    # a task takes several shards, the later of which profit from the thresholds of the earlier
    tasks = -(-shards // TASK_SHARDS)
    return index.drop("docs", "words", "wave").coalesce(tasks).mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "doc_id", query_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents for each query: query_id, rank (from 1), doc_id, score.

    Queries with a null id or text, or without a word, have no result, and a
    document that shares no term with a query isn't in its result. Repeated
    documents are documents of their own; of queries that repeat an id each is
    searched and the best of all stay. A text of any length is taken whole, its
    terms in memory; a shard ends with the text that fills it. Other columns
    are ignored, whatever their names; an empty table gives an empty result.

    Queries are searched in blocks of about ``QUERY_TERMS`` terms, each against
    all shards: a block is what the driver and the executors hold of them.
    """
    spark: SparkSession = docs.sparkSession
    out = scratch_path(spark, "found")
    schema = "query_id bigint, doc_id bigint, score double"
    spark.createDataFrame([], schema).write.parquet(out)
    found = lambda: spark.read.schema(schema).parquet(out)
    with Scratch(spark) as scratch:
        index = scratch.keep(build_index(docs, id_col, text_col), "index")
        sums = index.agg(F.count(F.lit(1)).alias("shards"), F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        asked = scratch.keep(_query_rows(queries, query_id_col, query_text_col), "queries")
        weighted = scratch.keep(_weighted(asked, index, sums["docs"] or 0), "weighted")
        size = weighted.agg(F.sum("n").alias("n")).first()["n"] or 0
        waves = 1
        while sums["shards"] > FIRST_WAVE * 4 ** (waves - 1):
            waves += 1
        # the last wave has three quarters of the shards, the one before three quarters of the rest, and so on
        part = F.xxhash64("ids") / float(1 << 63) / 2 + 0.5
        index = index.withColumn("wave", sum((F.when(part < 0.25**n, 1).otherwise(0) for n in range(1, waves)), F.lit(0)))
        sizes = {r["wave"]: r["count"] for r in index.groupBy("wave").count().collect()}
        blocks = -(-size // QUERY_TERMS)
        for block in range(blocks):
            rows = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()
            if not rows:
                continue
            ids = [r["query_id"] for r in rows]
            starts = np.cumsum([0, *[r["n"] for r in rows]]).tolist()
            terms = np.concatenate([np.array(r["terms"], np.int64) for r in rows]).view(np.uint64)
            weights = np.concatenate([np.array(r["weights"]) for r in rows])
            floors: dict[int, float] = {}
            for wave in sorted(sizes, reverse=True):
                held = spark.sparkContext.broadcast((ids, starts, terms, weights, [floors.get(i, 0.0) for i in ids]))
                _search_wave(index.where(F.col("wave") == wave), sizes[wave], held, sums["words"] / sums["docs"], k).write.mode("append").parquet(out)
                held.destroy()
                if wave:  # the k-th best so far of the block's queries
                    own = found().where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
                    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc())))
                    floors = {r["query_id"]: r["score"] for r in ranked.where(F.col("rank") == k).collect()}
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return found().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
