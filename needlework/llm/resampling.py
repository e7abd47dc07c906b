"""Importance resampling towards a target distribution of hashed n-grams, by an external sort-count.

The features of every document are written once, as packed streams of uint16
bucket numbers with the documents' offsets. Counts come from these streams:
each is sorted and run-length encoded, and the runs are merged. Gains are then
gathered along the same streams and summed by document with ``np.add.reduceat``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, materialize, text_or_empty

#: Features of a stream, about; a document with more of them is cut into several.
BLOCK = 1 << 20
#: Documents of a stream at most.
DOCUMENTS = 4096
#: Bytes whose words are held at once.
SLICE = 1 << 21

#: A-Z become lower case, whatever is in no word becomes a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_hashes(text: bytes, grams: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """(words, CRC-32 of the features that end in them) for one slice of a text after the other.

    A word is a longest run of ASCII digits, letters (A-Z in lower case) and
    bytes of other characters; a feature is a run of up to ``grams`` words,
    joined by one space. The CRC of a longer run goes on from that of the
    shorter one, so no run is ever put together.
    """
    flat, at, lead = text.translate(_WORD_BYTES), 0, []
    while at < len(flat):
        end = flat.find(b" ", at + SLICE)
        end = len(flat) if end < 0 else end
        new = flat[at:end].split()
        at = end
        words = lead + new
        level = list(map(crc32, words))
        found = level[len(lead) :]
        for g in range(2, grams + 1):
            level = list(map(crc32, words[g - 1 :], map(crc32, repeat(b" "), level)))  # the run that begins at each word
            found += level[max(0, len(lead) - g + 1) :]
        yield len(new), np.array(found, np.uint32)
        lead = words[max(0, len(words) - grams + 1) :] if grams > 1 else []


def bucket_streams(docs: DataFrame, buckets: int = 10_000, grams: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The features of ``docs`` as blocks: ids, n_words and offsets of the documents, the stream of their buckets (uint16, little-endian).

    A document with more than ``BLOCK`` features has blocks of its own, whose
    ``cut`` names it (null elsewhere). Nothing is shuffled.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbers of 16 bits")
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(kind)), T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.IntegerType())), T.StructField("stream", T.BinaryType()), T.StructField("cut", T.LongType())]
    )
    frame = docs.select(docs[id_col].alias("row_id"), text_or_empty(docs[text_col].cast("string")).cast("binary").alias("body"))

    def block(ids: pa.Array, words: list[int], parts: list[np.ndarray], cut: int | None) -> pa.RecordBatch:
        sizes = [len(p) for p in parts]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        stream = (np.concatenate(parts) % np.uint32(buckets)).astype("<u2").tobytes() if parts else b""
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
        columns = [one(ids), one(pa.array(words, pa.int64())), one(pa.array(offsets)), pa.array([stream], pa.binary()), pa.array([cut], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, cuts = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, first, words, parts, held = batch.column(0), 0, [], [], 0
            for row, body in enumerate(batch.column(1)):
                own_words, own, size, cut = 0, [], 0, None
                for n, hashes in feature_hashes(body.as_py(), grams):
                    own_words, size = own_words + n, size + len(hashes)
                    own.append(hashes)
                    if size >= BLOCK:
                        if cut is None:
                            cut, cuts = task + cuts, cuts + 1
                        yield block(ids.slice(row, 1), [own_words], [np.concatenate(own)], cut)
                        own_words, own, size = 0, [], 0
                last = np.concatenate(own) if own else np.zeros(0, np.uint32)
                if cut is not None or held + size > BLOCK or row - first >= DOCUMENTS:
                    if words:
                        yield block(ids.slice(first, row - first), words, parts, None)
                    first, words, parts, held = row, [], [], 0
                if cut is not None:
                    if own:
                        yield block(ids.slice(row, 1), [own_words], [last], cut)
                    first = row + 1
                else:
                    words.append(own_words)
                    parts.append(last)
                    held += size
            if words:
                yield block(ids.slice(first, len(words)), words, parts, None)

    return frame.mapInArrow(run, schema)


def bucket_counts(streams: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) of the buckets that occur: streams sorted, runs counted, and the runs of all merged.

    A task gives ``buckets`` rows at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                x = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                if len(x):
                    starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
                    total[x[starts]] += np.diff(np.append(starts, len(x)))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    return streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln) of how much more often each bucket is in the target, with one more of each; from two tables of counts.

    ``buckets`` numbers of each come to the driver, however large the tables are.
    """
    counts = []
    for df in (source, target):
        own = np.zeros(buckets, np.int64)
        for bucket, n in df.select("bucket", "n").toLocalIterator():
            own[bucket] = n
        counts.append(own)
    (s, t), (all_s, all_t) = counts, (float(c.sum()) for c in counts)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (all_s + buckets) / ((float(a) + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def document_sums(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and total of gains of every document, or of each of its blocks if ``cut`` isn't null."""
    kind = streams.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "total", "cut")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, words, offsets = (batch.column(k)[row].values for k in range(3))
                x = np.frombuffer(batch.column(3)[row].as_buffer(), "<u2")
                at = offsets.to_numpy()
                sizes = np.diff(np.append(at, len(x)))
                total = np.zeros(len(at), np.int64)
                full = sizes > 0  # reduceat has no empty sums
                if full.any():
                    total[full] = np.add.reduceat(gain[x], at[full])
                cut = pa.array([batch.column(4)[row].as_py()] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(sizes.astype(np.int64)), pa.array(total), cut], schema.names)

    return streams.mapInArrow(run, schema)


def gumbel(ident: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of ``seed:ident``; a null identifier counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighted: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``weighted`` (id, score and more) with rank 1, 2, 3… of the floor(``percent`` N / 100) highest scores among the N eligible, else null.

    Ties go to the smaller id (nulls last), then to fewer features. Only scores
    and their counts come to the driver: gains and Gumbel numbers are whole
    thousandths of logarithms of 64-bit counts, so there are fewer than 200,000.
    Only rows at or above the lowest drawn score are shuffled, by score.
    """
    counts = dict(weighted.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toLocalIterator())
    left = sum(counts.values()) * percent // 100
    before, rows = 0, []
    drawn = left
    for score in sorted(counts, reverse=True):
        if before >= drawn:
            break
        rows.append((score, before))
        before += counts[score]
    if not rows:
        return weighted.withColumn("rank", F.lit(None).cast("long"))
    high = F.coalesce(eligible, F.lit(False)) & (F.col("score") >= rows[-1][0])
    starts = F.broadcast(weighted.sparkSession.createDataFrame(rows, "score long, before long"))
    order = W.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    ranked = weighted.where(high).withColumn("place", F.row_number().over(order)).join(starts, "score")
    rank = F.col("before") + F.col("place")
    ranked = ranked.withColumn("rank", F.when(rank <= drawn, rank)).select(*weighted.columns, "rank")
    return weighted.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, grams: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``id_col``, n_features, weight, score and rank of every row of ``docs``.

    weight is the floored mean gain of a row's features, score adds Gumbel
    noise that its identifier decides, and ``percent`` of the rows with
    ``least_words`` words or more are drawn by score (rank; null for others).

    A null text has no features, as an empty one (weight 0). A text of any
    length is read whole, in slices. Rows that repeat are rows of their own:
    equal identifiers have equal noise. A null identifier counts as an empty
    string for the noise and comes last among ties. An empty table gives an
    empty result, an empty target gains from its one of each alone. Other
    columns of ``docs``, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    with Scratch(spark) as own:
        source = own.keep(bucket_streams(docs, buckets, grams, id_col, text_col), "streams")
        wanted = own.keep(bucket_streams(target.select(F.lit(None).cast("long").alias("row"), F.col(f"`{target_col}`").alias("body")), buckets, grams, "row", "body"), "target")
        gain = gains(bucket_counts(source, buckets), bucket_counts(wanted, buckets), buckets)
        sums = own.keep(document_sums(source, gain), "sums")
        whole = sums.where("cut is null").drop("cut")
        long = sums.where("cut is not null").groupBy("cut").agg(F.first("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "total")]).drop("cut")
        weight = F.expr("coalesce((total - pmod(total, nullif(n_features, 0))) div nullif(n_features, 0), 0)")  # floors go down
        all_of = whole.unionByName(long).withColumn("weight", weight.cast("long")).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
        weighted = materialize(all_of.select("id", "n_words", "n_features", "weight", "score"), "weighted")
    ranked = draw(weighted, F.col("n_words") >= least_words, percent)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
