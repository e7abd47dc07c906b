"""Language identification as inference of a mixture of languages.

A language is a distribution over hashed character trigrams. A document is a
mixture of languages; expectation-maximisation finds the proportions, and a
language joins the document's set only while the gain in log-likelihood beats a
penalty that grows with the logarithm of the document's length (as in the
Bayesian information criterion).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import small
from .common import unused

BUCKETS = 1 << 16
#: Code points that are counted at once, so that a very long text needs no more memory.
PIECE = 1 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different trigrams (hashed) around the letters of a text, and their counts."""
    low, pieces = text.lower(), []
    carry = np.zeros(1, np.uint32)
    for k in range(0, max(1, len(low)), PIECE):
        codes = np.frombuffer(low[k : k + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        end = np.zeros(int(k + PIECE >= len(low)), np.uint32)
        codes = np.concatenate([carry, np.where(letters()[codes], codes, 0).astype(np.uint32), end])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        carry = codes[-2:]
        if len(codes) < 3:
            continue
        hashed = codes[:-2] * np.uint32(0x9E3779B1) ^ (codes[1:-1] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0xC2B2AE35) + codes[2:] * np.uint32(0x165667B1)
        hashed = (hashed ^ (hashed >> np.uint32(16))) & np.uint32(BUCKETS - 1)
        pieces.append(np.unique(hashed[codes[1:-1] != 0].astype(np.int64), return_counts=True))
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(pieces) == 1:
        return pieces[0]
    total = np.zeros(BUCKETS, np.int64)
    for found, counts in pieces:
        total[found] += counts
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    languages: list[str]
    probability: np.ndarray  # float32, language by bucket

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray, smoothing: float = 0.3) -> Model:
        counts = counts + smoothing
        return cls(languages, (counts / counts.sum(1, keepdims=True)).astype(np.float32))

    def mixture(self, found: np.ndarray, counts: np.ndarray, penalty: float, rounds: int = 30) -> dict[int, float]:
        """Proportion by language of the selected set, given distinct trigrams and their counts."""
        p, c = self.probability[:, found].astype(np.float64), counts.astype(np.float64)
        n, price = c.sum(), penalty * np.log1p(c.sum())
        alone = np.log(p) @ c
        chosen = [int(alone.argmax())]
        weights, density, fit = np.ones(1), p[chosen[0]], alone[chosen[0]]
        rest = [k for k in range(len(p)) if k != chosen[0]]
        while rest:
            ratio = p[rest] / density
            # of those that raise the likelihood from a share of 0, the best share by EM
            share = np.where(ratio @ c > n, 0.2, 0.0)
            if not share.any():
                break
            for _ in range(6):
                share = share * ((ratio / (1 + share[:, None] * (ratio - 1))) @ c) / n
            gain = np.log1p(share[:, None] * (ratio - 1)) @ c
            k = int(gain.argmax())
            if gain[k] <= 0.5 * price:
                break
            trial, w = [*chosen, rest[k]], np.append(weights * (1 - share[k]), share[k])
            own = p[trial]
            for _ in range(rounds):
                new = w * ((own / (w @ own)) @ c) / n
                done = np.abs(new - w).max() < 1e-4
                w = new
                if done:
                    break
            better = np.log(w @ own) @ c
            if better - fit <= price:
                break
            chosen, weights, density, fit = trial, w, w @ own, better
            rest.pop(k)
        return dict(zip(chosen, (weights / weights.sum()).tolist(), strict=True))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 2000) -> Model:
    """A model of every language that labels a row with at least one letter.

    It is fitted on ``rows_per_language`` rows of each language at most, those
    of the least hashes of id and text, so equal tables give equal models and
    texts that repeat don't go together. Rows that repeat with their id are one
    row. Rows with a null text or language, or without a letter, don't count.
    The number of languages is that of a label set: their names, the hashes up
    to which rows count and the trigram counts come to the driver.
    """
    letter = F.col("text").rlike(r"\p{L}")
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("key")).where("text is not null and lang is not null").where(letter)
    by = W.partitionBy("lang").orderBy("key")
    keys = rows.select("lang", "key").distinct()
    # about four times as many by a bound of the hash, so that no task sorts all rows of a common language
    share = {r["lang"]: min(1.0, 4 * rows_per_language / r["n"]) for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    bound = F.element_at(F.create_map(*[F.lit(x) for lang, f in sorted(share.items()) for x in (lang, f)]), F.col("lang"))
    few = keys.where(F.col("key") / float(1 << 64) + 0.5 <= bound)
    least = few.withColumn("n", F.row_number().over(by)).where(F.col("n") <= rows_per_language)
    upto = {r["lang"]: r["key"] for r in least.groupBy("lang").agg(F.max("key").alias("key")).collect()}
    if not upto:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    last = F.element_at(F.create_map(*[F.lit(x).cast("string" if isinstance(x, str) else "long") for lang, key in sorted(upto.items()) for x in (lang, key)]), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found, counts = grams(text.as_py())
                if len(found):
                    total.setdefault(lang, np.zeros(BUCKETS, np.int64))[found] += counts
        for lang, counts in total.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(counts[found])], ["lang", "gram", "n"])

    sample = rows.where(F.col("key") <= last).select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint")
    got = sample.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in got["lang"]], got["gram"]] = got["n"]
    return Model(languages, counts) if not languages else Model.of(languages, counts)


def mixtures(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """(row, lang_pred, score, languages): the rows of ``docs`` as structs, so that no name can clash, and what ``identify`` says of them."""
    kinds = T.StructType([T.StructField("row", docs.select(F.struct("*").alias("row")).schema[0].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    kinds = kinds.add("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("weight", T.DoubleType())])))
    shape = pa.list_(pa.struct([("lang", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                best, score, every = [], [], []
                for text in part.column(1):
                    found, counts = grams(text.as_py() or "")
                    mixture = model.mixture(found, counts, penalty) if len(found) and model.languages else {}
                    mixed = sorted(((w, model.languages[k]) for k, w in mixture.items()), key=lambda x: (-x[0], x[1]))
                    best.append(mixed[0][1] if mixed else UNKNOWN)
                    score.append(min(1.0, mixed[0][0]) if mixed else 0.0)
                    every.append([{"lang": lang, "weight": w} for w, lang in mixed])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(every, shape)], ["row", "lang_pred", "score", "languages"])

    return docs.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").cast("string").alias("body")).mapInArrow(run, kinds)


def identify(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """``id_cols`` with lang_pred, score and languages (array of lang and weight, largest first).

    ``score`` is the share of the predicted language. A text that is null or
    has no letter is ``und`` with a score of 0 and no languages; so is every
    text if the model has none. Rows are independent: ids may be null or
    repeat. A text of any length is taken whole. Columns of ``id_cols`` that
    have the name of a result's column are left out. Nothing is shuffled.
    """
    result = ["lang_pred", "score", "languages"]
    body = unused(docs.select(*id_cols), "body")
    slim = docs.select(*[F.col(f"`{c}`") for c in id_cols], F.col(f"`{text_col}`").alias(body))
    return mixtures(slim, model, body, penalty).select(*[F.col("row")[c].alias(c) for c in id_cols if c.lower() not in result], *result)
