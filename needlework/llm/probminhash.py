"""Near-duplicate detection by ProbMinHash, banding and verification.

A document is a weighted set: its runs of five words, each with the weight
1 + ln(occurrences). Every element is a Poisson process whose rate is its
weight; each arrival falls to a register, and a register keeps the element that
came first. Two registers agree with the probability Jaccard similarity of the
sets. An element stops once its next arrival is later than all registers.

Documents with equal sets are one representative. Representatives that share a
band's bucket are compared with its most popular member and their neighbours in
its order; a pair is a link if the exact similarity of its whole texts reaches
the threshold. Most buckets are one class then. Buckets that aren't are joined,
where they share members, to families, and every member outside a family's
largest class is looked up in inverted indexes of the family's shingles, block
by block: no pair of different classes is left out, and none but links is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .bpe import small
from .common import Scratch, components, first_of_key, materialize, unused

REGISTERS, BANDS = 80, 16
#: Members of a bucket that each is compared with first, beside the most popular.
NEIGHBOURS = 3
#: Parts in which a bucket's members are counted and ordered.
SALTS = 32
#: Shingles of the members of a family in one index, about.
BLOCK = 500_000


def weighted_set(text: str, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles (sorted hashes) and their weights; fewer than ``k`` words are one shingle."""
    h = words.words_of(text)[3]
    if 0 < len(h) < k:
        s = words.shingles(h, len(h))
    else:
        s = words.shingles(h, k)
    found, counts = np.unique(s, return_counts=True)
    return found, 1.0 + np.log(counts)


def signature(elements: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The element in each of ``m`` registers."""
    held, times = np.zeros(m, np.uint64), np.full(m, np.inf)
    clock, alive, step = np.zeros(len(elements)), np.arange(len(elements)), 0
    while len(alive):
        # arrivals at once: about as many as fill the registers
        width = max(1, int(1.5 * m * np.log(m) / len(alive)) if step == 0 else 1)
        seed = elements[alive, None] + np.arange(step + 1, step + width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        drawn = words.mix(seed)
        gaps = -np.log((drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights[alive, None]
        at = clock[alive, None] + np.cumsum(gaps, 1)
        where = (words.mix(drawn ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(m)).astype(np.int64)
        clock[alive], step = at[:, -1], step + width
        t, r, e = at.ravel(), where.ravel(), np.repeat(elements[alive], width)
        early = np.flatnonzero(t < times[r])
        early = early[np.lexsort((e[early], t[early]))[::-1]]  # the earliest is written last
        times[r[early]] = t[early]
        held[r[early]] = e[early]
        alive = alive[clock[alive] < times.max()]
    return held


def bands(registers: np.ndarray, count: int = BANDS) -> np.ndarray:
    rows = len(registers) // count
    grid = registers[: rows * count].reshape(count, rows)
    total = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        total = words.mix(total ^ grid[:, k]) + np.uint64(k)
    return total.astype(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common elements of 1 / sum of max(wa' / wa, wb' / wb) over all elements."""
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)] = wa
    y[np.searchsorted(every, b)] = wb
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio)
    ratio, x, y = ratio[order], x[order], y[order]
    below = np.concatenate([[0], np.cumsum(y)])  # sum of y with a smaller ratio
    above = x.sum() - np.concatenate([[0], np.cumsum(x)])
    both = np.flatnonzero((x > 0) & (y > 0))
    first = np.searchsorted(ratio, ratio[both])
    return float((1 / (above[first] / x[both] + below[first] / y[both])).sum())


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of plain Jaccard and probability Jaccard."""
    plain = jaccard(one[0], two[0])
    return plain if plain in (0.0, 1.0) else max(plain, probability_jaccard(*one, *two))


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, key (equal for equal sets; null without words), size (of the set), bands."""
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                keys, sizes, found = [], [], []
                for text in part.column(1):
                    elements, weights = weighted_set(text.as_py() or "", k)
                    sizes.append(len(elements))
                    if len(elements):
                        keys.append(hashlib.blake2b(elements.tobytes() + weights.tobytes(), digest_size=16).digest())
                        found.append(bands(signature(elements, weights)))
                    else:
                        keys.append(None)
                        found.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "key", "size", "bands"])

    return frame.mapInArrow(run, "doc_id long, key binary, size long, bands array<bigint>")


def _shared(members: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``members`` (bucket, rep, after) whose bucket has more than one, with popularity.

    A representative's popularity is the sum of its buckets' sizes. In a group
    of copies of one text that aren't all alike, the text itself has most of
    its registers in common with the others and is the most popular.
    """
    rows = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    parts = rows.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("bucket").agg(F.sum("n").alias("size"), F.collect_list("salt").alias("salt")).where("size > 1")
    with Scratch(members.sparkSession) as own:
        sized = own.keep(rows.join(whole.withColumn("salt", F.explode("salt")), ["bucket", "salt"]), "sized")
        popular = sized.groupBy("rep").agg(F.sum("size").alias("popularity"))
        return scratch.keep(sized.join(popular, "rep").select("bucket", "salt", "rep", "after", "popularity"), "shared")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) within buckets, linear in the members: each with the bucket's most popular and with those just before it.

    Members are ordered by the bucket of their next bands, so that those that
    share more of them are neighbours. Buckets are dealt in parts.
    """
    ranked = rows.withColumn("rank", F.struct((-F.col("popularity")).alias("p"), F.xxhash64("rep").alias("r"), F.col("rep").alias("rep")))
    led = first_of_key(ranked.select("bucket", "rep", "rank"), "bucket", "rank", SALTS).select("rep", F.col("first_id.rep").alias("other"))
    order = W.partitionBy("bucket", "salt").orderBy("after", "rank")
    near = ranked.withColumn("others", F.array(*[F.lag("rep", k).over(order) for k in range(1, NEIGHBOURS + 1)])).select("rep", F.explode("others").alias("other"))
    pairs = led.unionByName(near).where("other is not null and other <> rep")
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _cells(shared: DataFrame, sizes: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, class, main, cells) of the members of buckets that have several classes.

    Such buckets are one family where they share members; a family's sets are
    dealt to blocks of ``BLOCK`` shingles. Each member is in the index of one
    cell (family, block), and outside the family's largest class, ``main``, is
    looked up in all of the family's.
    """
    with Scratch(shared.sparkSession) as own:
        known = own.keep(shared.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("class")), "classed")
        several = known.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("rep").alias("a")).where("low <> high").select("bucket", "a")
        mixed = own.keep(known.join(several, "bucket").select("a", F.col("rep").alias("b"), "class").distinct(), "mixed")
        families = components(mixed.select("a", "b"), own)
        members = mixed.select(F.col("b").alias("rep"), "class").distinct().join(families.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep").join(sizes, "rep")
        members = own.keep(members, "members")
        by_class = members.groupBy("family", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        family = by_class.groupBy("family").agg(F.max(F.struct("n", "class"))["class"].alias("main"), F.ceil(F.sum("size") / BLOCK).alias("blocks"))
        block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
        asks = F.when(F.col("class") != F.col("main"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array().cast("array<bigint>"))
        cell = lambda b, asks: F.struct("family", b.alias("block"), F.lit(asks).alias("asks"))
        cells = F.concat(F.array(cell(block, False)), F.transform(asks, lambda b: cell(b, True)))
        return scratch.keep(members.join(family, "family").select("rep", "class", "main", cells.alias("cells")), "cells")


def _sets(cells: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(family, block, asks, rep, class, main, elements, weights): the sets of ``cells`` for each of their cells."""
    joined = cells.hint("merge").join(docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("body")).where("body is not null"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "class", "main", "cells", "elements", "weights"]
        for batch in batches:
            for part in small(batch, 200):
                sets = [weighted_set(t.as_py(), k) for t in part.column(4)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([e.tobytes() for e, _ in sets], pa.binary()), pa.array([w.tobytes() for _, w in sets], pa.binary())], names)

    kinds = "rep long, class long, main long, cells array<struct<family:bigint,block:bigint,asks:boolean>>, elements binary, weights binary"
    found = joined.select("rep", "class", "main", "cells", "body").mapInArrow(run, kinds)
    return found.select(F.inline("cells"), "rep", "class", "main", "elements", "weights")


class Block:
    """Sets and an inverted index of their elements."""

    def __init__(self, reps: list[int], classes: list[int], outside: list[bool], sets: list[tuple[np.ndarray, np.ndarray]]):
        self.reps, self.classes, self.outside, self.sets = np.array(reps, np.int64), np.array(classes, np.int64), np.array(outside, bool), sets
        elements = np.concatenate([e for e, _ in sets])
        self.sizes = np.array([len(e) for e, _ in sets], np.int64)
        self.totals = np.array([w.sum() for _, w in sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        share = np.concatenate([w / t for (_, w), t in zip(sets, self.totals, strict=True)])
        order = np.argsort(elements, kind="stable")
        elements, self.owner, self.share = elements[order], owner[order], share[order]
        first = np.flatnonzero(np.concatenate([[True], elements[1:] != elements[:-1]]))
        self.elements, self.offsets = elements[first], np.append(first, len(elements))
        self.plain = np.array([bool((w == 1).all()) for _, w in sets])

    def links(self, rep: int, own_class: int, one: tuple[np.ndarray, np.ndarray], threshold: float) -> list[tuple[int, float]]:
        """Members of other classes, of those outside the main class only such before ``rep``, with a similarity from ``threshold`` on."""
        elements, weights = one
        at = np.minimum(np.searchsorted(self.elements, elements), len(self.elements) - 1)
        hit = np.flatnonzero(self.elements[at] == elements)
        low, size = self.offsets[at[hit]], np.diff(self.offsets)[at[hit]]
        where = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        owner = self.owner[where]
        both = np.bincount(owner, minlength=len(self.reps))
        # what two distributions have in common bounds their probability Jaccard
        bound = np.bincount(owner, np.minimum(np.repeat(weights[hit] / weights.sum(), size), self.share[where]), len(self.reps))
        plain = both / (len(elements) + self.sizes - both)
        allowed = (self.classes != own_class) & (~self.outside | (self.reps < rep))
        found = [(int(self.reps[i]), float(plain[i])) for i in np.flatnonzero(allowed & (plain >= threshold)).tolist()]
        if not (weights == 1).all():
            rest = allowed & (plain < threshold) & (bound >= threshold)
        else:  # of sets without weights both similarities are the same
            rest = allowed & (plain < threshold) & (bound >= threshold) & ~self.plain
        for i in np.flatnonzero(rest).tolist():
            near = probability_jaccard(*one, *self.sets[i])
            if near >= threshold:
                found.append((int(self.reps[i]), near))
        return found


def _looked_up(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): links between classes, by the cells of ``_sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members, block = None, [], None
        for batch in batches:
            for part in small(batch, 500):
                out = []
                columns = [c.to_pylist() for c in part.columns[:6]]
                for n, (family, number, asks, rep, own, main) in enumerate(zip(*columns, strict=True)):
                    one = np.frombuffer(part.column(6)[n].as_py(), np.uint64), np.frombuffer(part.column(7)[n].as_py(), np.float64)
                    if (family, number) != cell:
                        cell, members, block = (family, number), [], None
                    if not asks:
                        members.append((rep, own, own != main, one))
                        continue
                    if block is None:  # all members come before the first that asks
                        block = Block(*map(list, zip(*members, strict=True)))
                        members = []
                    out += [(min(rep, x), max(rep, x), near) for x, near in block.links(rep, own, one, threshold)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])

    ordered = sets.repartition("family", "block").sortWithinPartitions("family", "block", "asks")
    return ordered.mapInArrow(run, "a long, b long, similarity double")


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts reach ``threshold``, with their similarity."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).where("id is not null and body is not null")
    # pairs grow with the table, so they are never broadcast: one plan at every size
    first = pairs.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("body").alias("text_a")), "a")
    joined = first.hint("merge").join(texts.select(F.col("id").alias("b"), F.col("body").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple] = {}

        def of(text: str) -> tuple:
            if text not in kept:
                if len(kept) > 64 or sum(map(len, kept)) > 1 << 22:
                    kept.clear()
                kept[text] = weighted_set(text, k)
            return kept[text]

        for batch in batches:
            for part in small(batch, 200):
                a, b, s = [], [], []
                for i, j, x, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    one, two = of(x), of(y)
                    # neither similarity can reach the threshold if the sizes are too far apart
                    near = similarity(one, two) if min(len(one[0]), len(two[0])) else 0.0
                    if near >= threshold:
                        a.append(i)
                        b.append(j)
                        s.append(near)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return joined.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, class_id (the smallest id of its class), n_links.

    ``n_links`` counts the verified pairs of the document's representative (of
    equal sets, the smallest id) and 1 more if it is a copy of it. A text that is null or has no word is a class
    of its own, as is a row with a null id (class_id is null). Rows that share
    an id are one document. A text of any length is taken whole, its shingles
    in memory. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        sketches = scratch.keep(sketch(docs, id_col, text_col, k), "sketches")
        known = sketches.where("key is not null and doc_id is not null")
        reps = known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("size").alias("size"))
        reps = scratch.keep(reps.select("rep", "size", "bands"), "reps")
        after = lambda x, i: F.struct(x.alias("bucket"), F.array(*[F.element_at("bands", F.pmod(i + k, F.lit(BANDS)) + 1) for k in (1, 2)]).alias("after"))
        shared = _shared(reps.select("rep", F.inline(F.transform("bands", after))), scratch)
        tried = scratch.keep(_pairs(shared), "pairs")
        links = scratch.keep(verify(tried, docs, id_col, text_col, k, threshold), "links")
        classes = components(links, scratch)
        cells = _cells(shared, reps.select("rep", "size"), classes, scratch)
        if not cells.isEmpty():
            more = scratch.keep(_looked_up(_sets(cells, docs, id_col, text_col, k), threshold), "links")
            if not more.isEmpty():
                links = links.unionByName(more)
                classes = components(links, scratch)
        degree = links.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        found = scratch.keep(classes.join(degree, "node", "left").select(F.col("node").alias("first_id"), "component", "degree"), "classes")
        linked = first_of_key(known.select("doc_id", "key"), "key", "doc_id", extra=found)
        copied = (F.col("doc_id") != F.col("first_id")).cast("long")
        done = linked.select(F.col("doc_id").alias(id_col), F.coalesce("component", "first_id").alias("class_id"), (F.coalesce("degree", F.lit(0)) + copied).alias("n_links"))
        alone = sketches.where("key is null or doc_id is null").select(F.col("doc_id").alias(id_col), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
        return materialize(done.unionByName(alone), "near")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; of rows that repeat this id one of the least text.

    Rows with a null id stay, as do null texts and those without a word. An
    empty table stays empty. Other columns go along, whatever their names.
    """
    own = unused(docs, "listed")
    classes = near_duplicates(docs, id_col, text_col, k, threshold).select(F.col(id_col).alias(own), "class_id").where(F.col(own).isNotNull())
    # ids that go, and those that more than one row has
    listed = classes.groupBy(own).agg(F.max(F.col(own) != F.col("class_id")).alias("gone"), F.count(F.lit(1)).alias("n")).where("gone or n > 1")
    listed = materialize(listed.select(own, "gone"), "listed")
    same = docs[id_col].cast("long") == listed[own]
    alone = docs.join(listed.hint("merge"), same, "left_anti")
    repeated = listed.where("not gone")
    if repeated.isEmpty():
        return alone
    # a row number beside the whole row, so that no name can clash
    rows = docs.join(repeated, same, "left_semi").select(F.struct("*").alias("row"))
    order = W.partitionBy(F.col("row")[id_col]).orderBy(F.col("row")[text_col])
    return alone.unionByName(rows.withColumn("number", F.row_number().over(order)).where("number = 1").select("row.*"))
