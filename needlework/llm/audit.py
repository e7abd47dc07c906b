"""How filters interact: every order of them, visited by single swaps of neighbours.

Documents are read once, for a mask of the filters that they fail. All that an
order says of a step follows from the counts of the masks (the cells), and
swapping two neighbours changes these two steps alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, first_of_key, materialize, text_or_empty

LETTERS = "ABCDE"
#: What ``audit_filters`` counts for each cell.
COUNTS = ["n", "good", "toxic"]
_STEPS = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def swaps(n: int) -> Iterator[int]:
    """Places k whose swaps with k + 1, one after the other, visit all orders of ``n`` things once, from the identity.

    The last thing walks through an order of the others, which then takes its
    own next swap, and walks back.
    """
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        k = next(inner, None)
        if k is None:
            return
        yield k + 1 if down else k  # the walker stands ahead of all others, or behind them
        down = not down


def lost_table(cells: dict[int, list[int]], n: int) -> list[list[list[int]]]:
    """By filter and set of filters before it: what it removes, a number for each count of the cells."""
    width = len(next(iter(cells.values()), []))
    table = []
    for f in range(n):
        own = [[0] * width for _ in range(1 << n)]
        for mask, counts in cells.items():
            if mask >> f & 1:
                for before in range(1 << n):
                    if not mask & before:
                        own[before] = [a + b for a, b in zip(own[before], counts, strict=True)]
        table.append(own)
    return table


def walk(cells: dict[int, list[int]], letters: str = LETTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    ``cells``: by failure mask the counts n, good, toxic. Shapley values add up
    along the walk: a filter's removals by one order, then only what a swap
    changed of them, times the orders that keep it.
    """
    n = len(letters)
    table = lost_table(cells, n)
    total = sum(c[0] for c in cells.values())
    fails = [table[f][0][0] for f in range(n)]
    alone = [cells.get(1 << f, [0])[0] for f in range(n)]
    order = list(range(n))
    steps: list[list] = [[]] * n
    shapley, since = [0] * n, [0] * n
    kept = [total] * (n + 1)

    def place(k: int, before: int) -> None:
        f = order[k]
        lost = table[f][before]
        kept[k + 1] = kept[k] - lost[0]
        steps[k] = [kept[k + 1], lost[0], fails[f] - lost[0], alone[f], lost[1], lost[2]]

    before = 0
    for k in range(n):
        place(k, before)
        before |= 1 << order[k]
    rows, visited = [], 0

    def visit() -> None:
        name = "".join(letters[f] for f in order)
        rows.extend((name, k + 1, *steps[k], order[k]) for k in range(n))

    visit()
    visited = 1
    for k in swaps(n):
        for f, step in ((order[k], steps[k]), (order[k + 1], steps[k + 1])):
            shapley[f] += step[1] * (visited - since[f])
            since[f] = visited
        order[k], order[k + 1] = order[k + 1], order[k]
        before = sum(1 << f for f in order[:k])
        place(k, before)
        place(k + 1, before | 1 << order[k])
        visit()
        visited += 1
    for k in range(n):
        shapley[order[k]] += steps[k][1] * (visited - since[order[k]])
    return [(*row[:-1], shapley[row[-1]]) for row in rows]


def text_failures(text: Column) -> list[Column]:
    """A: under 100 words, B: words that differ under 80 %, C: more than 10 % capitals, D: signs of markup.

    A word is a longest run of what is no ASCII white space.
    """
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [n < 100, different.cast("long") * 100 < n.cast("long") * 80, capitals.cast("long") * 100 > F.length(text).cast("long") * 10, F.regexp_like(text, F.lit("[#$%&*|]"))]


def failure_cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters that they fail, bit k for the k-th letter.

    E, the fifth, fails where a smaller identifier has the same text. Texts are
    told apart by SHA-256; of a text with many copies the smallest identifier
    is found in parts. Words are shuffled nowhere: a row of a hash, an
    identifier and a mask is.
    """
    spark = docs.sparkSession
    text = text_or_empty(docs[text_col].cast("string"))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(F.col("body")))), F.lit(0))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("body"))
    flags = labels.groupBy(labels[id_col].alias("id")).agg(*[F.max(F.coalesce(labels[c] == 1, F.lit(False))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    with Scratch(spark) as own:
        slim = own.keep(rows.select("id", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("hash"), mask.cast("int").alias("mask")), "masks")
        repeated = first_of_key(slim, "hash", "id")
        repeated = repeated.select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("first_id"), 16).otherwise(0)).alias("mask"))
        labelled = repeated.join(flags, "id", "left")
        one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(c)
        return materialize(labelled.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("good"), one("toxic")), "cells")


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each part, order of the five filters and step, with what the step keeps and removes; see ``walk``.

    A null text counts as empty, a null part as an empty string. A text of any
    length is judged whole. Rows that repeat are documents of their own: of
    equal texts all with a larger identifier than the smallest fail E, so rows
    that share the smallest don't. A null identifier is neither smaller nor
    larger than another and has no label. Several labels of a document count
    once, if any of them says so. An empty table has no part, so no row. Other
    columns, whatever their names, are ignored.
    """
    cells = failure_cells(docs, labels, part_col, id_col, text_col)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        found = walk({m: list(c) for m, *c in zip(rows["mask"], *(rows[c] for c in COUNTS), strict=True)})
        names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        columns = [pa.array([r[k] for r in found], pa.string() if k == 0 else pa.int32() if k == 1 else pa.int64()) for k in range(len(names))]
        return pa.table([pa.array([rows["part"][0]] * len(found), pa.string()), *columns], names=["part", *names])

    return cells.groupBy("part").applyInArrow(run, "part string, " + _STEPS)
