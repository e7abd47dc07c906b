"""Document fingerprints: quartile digests of hashed byte triplets.

The byte triplets of a text are counted in hashed buckets; a bucket's two bits
say in which quartile of the counts it lies, and a byte holds the logarithm of
the length. Two digests differ by a score between 0 and 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import small
from .common import materialize

BUCKETS = 512
#: Bytes that are counted at once.
PIECE = 1 << 20
_BODY, _LENGTH = 0.9, 0.1
#: Runs of documents that one task links at last.
RUNS = 4096


def triplet_counts(raw: bytes) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for k in range(0, max(1, len(raw) - 2), PIECE):
        x = np.frombuffer(raw[k : k + PIECE + 2], np.uint8).astype(np.uint32)
        if len(x) < 3:
            break
        h = x[:-2] * np.uint32(0x9E3779B1) ^ (x[1:-1] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) + x[2:] * np.uint32(0x165667B1)
        h = ((h ^ (h >> np.uint32(13))) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        total += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return total


def digest(text: str) -> bytes:
    """A length byte, then two bits a bucket."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = triplet_counts(raw)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    four = quartile.reshape(-1, 4).astype(np.uint8)
    body = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    return bytes([min(255, int(math.log1p(len(raw)) / math.log(1.1)))]) + body.astype(np.uint8).tobytes()


_steps = np.array([(0, 1, 2, 6)[abs(a - b)] for a in range(4) for b in range(4)], np.int64).reshape(4, 4)
#: Difference of the four buckets in each pair of bytes.
_TABLE = sum(_steps[np.arange(256)[:, None] >> s & 3, np.arange(256)[None, :] >> s & 3] for s in (6, 4, 2, 0)).astype(np.int16)


#: Buckets of each quartile in each byte.
_QUARTILES = np.array([[[x >> s & 3 for s in (6, 4, 2, 0)].count(q) for q in range(4)] for x in range(256)])


def difference(a: bytes, b: bytes) -> float:
    """0 for equal digests, 1 for such as differ as much as chance has it, or more.

    Chance is that of digests whose buckets lie in the four quartiles as often
    as those of ``a`` and ``b``: a short text has few buckets, and the many that
    are empty in both say nothing.
    """
    x, y = np.frombuffer(a, np.uint8, offset=1), np.frombuffer(b, np.uint8, offset=1)
    chance = _QUARTILES[x].sum(0) @ _steps @ _QUARTILES[y].sum(0) / BUCKETS
    body = _TABLE[x, y].sum() / chance if chance else 0.0
    length = abs(a[0] - b[0]) / 32
    return _BODY * min(1.0, float(body)) + _LENGTH * min(1.0, length)


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following`` (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = ["n_chars bigint", "edited_sha256 string", "fingerprint binary", "edited_fingerprint binary", "near_edited double", "near_next double"]
_RUN = ["first_text string", "last_text string"]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's digest and that of its text edited with the next document's.

    Columns: ``id_col``, n_chars, edited_sha256, fingerprint and
    edited_fingerprint (hex), near_edited, near_next. The next document is that
    in ascending ``id_col`` (nulls first, ties by text), after the last the
    first; a single document is its own next. A null text is empty. A text of
    any length is taken whole; those of less than three bytes have no triplet
    and share one digest. Rows that repeat are documents of their own. An empty
    table gives an empty result; other columns are ignored.

    The texts are shuffled once, by ranges of the id. A task streams its sorted
    range and needs one more text than it has, so ranges are linked in rounds
    over their first and last texts, of which there are two a range.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"first_id {kind}, id {kind}, " + ", ".join(_RESULT + _RUN)
    plain = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    names = ["first_id", "id", *[c.split()[0] for c in _RESULT + _RUN]]

    def link(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        """Rows of (first_id, id, first_text, last_text) in order: results between runs, and one run of all."""
        first = held = None
        types = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

        def result(one: tuple, then: tuple) -> tuple:
            key, text, own = one
            other = edited(text, then[0])
            changed = digest(other)
            sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
            return None, key, len(text), sha, own, changed, likeness(own, changed), likeness(own, then[1]), None, None

        for batch in batches:
            types = types or [batch.schema.field(0).type] * 2 + [plain[c.split()[1]] for c in _RESULT + _RUN]
            for part in small(batch, 500):
                rows = []
                for first_id, key, first_text, last_text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    start = (first_text, digest(first_text))
                    if held is None:
                        first = (first_id, *start)
                    else:
                        rows.append(result(held, start))
                    held = (key, first_text, start[1]) if last_text is None else (key, last_text, digest(last_text))
                if rows:
                    yield out(rows)
        if held is not None:
            if last:
                yield out([result(held, first[1:])])
            else:
                yield out([(first[0], held[0], *[None] * len(_RESULT), first[1], held[1])])

    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("first_id"), F.col(id_col).alias("id"), body.alias("first_text"), F.lit(None).cast("string").alias("last_text"))
    rows = rows.repartitionByRange("first_id").sortWithinPartitions("first_id", "first_text")
    done = []
    while True:
        level = materialize(rows.mapInArrow(lambda it: link(it, False), schema), "digests")
        done.append(level.where("first_text is null"))
        runs = level.where("first_text is not null").select("first_id", "id", "first_text", "last_text")
        n = runs.count()
        if n <= RUNS:
            done.append(runs.coalesce(1).sortWithinPartitions("first_id").mapInArrow(lambda it: link(it, True), schema))
            break
        rows = runs.repartitionByRange(n // 1024, "first_id").sortWithinPartitions("first_id")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
