"""Bounded-space online packing of token runs into windows of fixed size.

Every partition keeps a fixed number of open windows. A run goes to the window
that it fills best; when it fits none, the fullest is emitted and a new one
opened. What is open at the end of the partitions is merged in rounds that each
take a bounded number of windows into one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .bpe import small
from .common import materialize

#: Open windows that one task of a merging round takes.
FAN_IN = 8192


class Packer:
    """Best-fit over at most ``slots`` open windows of ``capacity`` tokens.

    Windows are numbered from 0 in the order of opening. A run that fits no
    open window, when no more may be opened, is cut: its head fills the fullest,
    which is emitted, if that takes ``least`` tokens or more; else the fullest
    is emitted as it is.
    """

    def __init__(self, capacity: int, slots: int, least: int = 32):
        self.capacity, self.slots, self.least = capacity, slots, least
        self.open: list[tuple[int, int]] = []  # (free, window), ascending
        self.opened = 0

    def _new(self) -> int:
        self.opened += 1
        return self.opened - 1

    def place(self, length: int) -> list[tuple[int, int, int]]:
        """(window, offset, length) of the run's pieces, in order."""
        if length < 1:
            raise ValueError(f"a run of {length} tokens")
        out = []
        while length >= self.capacity:
            out.append((self._new(), 0, self.capacity))
            length -= self.capacity
        while length:
            k = bisect_left(self.open, (length, -1))
            if k < len(self.open):
                free, window = self.open.pop(k)
            elif len(self.open) < self.slots:
                free, window = self.capacity, self._new()
            else:
                free, window = self.open.pop(0)
                if free >= self.least:
                    out.append((window, self.capacity - free, free))
                    length -= free
                continue
            out.append((window, self.capacity - free, length))
            if free > length:
                insort(self.open, (free - length, window))
            length = 0
        return out

    def leftovers(self) -> dict[int, int]:
        """Tokens by open window."""
        return {w: self.capacity - free for free, w in self.open}


#: Letters of ASCII and Latin-1 are 1, other ASCII but white space 2.
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[0x21:0x7F] = 2
_CLASSES[[*range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = 1
_CLASSES[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = 2
#: What the tokenizer joins across classes, or reads otherwise in lower case.
_ODD = (b"'", b"<|", b"\xc3\x97", b"\xc3\xb7")
_NOT_LATIN = re.compile(rb"[\xc2\xc4-\xff]")


class TokenTable:
    """Ids of texts by ``tokenizers``, through a hash table of pieces that came before.

    Text of ASCII and Latin-1 letters is cut into runs of letters and runs of
    other characters without white space; the tokenizer cuts there too. A run's
    ids come from an open-addressing table over 64-bit hashes, and only runs
    that it lacks go to the tokenizer. Other texts go there whole. Beyond
    ``keep`` runs, those that the last batch lacks are forgotten.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self.slots = 1 << (2 * keep + (1 << 17)).bit_length()
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.values = np.full(self.slots, -1, np.int32)
        self.count, self.used = 0, 0
        self.where = np.zeros((1 << 16, 2), np.int64)  # start and length in the blob
        self.blob = np.zeros(1 << 18, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's run, or -1."""
        found = np.full(len(h), -1, np.int64)
        todo, at = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            value, hit = self.values[at], self.keys[at] == h[todo]
            found[todo[hit]] = value[hit]
            on = ~hit & (value >= 0)
            todo, at = todo[on], (at[on] + 1) & (self.slots - 1)
        return found

    def _add(self, h: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Different hashes that aren't in the table, with their ids end to end."""
        n, size = len(h), len(ids)
        while self.count + n > len(self.where):
            self.where = np.concatenate([self.where, np.zeros_like(self.where)])
        while self.used + size > len(self.blob):
            self.blob = np.concatenate([self.blob, np.zeros_like(self.blob)])
        self.blob[self.used : self.used + size] = ids
        self.where[self.count : self.count + n, 0] = self.used + np.cumsum(lengths) - lengths
        self.where[self.count : self.count + n, 1] = lengths
        todo, at = np.arange(n), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.values[at] < 0
            self.values[at[free]] = todo[free] + self.count
            won = self.values[at] == todo + self.count
            self.keys[at[won]] = h[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (self.slots - 1)
        self.count += n
        self.used += size

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each has."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        words = [k for k, p in enumerate(pieces) if p.isalpha()]
        groups = [words[k : k + 50] for k in range(0, len(words), 50)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join([pieces[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):  # a word each, since none has fewer than one
                a = 0
                for k, b in zip(group, ends.tolist(), strict=True):
                    out[k], a = ids[a:b], b
        rest = [k for k, x in enumerate(out) if x is None]
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(found.ids, np.uint32)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def texts(self, texts: list[str], budget: int = 1_000_000) -> Iterator[np.ndarray]:
        """Ids (unsigned, 32 bit) of every text; ``budget`` bytes at a time, about."""
        held: list[bytes | str] = []
        size = 0
        for text in texts:
            raw = text.lower().encode("utf-8", "surrogatepass")
            plain = len(raw) < 8 * budget and not _NOT_LATIN.search(raw) and not any(o in raw for o in _ODD)
            held.append(raw if plain else text)
            size += len(raw)
            if size >= budget:
                yield from self._batch(held)
                held, size = [], 0
        yield from self._batch(held)

    def _batch(self, held: list[bytes | str]) -> Iterator[np.ndarray]:
        raws = [r for r in held if isinstance(r, bytes)]
        x = np.frombuffer(b"\n".join(raws), np.uint8)
        starts, ends, _ = words.segments(x, _CLASSES)
        h = words.hashes(x, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        found = self._find(h)
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            new, first = np.unique(h[lacking], return_index=True)
            at = lacking[first]
            pieces = [x[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._add(new, *self._encode(pieces))
            found[lacking] = self._find(h[lacking])
        lengths = self.where[found, 1]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(self.where[found, 0] - sums[:-1], lengths) + np.arange(sums[-1])
        ids = self.blob[take]
        begins = np.cumsum([0, *[len(r) + 1 for r in raws]])
        bounds = sums[np.searchsorted(starts, begins)]
        if self.count > self.keep:
            last, first = np.unique(found, return_index=True)
            kept = [self.blob[a : a + n] for a, n in self.where[last].tolist()]
            size = self.where[last, 1].copy()
            self._reset()
            self._add(h[first], np.concatenate(kept), size)
        k = 0
        for r in held:
            if isinstance(r, bytes):
                yield ids[bounds[k] : bounds[k + 1]]
                k += 1
            else:
                yield np.array(self.tokenizer.encode_batch_fast([r], add_special_tokens=False)[0].ids, np.uint32)


_tokens: dict[str, TokenTable] = {}


def ids_payload(ids: bytes) -> dict:
    return {"ids": ids}


def crc_payload(ids: bytes) -> dict:
    return {"ids_crc32": zlib.crc32(ids)}


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = 2048,
    slots: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
    payload: Callable[[bytes], dict] = ids_payload,
    payload_type: str = "ids binary",
) -> DataFrame:
    """One row per piece of a document, placed in a sequence of ``capacity`` tokens.

    Columns: ``id_col``, start, length, the payload's, doc_tokens, sequence_id,
    offset. A document is its ids and ``end_id``; those longer than a window
    are cut into whole windows and a rest, and a rest that fits nowhere fills
    the fullest window first. ``payload`` makes a piece's
    further columns from its ids (unsigned 32-bit, little-endian): by default
    the ids themselves.

    A null text counts as empty, so such a document is ``end_id`` alone. Ids may
    be null or repeat: each row is packed as a document of its own. An empty
    table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(docs[id_col].alias("row_id"), docs[text_col].cast("string").alias("body"))
    names = [c.split()[0] for c in payload_type.split(",")]
    schema = f"`{id_col}` {kind}, start bigint, length bigint, {payload_type}, doc_tokens bigint, part bigint, window bigint, offset bigint, left bigint"
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokens:
            _tokens[tokenizer_path] = TokenTable(tokenizer_path)
        tokens, packer, part = _tokens[tokenizer_path], Packer(capacity, slots), TaskContext.get().partitionId()
        waiting: dict[int, list[dict]] = {}  # the pieces of the windows that are open

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=fields), schema=shape, preserve_index=False)

        shape = None
        fields = [id_col, "start", "length", *names, "doc_tokens", "part", "window", "offset", "left"]
        for batch in batches:
            for some in small(batch):
                if shape is None:
                    plain = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
                    extra = [plain[c.split()[1]] for c in payload_type.split(",")]
                    shape = pa.schema([(id_col, some.schema.field(0).type), *zip(fields[1:], [pa.int64()] * 2 + extra + [pa.int64()] * 5, strict=True)])
                rows: list[dict] = []
                for doc, ids in zip(some.column(0).to_pylist(), tokens.texts([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids = ids.astype("<u4").tobytes() + tail
                    n, start = len(ids) // 4, 0
                    for window, offset, length in packer.place(n):
                        piece = {id_col: doc, "start": start, "length": length, **payload(ids[4 * start : 4 * (start + length)]), "doc_tokens": n, "part": part, "window": window, "offset": offset, "left": 0}
                        waiting.setdefault(window, []).append(piece)
                        start += length
                still = packer.leftovers()
                for window in [w for w in waiting if w not in still]:
                    rows += waiting.pop(window)
                if rows:
                    yield out(rows)
        fill = packer.leftovers()
        if rows := [piece | {"left": fill[w]} for w, pieces in waiting.items() for piece in pieces]:
            yield out(rows)

    pieces = materialize(frame.mapInArrow(run, schema), "packed")
    done = pieces.where("left = 0").withColumn("sequence_id", _sequence(F.lit(0), "part", "window"))
    open_ = pieces.where("left > 0").select("part", "window", F.col("offset").alias("place"), "length")
    where = merge_leftovers(open_, capacity)
    open_pieces = pieces.where("left > 0").withColumnRenamed("offset", "place")
    merged = open_pieces.join(where, ["part", "window", "place"]).withColumnRenamed("base", "offset")
    columns = [F.col(f"`{id_col}`"), "start", "length", *names, "doc_tokens", "sequence_id", "offset"]
    return done.select(*columns).unionByName(merged.select(*columns))


def _sequence(level, part, window):
    """Numbers that no two windows of any level share."""
    return level * F.lit(1 << 58) + F.col(part) * F.lit(1 << 32) + F.col(window)


def merge_leftovers(pieces: DataFrame, capacity: int, fan_in: int | None = None) -> DataFrame:
    """(part, window, place, sequence_id, base) for all pieces of open windows (part, window, place, length).

    A task of a round takes about ``fan_in`` of them at most, the longest first,
    and packs them best-fit into windows; the next round does so with these.
    Rounds go on while more than one task is needed and the number of windows
    falls.
    """
    fan_in = fan_in or FAN_IN
    unit = F.col("window") * F.lit(capacity) + F.col("place")
    found = materialize(pieces.withColumns({"base": F.lit(0).cast("long"), "to_part": F.col("part"), "to_window": unit, "level": F.lit(1).cast("long")}), "leftovers")
    tops = found.select("to_part", "to_window", F.col("length").alias("left"))
    n, level = tops.count(), 1
    while n > 1:
        level += 1
        groups = -(-n // fan_in)
        schema = "to_part bigint, to_window bigint, base bigint, new_part bigint, new_window bigint, left bigint"

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            packer = Packer(capacity, len(pdf))
            pdf = pdf.sort_values(["left", "to_part", "to_window"], ascending=[False, True, True])
            placed = [packer.place(int(n))[0] for n in pdf["left"]]
            total: dict[int, int] = {}
            for w, _, n in placed:
                total[w] = total.get(w, 0) + n
            return pdf[["to_part", "to_window"]].assign(base=[o for _, o, _ in placed], new_part=int(key[0]), new_window=[w for w, _, _ in placed], left=[total[w] for w, _, _ in placed])

        moved = materialize(tops.groupBy(F.pmod(F.xxhash64("to_part", "to_window"), F.lit(groups)).alias("g")).applyInPandas(run, schema), "merged")
        step = moved.select("to_part", "to_window", F.col("base").alias("more"), "new_part", "new_window")
        found = materialize(
            found.join(step, ["to_part", "to_window"]).select("part", "window", "place", (F.col("base") + F.col("more")).alias("base"), F.col("new_part").alias("to_part"), F.col("new_window").alias("to_window"), F.lit(level).cast("long").alias("level")),
            "leftovers",
        )
        tops = moved.select(F.col("new_part").alias("to_part"), F.col("new_window").alias("to_window"), "left").distinct()
        if groups == 1:
            break
        fewer = tops.count()
        if fewer >= n * 0.95:
            break
        n = fewer
    return found.select("part", "window", "place", "base", _sequence(F.col("level"), "to_part", "to_window").alias("sequence_id"))
