"""Token counts of whole texts by a byte-level BPE of the tokenizers library.

Texts are cut where the tokenizer always starts a new token, whatever is
around; each different piece goes once to the library's batch encoding, in
batches of about equal bytes, of whose result only lengths are kept.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Bytes of a batch for the library.
BATCH = 1 << 18
#: Characters of a text that are cut at once, about.
SLICE = 1 << 20
#: Pieces from this length on are cut further, inside of what is no white space.
LONG = 1 << 12
#: Pieces whose counts a worker remembers.
KEEP = 1 << 19

_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space to the tokenizer or to Python, but not what bounds pieces.
_ODD = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
#: A place after a character that is surely not white space, before one that surely is.
_GAP = re.compile(r"(?<=[!-~])(?=[ \t\n\r])")
#: Inside of what is no white space: a letter ends its token before a digit, and before these signs, which no special token has.
_INNER = re.compile(r"(?<=[A-Za-z])(?=[0-9.,;:!?/=+_-])")
#: Either of these.
_CUT = re.compile(f"{_GAP.pattern}|{_INNER.pattern}")
_SIZE = 100  # of a piece beyond its characters, in a batch


def safe_pieces(text: str) -> list[str]:
    """``text`` in pieces at whose bounds the tokenizer starts a new token whatever is around them.

    The expression that splits texts has no alternative in which white space
    follows anything else, and looks ahead only to tell whether white space
    goes on. So white space after another character always starts a token.
    """
    pieces = _PIECE.findall(text) if not _ODD.search(text) else [p for p in _GAP.split(text) if p]
    if any(len(p) >= LONG for p in pieces):
        pieces = [q for p in pieces for q in ([p] if len(p) < LONG else _INNER.split(p))]
    return pieces


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A long text in slices, cut where ``safe_pieces`` would; one without such a place is whole."""
    at = 0
    while len(text) - at > size:
        gap = _CUT.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def balanced(pieces: Iterable[str], limit: int = BATCH) -> Iterator[list[str]]:
    """``pieces`` by size in batches of about ``limit`` bytes, so that none waits for a long one; a longer piece is alone."""
    batch, size = [], 0
    for piece in sorted(pieces, key=len):
        own = len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
        if batch and size + own > limit:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += own + _SIZE
    if batch:
        yield batch


class Counter:
    """The library's tokenizer with a bounded memory of pieces that came before."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        check(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep, self.known = keep, {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > self.keep:
            self.known = {}
        for batch in balanced(p for p in pieces if p not in self.known):
            found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            self.known.update(zip(batch, map(len, found), strict=True))

    def counts(self, texts: list[str], budget: int = SLICE) -> list[int]:
        """Tokens of every text; about ``budget`` characters are in work at a time."""
        out, held, size = [0] * len(texts), [], 0

        def settle() -> None:
            self.learn({p for _, pieces in held for p in pieces})
            for k, pieces in held:
                out[k] += sum(map(self.known.__getitem__, pieces))
            held.clear()

        for k, text in enumerate(texts):
            for part in slices(text):
                held.append((k, safe_pieces(part)))
                size += len(part)
                if size >= budget:
                    settle()
                    size = 0
        settle()
        return out


def check(path: str) -> None:
    """An error unless the file is a byte-level BPE whose settings allow ``safe_pieces``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    special = spec.get("added_tokens", [])
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not a byte-level BPE without normalizer and prefix space")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"[\s0-9.,;:!?/=+_-]", t["content"]) for t in special):
        raise ValueError("a special token takes in what is around it, or holds a place where texts are cut")


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs``.

    Counts are those of the library for whole texts, without tokens that it
    would add; special tokens inside texts are found as it does by default. A
    null text counts as empty. A text of any length is counted whole, a slice
    at a time; only a run of one kind of character without any safe place goes
    to the library in one piece. Rows are independent of each other, so they
    may repeat and identifiers may be null; an empty table gives an empty
    result. Nothing is shuffled. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    body = text_or_empty(docs[text_col].cast("string"))
    frame = docs.select(docs[id_col].alias("row_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                counts = own.counts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return frame.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
