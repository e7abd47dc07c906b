"""Byte-pair encoding with a segment tree over adjacent pair ranks.

Every symbol of a pre-token is a leaf that holds ``rank * width + position`` of
the pair it starts (or infinity). The root is then the leftmost pair of lowest
rank. A merge changes three leaves (the merged symbol, its left neighbour and
the symbol that vanished), so it costs a logarithmic number of node updates.
Encoding ends when the root is infinite.

``SegmentTree`` does that for one long pre-token; ``merge_many`` runs the same
trees for many short pre-tokens at once, one merge of each per round.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

INF = np.iinfo(np.int64).max
#: Pre-tokens of up to so many symbols are merged many at once.
SHORT = 64
#: White space of the tokenizer's ``\s``; Python's ``str.split`` adds 1C to 1F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_STOPS = re.compile(r"(?<=[a-z])([.,])(?=\s)")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies use it."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class SegmentTree:
    """Min tree over the leaves of one pre-token."""

    def __init__(self, keys: list[int]):
        self.width = 1 << max(1, (len(keys) - 1).bit_length())
        self.nodes = [INF] * (2 * self.width)
        self.nodes[self.width : self.width + len(keys)] = keys
        for k in range(self.width - 1, 0, -1):
            self.nodes[k] = min(self.nodes[2 * k], self.nodes[2 * k + 1])

    def root(self) -> int:
        return self.nodes[1]

    def put(self, leaf: int, key: int) -> None:
        nodes, k = self.nodes, leaf + self.width
        nodes[k] = key
        while k > 1:
            k >>= 1
            least = min(nodes[2 * k], nodes[2 * k + 1])
            if nodes[k] == least:
                break
            nodes[k] = least


#: What this encoder does; a file that asks for anything else would get wrong ids.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def check_settings(spec: dict) -> None:
    """An error for a tokenizer file whose settings this encoder doesn't follow."""
    model, splits = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    wrong = {
        "normalizer": (spec.get("normalizer") or {}).get("normalizers") != _NORMALIZERS,
        "pre_tokenizer": len(splits) != 2 or splits[0].get("type") != "Split" or splits[0].get("behavior") != "Removed" or not splits[0].get("invert") or any(splits[1].get(k) != v for k, v in _BYTES.items()),
        "decoder": spec.get("decoder") is not None,
        "post_processor": spec.get("post_processor") is not None,
        "model": model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk")),
        "added_tokens": any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")) or any("<|" not in x["content"] for x in spec.get("added_tokens", [])),
    }
    if any(wrong.values()):
        raise ValueError(f"this encoder doesn't follow the file's settings of {', '.join(k for k, v in wrong.items() if v)}")


class Vocabulary:
    """What the encoder needs of a ``tokenizers`` JSON file with BPE and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        check_settings(spec)
        ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens: dict[int, str] = {i: t for t, i in ids.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        alphabet = byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int64)
        self.last = np.array([ids[c + self.suffix] for c in alphabet], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in reversed(list(enumerate(merges)))}
        keys = np.array([(a << 20) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = np.array([r for r, _ in self.pairs.values()], np.int64)[order]
        self.pair_id = np.array([i for _, i in self.pairs.values()], np.int64)[order]
        self.by_rank = np.empty(len(merges), np.int64)
        for r, i in self.pairs.values():
            self.by_rank[r] = i

    # -- merging ---------------------------------------------------------
    def symbols(self, token: str) -> np.ndarray:
        raw = np.frombuffer(token.encode("utf-8"), np.uint8)
        out = self.inner[raw]
        out[-1] = self.last[raw[-1]]
        return out

    def merge_one(self, symbols: list[int]) -> list[int]:
        """Ids of one pre-token, by its own segment tree."""
        n = len(symbols)
        if n < 2:
            return list(symbols)
        symbols, width = list(symbols), 1 << max(1, (n - 1).bit_length())
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pairs = self.pairs

        def key(i: int) -> int:
            j = after[i]
            found = pairs.get((symbols[i], symbols[j])) if j >= 0 else None
            return found[0] * width + i if found else INF

        tree = SegmentTree([key(i) for i in range(n)])
        while (least := tree.root()) != INF:
            i = least % width
            j = after[i]
            symbols[i], k = pairs[symbols[i], symbols[j]][1], after[j]
            after[i], symbols[j] = k, -1
            if k >= 0:
                before[k] = i
            tree.put(j, INF)
            tree.put(i, key(i))
            if before[i] >= 0:
                tree.put(before[i], key(before[i]))
        return [s for s in symbols if s >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_rank[at], -1)

    def merge_many(self, words: list[np.ndarray], width: int) -> list[np.ndarray]:
        """Ids of many pre-tokens of 2 to ``width`` symbols (a power of two)."""
        rows = len(words)
        length = np.fromiter(map(len, words), np.int64, rows)
        column = np.arange(width)
        inside = column < length[:, None]
        symbols = np.full((rows, width + 1), -1, np.int64)
        symbols[:, :width][inside] = np.concatenate(words)
        after = np.where(column + 1 < length[:, None], column + 1, width)
        after = np.concatenate([after, np.full((rows, 1), width)], 1)
        before = np.tile(np.arange(-1, width), (rows, 1))
        nodes = np.full((rows, 2 * width), INF, np.int64)
        rank = self._ranks(symbols[:, :width], symbols[:, 1:])
        nodes[:, width:] = np.where(rank >= 0, rank * width + column, INF)
        k = width
        while k > 1:
            nodes[:, k // 2 : k] = np.minimum(nodes[:, k : 2 * k : 2], nodes[:, k + 1 : 2 * k : 2])
            k //= 2
        live = np.flatnonzero(nodes[:, 1] != INF)
        while len(live):
            least = nodes[live, 1]
            i, merged = least % width, self.by_rank[least // width]
            j = after[live, i]
            k = after[live, j]
            symbols[live, i] = merged
            symbols[live, j] = -1
            after[live, i] = k
            before[live, k] = i
            self._put(nodes, live, j, np.full(len(live), INF), width)
            rank = self._ranks(merged, symbols[live, k])
            self._put(nodes, live, i, np.where(rank >= 0, rank * width + i, INF), width)
            h = before[live, i]
            has = h >= 0
            rows_h, h = live[has], h[has]
            rank = self._ranks(symbols[rows_h, h], merged[has])
            self._put(nodes, rows_h, h, np.where(rank >= 0, rank * width + h, INF), width)
            live = live[nodes[live, 1] != INF]
        kept = symbols[:, :width] >= 0
        return np.split(symbols[:, :width][kept], np.cumsum(kept.sum(1))[:-1])

    @staticmethod
    def _put(nodes: np.ndarray, rows: np.ndarray, leaf: np.ndarray, key: np.ndarray, width: int) -> None:
        k = leaf + width
        nodes[rows, k] = key
        while width > 1:
            k = k >> 1
            nodes[rows, k] = np.minimum(nodes[rows, 2 * k], nodes[rows, 2 * k + 1])
            width >>= 1

    # -- text ------------------------------------------------------------
    def pretokens(self, chunk: str) -> list[str]:
        chunk = unicodedata.normalize("NFC", chunk)
        # letter by letter: the final sigma has no rule of its own here
        chunk = chunk.lower() if "Σ" not in chunk else "".join(c.lower() for c in chunk)
        return self.pattern.findall(chunk)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks of text that white space bounds."""
        parts: list[list[int | str]] = []
        for chunk in chunks:
            if self.special_split and "<" in chunk:
                out: list[int | str] = []
                for piece in self.special_split.split(chunk):
                    if piece in self.special:
                        out.append(self.special[piece])
                    elif piece:
                        out += self.pretokens(piece)
                parts.append(out)
            else:
                parts.append(self.pretokens(chunk))
        known: dict[str, list[int]] = {}
        by_width: dict[int, list[str]] = {}
        for token in dict.fromkeys(p for part in parts for p in part if isinstance(p, str)):
            n = len(token.encode("utf-8"))
            if n == 1:
                known[token] = self.symbols(token).tolist()
            elif n > SHORT:
                known[token] = self.merge_one(self.symbols(token).tolist())
            else:
                by_width.setdefault(1 << (n - 1).bit_length(), []).append(token)
        for width, tokens in by_width.items():
            for k in range(0, len(tokens), 20_000):
                some = tokens[k : k + 20_000]
                known.update(zip(some, (x.tolist() for x in self.merge_many([self.symbols(t) for t in some], width)), strict=True))
        return [[i for p in part for i in ((p,) if isinstance(p, int) else known[p])] for part in parts]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


def chunks_of(text: str) -> list[str]:
    """Pieces of a text that the tokenizer treats independently, in order.

    White space bounds them. In Latin-1 text without special tokens, lower case
    comes first and a comma or full stop between a letter and white space
    stands alone, which it also is to the tokenizer; that leaves fewer
    different pieces to learn.
    """
    if _ODD_SPACE.search(text):
        return [c for c in _SPACE.split(text) if c]
    if "<|" not in text and _latin(text):
        text = _STOPS.sub(r" \1", text.lower())
    return text.split()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """A vocabulary with a bounded memory of chunks that came before."""

    def __init__(self, path: str, keep: int = 400_000):
        self.vocabulary, self.keep = Vocabulary(path), keep
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def learn(self, chunks: Iterable[str]) -> None:
        """Afterwards ``ids`` and ``decoded`` hold all of ``chunks``."""
        chunks = set(chunks)
        if len(self.ids) + len(chunks) > self.keep:
            self.ids, self.decoded = {}, {}
        new = [c for c in chunks if c not in self.ids]
        for chunk, ids in zip(new, self.vocabulary.encode_chunks(new), strict=True):
            self.ids[chunk] = " ".join(map(str, ids))
            self.decoded[chunk] = self.vocabulary.decode(ids)

    def rows(self, texts: list[str], budget: int = 2_000_000) -> Iterator[tuple[str, str]]:
        """(decimal ids, decoded text), each joined by spaces, of every text."""
        k = 0
        while k < len(texts):
            split, size = [], 0
            while k < len(texts) and (not split or size < budget):
                split.append(chunks_of(texts[k]))
                size += len(texts[k])
                k += 1
            self.learn(c for chunks in split for c in chunks)
            for chunks in split:
                yield " ".join(map(self.ids.__getitem__, chunks)), " ".join(map(self.decoded.__getitem__, chunks))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_frame(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``id_col`` and the ids and decoded text of every row of ``docs``.

    With ``digests`` the columns are ``n_tokens`` and the SHA-256 of the ids
    (decimal, one space between) and of the decoded text; else ``ids`` (an
    array) and ``decoded``. A null text counts as empty (no ids, empty decoded
    text); ids may be null or repeat: rows are independent of each other. A
    text of any length is encoded whole; an empty table gives an empty result.
    Nothing is shuffled. Other columns of ``docs`` are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(docs[id_col].alias("row_id"), docs[text_col].cast("string").alias("body"))
    more = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def digest(rows) -> list[pa.Array]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        rows = [(a.count(" ") + 1 if a else 0, sha(a), sha(b)) for a, b in rows]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]

    def whole(rows) -> list[pa.Array]:
        rows = list(rows)
        return [pa.array([[int(x) for x in a.split()] for a, _ in rows], pa.list_(pa.int32())), pa.array([b for _, b in rows], pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in small(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                columns = (digest if digests else whole)(own.rows(texts))
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, *names])

    return frame.mapInArrow(run, f"`{id_col}` {kind}, {more}")


def small(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)
