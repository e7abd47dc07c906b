"""Words of UTF-8 text as segments of a byte array, hashed all at once."""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes whose words are hashed at once.
BLOCK = 1 << 20


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.cumprod(np.full(BLOCK, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


@cache
def word_bytes() -> np.ndarray:
    """1 for letters and digits of ASCII and all bytes of other characters, else 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        table[b] = b >= 128 or chr(b).isalnum()
    return table


def segments(x: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and classes of the longest runs of one class other than 0."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    kind = classes[x]
    cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(x)]])
    kind = kind[starts]
    keep = kind != 0
    return starts[keep], ends[keep], kind[keep]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finish of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment's bytes; segments are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = int(np.searchsorted(ends, base + BLOCK, "right"))
        if last <= first:  # longer than a block: the block hashes are words in turn
            own = x[base : int(ends[first])]
            cuts = np.arange(0, len(own), BLOCK)
            parts = hashes(own, cuts, np.minimum(cuts + BLOCK, len(own)))
            total = 0
            for p in parts.tolist():
                total = (total * _BASE + p + 1) & _MASK
            out[first] = total
            first += 1
            continue
        end = int(ends[last - 1])
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum((x[base:end].astype(np.uint64) + np.uint64(1)) * up[: end - base], out=sums[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((sums[b] - sums[a]) * down[a])
        first = last
    return out


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased text, code point by code point; starts, ends and hashes of its words."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    x = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = segments(x, word_bytes())
    return x, starts, ends, hashes(x, starts, ends)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(_BASE) + h[i : i + n]
    return mix(total)
