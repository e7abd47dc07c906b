"""Plain definitions of the scans, to test against."""

from __future__ import annotations


def leftmost_longest(data: bytes, literals: list[bytes]) -> list[tuple[int, int, int]]:
    out, at = [], 0
    while at < len(data):
        best = max(((len(x), -i) for i, x in enumerate(literals) if data.startswith(x, at)), default=None)
        if best is None:
            at += 1
        else:
            out.append((-best[1], at, at + best[0]))
            at += best[0]
    return out


def overlapping(data: bytes, literals: list[bytes]) -> list[tuple[int, int, int]]:
    return sorted((i, s, s + len(x)) for i, x in enumerate(literals) for s in range(len(data)) if data.startswith(x, s))
