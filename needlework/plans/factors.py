"""Literals that every match of a regex contains, so that a haystack without any of them needs no regex."""

from __future__ import annotations

from dataclasses import dataclass

from . import regexast
from .regexast import Alternate, Bytes, Concat, Look, Node, Repeat

#: Strings of a set and bytes of a string at most, and bytes of a class that is spelled out.
MOST, LONGEST, CLASS = 24, 32, 4

Set = frozenset[bytes]


@dataclass(frozen=True)
class _Known:
    """``exact``: all that the node can match, if that is a small set; ``needed``: one of these is in every match."""

    exact: Set | None
    needed: Set | None


_EMPTY: Set = frozenset([b""])


def better(a: Set | None, b: Set | None) -> Set | None:
    """The set that rules out more: a longer shortest string, then fewer strings."""
    if a is None or b is None:
        return a if b is None else b
    rank = lambda s: (min(map(len, s), default=0), -len(s), sorted(s))
    return max(a, b, key=rank)


def _useful(s: Set | None) -> Set | None:
    return s if s and min(map(len, s)) > 0 else None


def _of(node: Node) -> _Known:
    if isinstance(node, Look):
        return _Known(_EMPTY, None)
    if isinstance(node, Bytes):
        own = frozenset(bytes([b]) for b in node.allowed) if len(node.allowed) <= CLASS else None
        return _Known(own, own)
    if isinstance(node, Alternate):
        parts = [_of(x) for x in node.items]
        exact = None if any(p.exact is None for p in parts) else frozenset().union(*[p.exact for p in parts])
        needed = [better(p.needed, _useful(p.exact)) for p in parts]
        whole = None if any(n is None for n in needed) else frozenset().union(*needed)
        return _Known(exact if exact is not None and len(exact) <= MOST else None, whole if whole is not None and len(whole) <= MOST else None)
    if isinstance(node, Repeat):
        own = _of(node.item)
        if own.exact is not None and node.most is not None and node.most - node.least <= CLASS:
            times = [_joined([own] * k).exact for k in range(node.least, node.most + 1)] if node.most <= LONGEST else [None]
            exact = None if None in times else frozenset().union(*times)
            if exact is not None and len(exact) <= MOST:
                return _Known(exact, _useful(exact))
        if node.least == 0:
            return _Known(None, None)
        first = _joined([own] * min(node.least, LONGEST)) if own.exact is not None else own
        return _Known(None, better(first.needed, better(own.needed, _useful(first.exact))))
    return _joined([_of(x) for x in node.items])


def _joined(parts: list[_Known]) -> _Known:
    """Neighbours whose strings are known are put together as far as the set stays small."""
    run, whole, needed = _EMPTY, True, None
    for p in parts:
        needed = better(needed, p.needed)
        grown = None
        if p.exact is not None and len(run) * len(p.exact) <= MOST:
            grown = frozenset(a + b for a in run for b in p.exact)
            grown = grown if max(map(len, grown)) <= LONGEST else None
        if grown is not None:
            run = grown
            continue
        needed, whole = better(needed, _useful(run)), False
        run = p.exact if p.exact is not None and len(p.exact) <= MOST and max(map(len, p.exact), default=0) <= LONGEST else _EMPTY
    return _Known(run if whole else None, better(needed, _useful(run)))


def required(node: Node) -> Set | None:
    """A small set of strings, none empty, one of which is in every match of the regex; None if none is known."""
    own = _of(node)
    return _useful(better(own.needed, _useful(own.exact)))


def required_of(text: str) -> Set | None:
    return required(regexast.parse(text))
