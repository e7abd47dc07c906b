"""Regular expressions for sets of literals."""

from __future__ import annotations

from collections.abc import Iterable

from .regexast import byte

_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def _one(c: str, fold: bool) -> str:
    return f"[{c}{c.upper()}]" if fold and "a" <= c <= "z" else byte(ord(c))


def trie_regex(literals: Iterable[str], fold: bool = False) -> str:
    """The literals as a trie, children before acceptance, so the longest wins.

    Levels with a single child become one run, which keeps the nesting (and so
    the recursion of the engines) at the number of branches, not of characters.
    """
    root: dict = {}
    for text in literals:
        node = root
        for c in text:
            node = node.setdefault(c, {})
        node[""] = True

    def render(node: dict) -> str:
        """What may follow; starts as a stack of frames, for literals can be long."""
        out: dict[int, str] = {}
        stack = [(node, False)]
        while stack:
            at, ready = stack.pop()
            if not ready:
                stack.append((at, True))
                stack.extend((child, False) for c, child in at.items() if c)
                continue
            options = [_one(c, fold) + out.pop(id(at[c])) for c in sorted(k for k in at if k)]
            if not options:
                out[id(at)] = ""
            elif "" in at:
                out[id(at)] = f"(?:{'|'.join(options)})?"
            elif len(options) == 1:
                out[id(at)] = options[0]
            else:
                out[id(at)] = f"(?:{'|'.join(options)})"
        return out[id(node)]

    return render(root)


def start_regex(literals: Iterable[str], fold: bool = False) -> str:
    """Matches where any of the literals begins: those with another as their prefix are left out."""
    least: list[str] = []
    for text in sorted(set(literals)):
        if not least or not text.startswith(least[-1]):
            least.append(text)
    return trie_regex(least, fold)
