"""Byte regular expressions: parser, analysis and a rendering for Java and Python.

The dialect is that of byte regexes without Unicode classes and with line
anchors on: ``.`` is any byte but ``\\n``, ``\\w \\d \\s \\b`` are ASCII, ``^``
and ``$`` match at lines. Both engines get the same rendering over one character
per byte, with every class spelled out, so that their own defaults don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import PatternCompilationFailed

ALL = frozenset(range(256))
DIGIT = frozenset(b"0123456789")
WORD = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
SPACE = frozenset(b"\t\n\x0b\x0c\r ")
ALPHA = frozenset(b for b in WORD if chr(b).isalpha())
POSIX = {
    "alnum": ALPHA | DIGIT, "alpha": ALPHA, "ascii": frozenset(range(128)), "blank": frozenset(b"\t "), "cntrl": frozenset([*range(32), 127]), "digit": DIGIT,
    "graph": frozenset(range(33, 127)), "lower": frozenset(b for b in ALPHA if b > 96), "print": frozenset(range(32, 127)), "punct": frozenset(range(33, 127)) - ALPHA - DIGIT,
    "space": SPACE, "upper": frozenset(b for b in ALPHA if b < 97), "word": WORD, "xdigit": DIGIT | frozenset(b"abcdefABCDEF"),
}
ESCAPES = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11, "a": 7}
UNBOUNDED = None


@dataclass(frozen=True)
class Bytes:
    """One byte of a class."""

    allowed: frozenset[int]


@dataclass(frozen=True)
class Look:
    """A place: line_start, line_end, text_start, text_end, word, not_word."""

    kind: str


@dataclass(frozen=True)
class Repeat:
    item: object
    least: int
    most: int | None
    greedy: bool = True


@dataclass(frozen=True)
class Concat:
    items: tuple = ()


@dataclass(frozen=True)
class Alternate:
    items: tuple


Node = Bytes | Look | Repeat | Concat | Alternate


@dataclass
class _Flags:
    i: bool = False
    s: bool = False
    m: bool = True
    x: bool = False
    swap: bool = False

    def copy(self) -> _Flags:
        return _Flags(self.i, self.s, self.m, self.x, self.swap)


def folded(allowed: frozenset[int]) -> frozenset[int]:
    return allowed | frozenset(b ^ 32 for b in allowed if b in ALPHA)


@dataclass
class _Parser:
    text: str
    at: int = 0
    flags: _Flags = field(default_factory=_Flags)

    def fail(self, why: str) -> PatternCompilationFailed:
        return PatternCompilationFailed(f"{why} at {self.at} in {self.text!r}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise self.fail("unexpected end")
        self.at += 1
        return self.text[self.at - 1]

    def eat(self, what: str) -> bool:
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def skip(self) -> None:
        while self.flags.x and self.peek() and (self.peek().isspace() or self.peek() == "#"):
            if self.take() == "#":
                while self.peek() and self.take() != "\n":
                    pass

    def alternation(self) -> Node:
        options, items = [], []
        while True:
            self.skip()
            c = self.peek()
            if c in ("", ")"):
                break
            if self.eat("|"):
                options.append(Concat(tuple(items)))
                items = []
                continue
            item = self.repeated()
            if item is not None:
                items.append(item)
        options.append(Concat(tuple(items)))
        return options[0] if len(options) == 1 else Alternate(tuple(options))

    def repeated(self) -> Node | None:
        item = self.atom()
        while True:
            self.skip()
            c = self.peek()
            if c == "*":
                least, most = 0, UNBOUNDED
            elif c == "+":
                least, most = 1, UNBOUNDED
            elif c == "?":
                least, most = 0, 1
            elif c == "{":
                least, most = self.counts()
                self.at -= 1
            else:
                return item
            if item is None or isinstance(item, Look):
                raise self.fail("nothing to repeat")
            self.at += 1
            lazy = self.eat("?")
            item = Repeat(item, least, most, lazy == self.flags.swap)

    def counts(self) -> tuple[int, int | None]:
        end = self.text.find("}", self.at)
        low, comma, high = self.text[self.at + 1 : end].partition(",")
        if end < 0 or not low.strip().isdigit() or (high.strip() and not high.strip().isdigit()):
            raise self.fail("malformed repetition")
        self.at = end + 1
        least = int(low)
        most = least if not comma else int(high) if high.strip() else UNBOUNDED
        if most is not None and most < least:
            raise self.fail("repetition out of order")
        return least, most

    def literal(self, c: str) -> Node:
        raw = c.encode("utf-8") if isinstance(c, str) else bytes([c])
        items = tuple(Bytes(self.fold(frozenset([b]))) for b in raw)
        return items[0] if len(items) == 1 else Concat(items)

    def fold(self, allowed: frozenset[int]) -> frozenset[int]:
        return folded(allowed) if self.flags.i else allowed

    def atom(self) -> Node | None:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return Bytes(self.char_class())
        if c == ".":
            return Bytes(ALL if self.flags.s else ALL - {10})
        if c == "^":
            return Look("line_start" if self.flags.m else "text_start")
        if c == "$":
            return Look("line_end" if self.flags.m else "text_end")
        if c == "\\":
            return self.escape()
        if c in "*+?{":
            raise self.fail("nothing to repeat")
        return self.literal(c)

    def escape(self) -> Node:
        c = self.take()
        looks = {"b": "word", "B": "not_word", "A": "text_start", "z": "text_end"}
        if c in looks:
            return Look(looks[c])
        found = self.class_escape(c)
        return Bytes(self.fold(found)) if isinstance(found, frozenset) else self.literal(found)

    def class_escape(self, c: str) -> frozenset[int] | int | str:
        """A set, a byte, or a character."""
        sets = {"d": DIGIT, "w": WORD, "s": SPACE}
        if c.lower() in sets and c in "dwsDWS":
            own = sets[c.lower()]
            return own if c.islower() else ALL - own
        if c in ESCAPES:
            return ESCAPES[c]
        if c == "x":
            if self.eat("{"):
                end = self.text.find("}", self.at)
                digits, self.at = self.text[self.at : end], end + 1
            else:
                digits, self.at = self.peek(2), self.at + 2
            try:
                value = int(digits, 16)
            except ValueError:
                raise self.fail("bad hexadecimal escape") from None
            return value if value < 256 else chr(value)
        if c.isalnum():
            raise self.fail(f"unknown escape \\{c}")
        return c

    def char_class(self) -> frozenset[int]:
        negated, found, first = self.eat("^"), set(), True
        while True:
            if not first and self.eat("]"):
                break
            first = False
            if self.eat("[:"):
                end = self.text.find(":]", self.at)
                name, self.at = self.text[self.at : end], end + 2
                inverse = name.startswith("^")
                if name.lstrip("^") not in POSIX:
                    raise self.fail("unknown class")
                own = POSIX[name.lstrip("^")]
                found |= ALL - own if inverse else own
                continue
            if self.eat("["):
                found |= self.char_class()
                continue
            low = self.class_item()
            if isinstance(low, frozenset):
                found |= low
                continue
            if self.peek() == "-" and self.peek(2) != "-]":
                self.at += 1
                high = self.class_item()
                if isinstance(high, frozenset) or high < low:
                    raise self.fail("bad range")
                found |= set(range(low, high + 1))
            else:
                found.add(low)
        own = self.fold(frozenset(found))
        own = ALL - own if negated else own
        if not own:
            raise self.fail("empty class")
        return own

    def class_item(self) -> frozenset[int] | int:
        c = self.take()
        value = self.class_escape(self.take()) if c == "\\" else c
        if isinstance(value, str):
            if ord(value) > 127:
                raise self.fail("a class holds bytes, not other characters")
            value = ord(value)
        return value

    def group(self) -> Node | None:
        before = self.flags.copy()
        if self.eat("?"):
            if self.eat("P<") or (self.peek() == "<" and self.peek(2)[1:] not in ("=", "!") and self.eat("<")):
                end = self.text.find(">", self.at)
                if end < 0:
                    raise self.fail("unnamed group")
                self.at = end + 1
            else:
                on = True
                while True:
                    c = self.take()
                    if c == "-":
                        on = False
                    elif c in "ismxU":
                        setattr(self.flags, "swap" if c == "U" else c, on)
                    elif c == "u":
                        if on:
                            raise self.fail("Unicode mode is not supported")
                    elif c == ")":
                        return None  # flags for what follows
                    elif c == ":":
                        break
                    else:
                        raise self.fail("look-around and other extensions are not supported")
        inner = self.alternation()
        if not self.eat(")"):
            raise self.fail("unclosed group")
        self.flags = before
        return inner


def parse(text: str) -> Node:
    parser = _Parser(text)
    node = parser.alternation()
    if parser.at < len(text):
        raise parser.fail("unopened group")
    return node


# -- analysis ---------------------------------------------------------------
def children(node: Node) -> tuple:
    return node.items if isinstance(node, Concat | Alternate) else (node.item,) if isinstance(node, Repeat) else ()


def anywhere(node: Node, test: Callable[[Node], bool]) -> bool:
    return test(node) or any(anywhere(c, test) for c in children(node))


def literal_of(node: Node) -> bytes | None:
    """The bytes of an expression that is a plain string."""
    if isinstance(node, Bytes):
        return bytes(node.allowed) if len(node.allowed) == 1 else None
    if isinstance(node, Concat):
        parts = [literal_of(c) for c in node.items]
        return None if None in parts else b"".join(parts)
    return None


def pathological(node: Node) -> bool:
    """A repetition that may happen more than once and holds another repetition."""
    return anywhere(node, lambda n: isinstance(n, Repeat) and (n.most is None or n.most > 1) and anywhere(n.item, lambda c: isinstance(c, Repeat)))


def lengths(node: Node) -> tuple[int, int | None]:
    """Least and most bytes of a match; None: unbounded."""
    if isinstance(node, Bytes):
        return 1, 1
    if isinstance(node, Look):
        return 0, 0
    if isinstance(node, Repeat):
        low, high = lengths(node.item)
        return low * node.least, 0 if high == 0 else None if node.most is None or high is None else high * node.most
    parts = [lengths(c) for c in node.items]
    if isinstance(node, Concat):
        return sum(a for a, _ in parts), None if any(b is None for _, b in parts) else sum(b for _, b in parts)
    return min(a for a, _ in parts), None if any(b is None for _, b in parts) else max(b for _, b in parts)


def deep_in_java(node: Node) -> bool:
    """Whether Java's matcher recurses for each round of a repetition."""
    return anywhere(node, lambda n: isinstance(n, Repeat) and (n.most is None or n.most > 64) and not isinstance(n.item, Bytes))


# -- rendering --------------------------------------------------------------
def byte(b: int) -> str:
    return chr(b) if chr(b).isalnum() and b < 128 else f"\\x{b:02x}"


def byte_class(allowed: frozenset[int]) -> str:
    if len(allowed) == 1:
        return byte(next(iter(allowed)))
    if len(allowed) == 256:
        return "[\\x00-\\xff]"
    runs, values = [], sorted(allowed)
    for v in values:
        if runs and runs[-1][1] == v - 1:
            runs[-1][1] = v
        else:
            runs.append([v, v])
    return "[" + "".join(byte(a) if a == b else f"{byte(a)}-{byte(b)}" for a, b in runs) + "]"


_WORD = byte_class(WORD)
_LOOKS = {
    "line_start": "(?<![^\\x0a])", "line_end": "(?![^\\x0a])", "text_start": "(?<![\\x00-\\xff])", "text_end": "(?![\\x00-\\xff])",
    "word": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", "not_word": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
}


def render(node: Node) -> str:
    """For Java's and Python's engines, over one character per byte."""
    if isinstance(node, Bytes):
        return byte_class(node.allowed)
    if isinstance(node, Look):
        return _LOOKS[node.kind]
    if isinstance(node, Repeat):
        inner = render(node.item)
        if not isinstance(node.item, Bytes):
            inner = f"(?:{inner})"
        counts = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((node.least, node.most))
        counts = counts or f"{{{node.least}}}" if counts or node.least == node.most else f"{{{node.least},{'' if node.most is None else node.most}}}"
        return inner + counts + ("" if node.greedy else "?")
    if isinstance(node, Concat):
        return "".join(f"(?:{render(c)})" if isinstance(c, Alternate) else render(c) for c in node.items)
    return "|".join(render(c) for c in node.items)
