"""Pattern sets: declared on the driver, validated once, immutable, picklable."""

from __future__ import annotations

import threading
from dataclasses import dataclass, replace
from functools import cached_property

from ..errors import EmptyPattern, EmptyPatternSet, PathologicalRegex, PatternCompilationFailed, PatternSetTooLarge, PatternTooLarge
from . import regexast
from .literals import ascii_lower, trie_regex

#: Default limit of a generated regular expression, in characters.
REGEX_LIMIT = 50 << 20
LARGEST_PATTERN = 1 << 16
LARGEST_SET = 1 << 24


@dataclass(frozen=True)
class Pattern:
    pattern_id: int
    kind: str  # literal or regex
    literal: bytes | None = None
    regex: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class CompiledRegex:
    """A regex that is no plain string."""

    pattern_id: int
    source: str
    rendered: str
    least: int
    most: int | None
    native: bool  # safe for Java: never empty, no deep recursion


@dataclass(frozen=True)
class PatternSet:
    """Patterns by id (their place in order), shared by literals and regexes.

    ``case_insensitive`` is ASCII-only and holds for literals, also for regexes
    that are plain strings; other regexes use ``(?i)``.
    """

    patterns: tuple[Pattern, ...]
    case_insensitive: bool = False
    regex_limit: int = REGEX_LIMIT

    @staticmethod
    def builder() -> PatternSetBuilder:
        return PatternSetBuilder()

    @staticmethod
    def of(*literals: str | bytes, case_insensitive: bool = False) -> PatternSet:
        own = PatternSetBuilder().case_insensitive(case_insensitive)
        for x in literals:
            own.literal(x) if isinstance(x, str) else own.literal_bytes(x)
        return own.build()

    def __len__(self) -> int:
        return len(self.patterns)

    @property
    def is_empty(self) -> bool:
        return not self.patterns

    @property
    def names(self) -> tuple[str | None, ...]:
        return tuple(p.name for p in self.patterns)

    @cached_property
    def _parsed(self) -> dict[int, regexast.Node]:
        return {p.pattern_id: regexast.parse(p.regex) for p in self.patterns if p.kind == "regex"}

    @cached_property
    def literals(self) -> tuple[tuple[int, bytes], ...]:
        """Ids and bytes of literals and of regexes that are plain strings, by id."""
        out = []
        for p in self.patterns:
            raw = p.literal if p.kind == "literal" else regexast.literal_of(self._parsed[p.pattern_id])
            if raw is not None:
                out.append((p.pattern_id, raw))
        return tuple(out)

    @cached_property
    def regexes(self) -> tuple[CompiledRegex, ...]:
        plain = {i for i, _ in self.literals}
        out = []
        for p in self.patterns:
            if p.kind == "regex" and p.pattern_id not in plain:
                node = self._parsed[p.pattern_id]
                least, most = regexast.lengths(node)
                out.append(CompiledRegex(p.pattern_id, p.regex, regexast.render(node), least, most, least > 0 and not regexast.deep_in_java(node)))
        return tuple(out)

    @cached_property
    def keys(self) -> dict[str, tuple[int, ...]]:
        """Text (one character per byte, folded if case-insensitive) to the ids that have it, ascending."""
        found: dict[str, list[int]] = {}
        for i, raw in self.literals:
            found.setdefault(self.fold(raw.decode("latin-1")), []).append(i)
        return {k: tuple(v) for k, v in found.items()}

    def fold(self, text: str) -> str:
        return ascii_lower(text) if self.case_insensitive else text

    @cached_property
    def literal_regex(self) -> str | None:
        """One regular expression whose leftmost-first match is the leftmost-longest literal."""
        if not self.keys:
            return None
        made = trie_regex(self.keys, self.case_insensitive)
        if len(made) > self.regex_limit:
            raise PatternSetTooLarge(f"{len(made)} characters of regular expression; the limit is {self.regex_limit}")
        return made

    @cached_property
    def combined_regex(self) -> str:
        """All patterns as one alternation, for tests of whether any matches."""
        own = [self.literal_regex] if self.literal_regex else []
        return "|".join([*own, *[f"(?:{r.rendered})" for r in self.regexes]])

    @property
    def max_pattern_len(self) -> int:
        """Bytes of the longest literal."""
        return max((len(raw) for _, raw in self.literals), default=0)

    @property
    def max_match_len(self) -> int | None:
        """Bytes that a match has at most; None: no limit."""
        most = [self.max_pattern_len, *[r.most for r in self.regexes]]
        return None if None in most else max(most)

    @property
    def native(self) -> bool:
        return all(r.native for r in self.regexes)


class PatternSetBuilder:
    """Collects patterns; ``build`` validates."""

    def __init__(self) -> None:
        self._patterns: list[Pattern] = []
        self._set = PatternSet(())

    def _add(self, **fields) -> PatternSetBuilder:
        self._patterns.append(Pattern(len(self._patterns), **fields))
        return self

    def literal(self, text: str) -> PatternSetBuilder:
        return self._add(kind="literal", literal=text.encode("utf-8"))

    def literal_bytes(self, raw: bytes) -> PatternSetBuilder:
        return self._add(kind="literal", literal=bytes(raw))

    def named_literal(self, name: str, text: str) -> PatternSetBuilder:
        return self._add(kind="literal", literal=text.encode("utf-8"), name=name)

    def regex(self, text: str) -> PatternSetBuilder:
        return self._add(kind="regex", regex=text)

    def named_regex(self, name: str, text: str) -> PatternSetBuilder:
        return self._add(kind="regex", regex=text, name=name)

    def case_insensitive(self, on: bool = True) -> PatternSetBuilder:
        self._set = replace(self._set, case_insensitive=on)
        return self

    def regex_limit(self, characters: int) -> PatternSetBuilder:
        """Limit of the regular expression generated for a set."""
        self._set = replace(self._set, regex_limit=max(1, min(characters, 2 << 30)))
        return self

    def build(self) -> PatternSet:
        if not self._patterns:
            raise EmptyPatternSet("no patterns")
        if len(self._patterns) > LARGEST_SET:
            raise PatternSetTooLarge(f"{len(self._patterns)} patterns")
        for p in self._patterns:
            if not (p.literal if p.kind == "literal" else p.regex):
                raise EmptyPattern(p.pattern_id)
            if len(p.literal or p.regex) > LARGEST_PATTERN:
                raise PatternTooLarge(f"pattern {p.pattern_id}")
        done = replace(self._set, patterns=tuple(self._patterns))
        for i, node in done._parsed.items():
            if regexast.pathological(node):
                raise PathologicalRegex(i)
            if len(regexast.render(node)) > done.regex_limit:
                raise PatternCompilationFailed(f"pattern {i} is larger than the limit")
        _ = done.literal_regex
        return done


class HotSwapPatternSet:
    """A pattern set that can be replaced while scans go on; each scan has the set of its start."""

    def __init__(self, first: PatternSet):
        self._lock, self._own, self.version = threading.Lock(), first, 0

    def current(self) -> PatternSet:
        with self._lock:
            return self._own

    def swap(self, new: PatternSet) -> bool:
        """False if it is the very set in use."""
        with self._lock:
            if new is self._own:
                return False
            self._own, self.version = new, self.version + 1
            return True
