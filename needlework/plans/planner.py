"""The choice of a strategy, made when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .patterns import PatternSet

NATIVE, ARROW = "native", "arrow"
#: Literals up to which ids are looked up in a map literal; beyond, by a join.
MAP_PATTERNS = 64
#: Literals beyond which Python's engine is faster than Java's.
NATIVE_PATTERNS = 20_000
#: Literals up to which each is looked for by itself, to leave out rows without any; more cost what they save.
SIEVE_PATTERNS = 3


@dataclass(frozen=True)
class ScanConfig:
    """``strategy``: auto, native (built-in functions) or arrow (Python's engine in Arrow batches).

    ``compat`` gives literals another rule than leftmost-longest: shortest_all
    (at each start the shortest, with all its ids) or needle_by_needle (hits of
    each literal first, then the leftmost and longest of them). ``max_matches``
    fails a query if a haystack has that many matches or more. ``fallback``
    sends what the native strategy can't run to Python instead of failing;
    ``fallback_reason`` says when and why. ``sieve`` lets built-in tests leave
    out rows without a match before haystacks go to Python.
    """

    strategy: str = "auto"
    compat: str | None = None
    chunk_bytes: int = 1 << 20
    overlap: int = 4096
    max_matches: int = 1 << 20
    batch_inputs: int = 4096
    batch_bytes: int = 256 << 20
    sort_by_size: bool = True
    sieve: bool = True
    fallback: bool = False

    def with_chunk_bytes(self, n: int) -> ScanConfig:
        n = max(1, n)
        return replace(self, chunk_bytes=n, overlap=min(self.overlap, n - 1))

    def with_overlap(self, n: int) -> ScanConfig:
        return replace(self, overlap=max(0, min(n, self.chunk_bytes - 1)))

    def with_max_matches(self, n: int) -> ScanConfig:
        return replace(self, max_matches=max(1, n))


#: Results that are rows or arrays of matches; the others are counts, tests and first matches.
ROWS = ("scan", "nested", "overlapping")
OPERATORS = (*ROWS, "count", "any", "first")


def not_native(patterns: PatternSet, config: ScanConfig, operator: str) -> str | None:
    """Why the native strategy can't run a set, if it can't."""
    if config.compat:
        return "the native strategy is leftmost-longest"
    if not patterns.native:
        return "a regex of the set can't run in the native strategy"
    if operator == "nested" and len(patterns.keys) > MAP_PATTERNS:
        return f"arrays of matches are native for {MAP_PATTERNS} literals at most"
    return None


def choose(patterns: PatternSet, config: ScanConfig = ScanConfig(), operator: str = "scan") -> tuple[str, str]:
    """The strategy of an operator, and why."""
    if config.strategy not in ("auto", NATIVE, ARROW):
        raise ValueError(f"unknown strategy {config.strategy}")
    if config.compat not in (None, "shortest_all", "needle_by_needle"):
        raise ValueError(f"unknown rule {config.compat}")
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator}")
    if config.strategy == NATIVE and (why := not_native(patterns, config, operator)):
        if not config.fallback:
            raise ValueError(why)
        return ARROW, f"fallback: {why}"
    if config.compat:
        return ARROW, f"the rule {config.compat} is Python's"
    if config.strategy != "auto":
        return config.strategy, "asked for"
    if not patterns.native:
        return ARROW, "a regex may be empty or repeats a group"
    if operator in ROWS:
        return ARROW, "offsets come with the matches"
    if operator == "first" and len(patterns.keys) > MAP_PATTERNS:
        return ARROW, f"more than {MAP_PATTERNS} literals"
    if len(patterns.keys) > NATIVE_PATTERNS:
        return ARROW, f"more than {NATIVE_PATTERNS} literals"
    return NATIVE, "built-in functions count and test without making matches"


def fallback_reason(patterns: PatternSet, config: ScanConfig = ScanConfig(), operator: str = "scan") -> str | None:
    """Why an operator that was asked to be native goes to Python; None if it doesn't."""
    if config.strategy != NATIVE or not config.fallback:
        return None
    return not_native(patterns, config, operator)


def strategy(patterns: PatternSet, config: ScanConfig = ScanConfig(), operator: str = "scan") -> str:
    return choose(patterns, config, operator)[0]


def sieve(patterns: PatternSet, config: ScanConfig = ScanConfig()) -> bool:
    """Whether rows without any match are left out by built-in tests before haystacks go to Python."""
    return config.sieve and not patterns.case_insensitive and not patterns.regexes and 0 < len(patterns.keys) <= SIEVE_PATTERNS


def describe(patterns: PatternSet, config: ScanConfig = ScanConfig(), operator: str = "scan") -> dict:
    """What an operator will do, for logs and tests."""
    own, why = choose(patterns, config, operator)
    return {
        "strategy": own,
        "reason": why,
        "sieve": own == ARROW and operator in ROWS and sieve(patterns, config),
        "literals": len(patterns.literals),
        "regexes": len(patterns.regexes),
        "ids": "python" if own == ARROW else "map" if len(patterns.keys) <= MAP_PATTERNS else "join",
        "max_match_len": patterns.max_match_len,
    }
