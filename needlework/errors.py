"""Errors of pattern sets and scans."""

from __future__ import annotations


class ScanError(Exception):
    """Base of all."""


class EmptyPatternSet(ScanError):
    pass


class EmptyPattern(ScanError):
    def __init__(self, index: int):
        super().__init__(f"pattern {index} is empty")
        self.index = index


class PatternCompilationFailed(ScanError):
    pass


class PathologicalRegex(ScanError):
    """A repetition holds another one."""

    def __init__(self, index: int):
        super().__init__(f"regex {index} repeats a repetition")
        self.index = index


class PatternTooLarge(ScanError):
    pass


class PatternSetTooLarge(ScanError):
    pass


class InputTooLarge(ScanError):
    pass


class MatchBufferOverflow(ScanError):
    pass


class MatchTooLong(ScanError):
    """A match that goes on where the bytes at hand end, or one longer than was said."""


class IndexCorrupt(ScanError):
    pass
