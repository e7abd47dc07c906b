"""Schemas that the operators share. Offsets are byte offsets, half-open."""

from __future__ import annotations

MATCH = "struct<pattern_id:int,start:int,end:int>"
MATCHES = f"array<{MATCH}>"
PATTERN_SCHEMA = "pattern_id int, kind string, literal binary, regex string, name string"
