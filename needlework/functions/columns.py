"""Column functions over the byte view of a column.

The byte view has one character per byte, so that offsets are byte offsets and
any bytes can be matched, all in built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.literals import start_regex
from ..plans.patterns import PatternSet
from ..types import MATCH, MATCHES



def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_view(c: str | Column, binary: bool = False) -> Column:
    """One character per byte of a string (its UTF-8 bytes) or, with ``binary``, of a binary column."""
    c = as_column(c)
    return F.decode(c if binary else F.encode(c, "UTF-8"), "ISO-8859-1")


def from_byte_view(c: str | Column) -> Column:
    """The binary value of a byte view."""
    return F.encode(as_column(c), "ISO-8859-1")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lengths: Column) -> Column:
    """Running sums of an array of bigint, in blocks of the square root of its size."""
    zero = F.array(F.lit(0).cast("long"))

    def running(values: Column) -> Column:
        """0 and the sums; an array grows by copying, so it is for few values."""
        return F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def blocks(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v["all"]) - 1) / v["width"]).cast("int")), lambda k: F.slice(v["all"], k * v["width"] + 1, v["width"]))
        return let(parts, lambda own: let(running(F.transform(own, total)), lambda before: F.flatten(F.transform(own, lambda a, i: shifted(a, before[i])))))

    def shifted(values: Column, by: Column) -> Column:
        grown = F.aggregate(values, F.array(by), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(grown, 2, F.size(values))

    def sums(own: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(own).cast("double"))).cast("int")
        return F.when(F.size(own) == 0, own).otherwise(let(F.struct(own.alias("all"), width.alias("width")), blocks))

    return let(lengths, sums)


def regex_hits(view: Column, regex: str) -> Column:
    """array<struct<text, end>> of the matches of a regex that is never empty."""
    both = F.struct(F.regexp_extract_all(view, F.lit(regex), F.lit(0)).alias("hits"), F.split(view, regex, -1).alias("gaps"))

    def located(v: Column) -> Column:
        lengths = F.transform(v["hits"], lambda w, i: (F.length(v["gaps"][i]) + F.length(w)).cast("long"))
        return let(prefix_sums(lengths), lambda ends: F.transform(v["hits"], lambda w, i: F.struct(w.alias("text"), ends[i].alias("end"))))

    return let(both, located)


def fold(text: Column, patterns: PatternSet) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if patterns.case_insensitive else text


def literal_hits(view: Column, patterns: PatternSet) -> Column:
    """array<struct<text, end>>: leftmost-longest literals; the text is folded if the set is."""
    hits = regex_hits(view, patterns.literal_regex)
    return F.transform(hits, lambda h: F.struct(fold(h["text"], patterns).alias("text"), h["end"].alias("end"))) if patterns.case_insensitive else hits


def id_map(patterns: PatternSet) -> Column:
    """Map literal from text to the lowest id that has it."""
    return F.create_map(*[F.lit(x) for text, ids in patterns.keys.items() for x in (text, ids[0])])


def _match(pattern_id: Column, text: Column, end: Column) -> Column:
    return F.struct(pattern_id.cast("int").alias("pattern_id"), (end - F.length(text)).cast("int").alias("start"), end.cast("int").alias("end"))


def _regex_match(pattern_id: int) -> Callable[[Column], Column]:
    return lambda h: _match(F.lit(pattern_id), h["text"], h["end"])


def in_order(found: Column) -> Column:
    """An array of matches by start, pattern id, end."""
    keyed = F.array_sort(F.transform(found, lambda m: F.struct(m["start"], m["pattern_id"], m["end"])))
    return F.transform(keyed, lambda m: F.struct(m["pattern_id"], m["start"], m["end"]))


def matches(c: str | Column, patterns: PatternSet, binary: bool = False) -> Column:
    """array of matches by (start, pattern_id, end); null for null.

    Literals are leftmost-longest among themselves; each regex goes by itself.
    Native sets only, and best for some dozens of literals: ``operators.scan``
    chooses a strategy for any.
    """
    view = byte_view(c, binary)

    def found(v: Column) -> Column:
        parts = []
        if patterns.literal_regex:
            ids = id_map(patterns)
            parts.append(F.transform(literal_hits(v, patterns), lambda h: _match(ids[h["text"]], h["text"], h["end"])))
        for r in patterns.regexes:
            parts.append(F.transform(regex_hits(v, r.rendered), _regex_match(r.pattern_id)))
        one = F.concat(*parts) if len(parts) > 1 else parts[0]
        return in_order(one) if len(parts) > 1 else one

    return F.when(view.isNotNull(), let(view, found)).otherwise(F.lit(None).cast(MATCHES))


def match_count(c: str | Column, patterns: PatternSet, binary: bool = False) -> Column:
    """Number of matches, without making them; null for null."""

    def count(v: Column) -> Column:
        own = [F.regexp_count(v, F.lit(x)) for x in [patterns.literal_regex, *[r.rendered for r in patterns.regexes]] if x]
        return sum(own[1:], own[0]).cast("long")

    return let(byte_view(c, binary), count)


def contains_any(c: str | Column, patterns: PatternSet, binary: bool = False) -> Column:
    """Whether any pattern matches; null for null."""
    return byte_view(c, binary).rlike(patterns.combined_regex)


def byte_count(c: str | Column, byte: int, binary: bool = False) -> Column:
    """How often a byte occurs; for cheap filters ahead of a scan."""
    return F.regexp_count(byte_view(c, binary), F.lit(f"\\x{byte:02x}")).cast("long")


def pattern_flags(c: str | Column, patterns: PatternSet, binary: bool = False) -> Column:
    """array<boolean> by pattern id: whether it occurs anywhere."""
    own = {}
    for i, raw in patterns.literals:
        own[i] = start_regex([patterns.fold(raw.decode("latin-1"))], patterns.case_insensitive)
    for r in patterns.regexes:
        own[r.pattern_id] = r.rendered
    return let(byte_view(c, binary), lambda v: F.array(*[v.rlike(own[i]) for i in range(len(patterns))]))


def first_match(c: str | Column, patterns: PatternSet, binary: bool = False) -> Column:
    """The first match by (start, pattern_id, end), or null; each engine stops at its first."""

    ids = id_map(patterns) if patterns.literal_regex else None

    def one(v: Column, regex: str, pattern_id: int | None) -> Column:
        """(start, pattern_id, end) of an engine's first match, or null."""
        hit = F.struct(F.regexp_instr(v, F.lit(regex)).alias("at"), F.regexp_extract(v, regex, 0).alias("text"))

        def placed(h: Column) -> Column:
            own = ids[fold(h["text"], patterns)] if pattern_id is None else F.lit(pattern_id)
            return F.when(h["at"] > 0, F.struct((h["at"] - 1).cast("int").alias("start"), own.cast("int").alias("pattern_id"), (h["at"] - 1 + F.length(h["text"])).cast("int").alias("end")))

        return let(hit, placed)

    def found(v: Column) -> Column:
        hits = [one(v, patterns.literal_regex, None)] if patterns.literal_regex else []
        hits += [one(v, r.rendered, r.pattern_id) for r in patterns.regexes]
        return let(F.least(*hits) if len(hits) > 1 else hits[0], lambda m: F.when(m.isNotNull(), F.struct(m["pattern_id"].alias("pattern_id"), m["start"].alias("start"), m["end"].alias("end"))))

    return let(byte_view(c, binary), found).cast(MATCH)


def match_texts(c: str | Column, patterns: PatternSet, binary: bool = False) -> Column:
    """array<binary> of what the literals matched, in order; of each regex after."""

    def found(v: Column) -> Column:
        own = [F.regexp_extract_all(v, F.lit(x), F.lit(0)) for x in [patterns.literal_regex, *[r.rendered for r in patterns.regexes]] if x]
        return F.transform(F.concat(*own) if len(own) > 1 else own[0], from_byte_view)

    return let(byte_view(c, binary), found)


def redact(c: str | Column, patterns: PatternSet, replacement: str = "[redacted]") -> Column:
    """The string with every literal, then every regex match replaced."""

    def replaced(v: Column) -> Column:
        for x in [patterns.literal_regex, *[r.rendered for r in patterns.regexes]]:
            if x:
                v = F.regexp_replace(v, x, replacement.encode().decode("latin-1").replace("\\", "\\\\").replace("$", "\\$"))
        return F.decode(from_byte_view(v), "UTF-8")

    return let(byte_view(c), replaced)


def overlapping_hits(view: Column, patterns: PatternSet) -> Column:
    """array<struct<start, window>>: where some literal begins, and the bytes from there that the longest may need."""
    texts = list(patterns.keys)
    begins = start_regex(texts, patterns.case_insensitive)
    longest = max(map(len, texts))
    windows = F.regexp_extract_all(view, F.lit(f"(?={begins})(?=([\\x00-\\xff]{{1,{longest}}}))"), F.lit(1))
    pieces = F.split(view, f"(?={begins})", -1)
    both = F.struct(windows.alias("windows"), pieces.alias("pieces"))

    def located(v: Column) -> Column:
        # Java's split drops the empty piece before a hit at 0, so the last pieces belong to the windows
        lead = F.size(v["pieces"]) - F.size(v["windows"])
        sums = prefix_sums(F.transform(v["pieces"], lambda p: F.length(p).cast("long")))
        return let(F.struct(sums.alias("sums"), lead.alias("lead")), lambda s: F.transform(v["windows"], lambda w, i: F.struct(F.when(s["lead"] + i == 0, F.lit(0).cast("long")).otherwise(s["sums"][s["lead"] + i - 1]).alias("start"), w.alias("window"))))

    return let(both, located)


def fnv1a32(c: str | Column, binary: bool = False) -> Column:
    """32-bit FNV-1a of the bytes, as a bigint."""
    codes = F.transform(F.filter(F.split(byte_view(c, binary), ""), lambda x: x != ""), F.ascii)
    step = lambda h, b: (h.bitwiseXOR(b.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)
