"""Chat formatting with typed content parts, in built-in functions only.

A turn's content is an array of parts ``struct<type, text, ref, tokens>``. A
visitor (one CASE over the part's type) flattens them: text is escaped, an
image, audio or document part becomes a numbered placeholder while its
reference and expanded token count go to the list of attachments.

Escaping: wherever the first character of a control string is followed by any
number of backslashes and its rest, one backslash is put in; reading takes one
out. No control string is left in escaped text, and every text comes back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the template and common chat formats use as marks.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
MEDIA = ("image", "audio", "document")
PART = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"


def _around(controls: tuple[str, ...]) -> tuple[str, str]:
    first = "".join(sorted({re.escape(c[0]) for c in controls}))
    rest = "|".join(re.escape(c[1:]) for c in controls)
    return f"(?<=[{first}])", f"(?=\\\\*(?:{rest}))"


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    before, after = _around(controls)
    return F.regexp_replace(text, before + after, r"\\")


def unescape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    before, after = _around(controls)
    return F.regexp_replace(text, before + r"\\" + after, "")


def text_parts(text: Column) -> Column:
    """Plain text as a content of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens")))


def visit(part: Column, index: Column) -> Column:
    """A part flattened to text: the visitor's one case per type."""
    marker = F.concat(F.lit("<|"), part["type"], F.lit(":"), index.cast("string"), F.lit("|>"))
    return F.when(part["type"].isin(*MEDIA), marker).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def flatten_parts(parts: Column) -> Column:
    return F.concat_ws("", F.transform(F.coalesce(parts, F.array().cast(PART)), visit))


def attachments(parts: Column) -> Column:
    """array<struct<position, type, ref, tokens>> of the parts that aren't text; position is that in the placeholder."""
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0).cast("long")).alias("tokens")))
    return F.coalesce(F.filter(numbered, lambda p: p["type"].isin(*MEDIA)), F.array().cast("array<struct<position:int,type:string,ref:string,tokens:bigint>>"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv, formatted, loss_mask, attachments, expanded_tokens.

    ``loss_mask`` has the (start, length) in code points, from 0, of the content
    of the turns whose role is trained on. ``attachments`` lists (turn, position,
    type, ref, tokens) in order; ``expanded_tokens`` sums their tokens.

    Turns are ordered by ``turn`` (nulls first), ties by role and content. A null
    role is empty, a null content has no parts, a null part text is empty; a
    null conversation id is one conversation. Repeated rows are turns of their
    own; other columns are ignored; an empty table gives no row. One shuffle, by
    conversation; a conversation itself is one row, so its texts together have
    the length that a cell may have.
    """
    names = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("at"), names.alias("role"), flatten_parts(F.col(parts)).alias("body"), attachments(F.col(parts)).alias("files"))
    packed = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "role", "body", "files"))).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY))
    piece = lambda t: F.concat(head(t), t["body"], F.lit(END))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["end"] + F.length(head(t))
        size = F.length(t["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + F.lit(len(END))).alias("end"), F.when(t["role"].isin(*train_roles), F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    files = F.flatten(F.transform("turns", lambda t, i: F.transform(t["files"], lambda f: F.struct(i.alias("turn"), f["position"].alias("position"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    out = packed.select(
        F.col("conv").alias(conv),
        F.concat_ws("", F.transform("turns", piece)).alias("formatted"),
        F.aggregate("turns", zero, step, lambda acc: acc["mask"]).alias("loss_mask"),
        files.alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, f: acc + f["tokens"]))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> back from the formatted text (text with its placeholders)."""
    turns = F.slice(F.split(formatted, re.escape(TURN)), 2, 1 << 30)

    def read(t: Column) -> Column:
        two = F.split(F.substring_index(t, END, 1), re.escape(BODY), 2)
        return F.struct(unescape(two[0]).alias("role"), unescape(two[1]).alias("text"))

    return F.transform(turns, read)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text that the loss mask covers, in order."""
    return F.concat_ws("", F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))
