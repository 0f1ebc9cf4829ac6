"""Chat formatting with Spark expressions only: sort, merge neighbours of one role, concatenate; reversible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template. Each opens with "[" or "<", which never stand in an escaped text.
OPEN, TEXT, NEXT, CLOSE = "<s>[ROLE]", "[TEXT]", "[NEXT]", "[END]</s>"
#: Escapes, in the order in which they are put in; they are taken out in reverse order.
ESCAPES = (("~", "~0"), ("[", "~1"), ("<", "~2"))
LOSS_ROLE = "assistant"
#: Pieces whose places are summed in one go.
BLOCK = 256


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(turns: Column) -> Column:
    """Neighbouring turns of one role together: where the role changes a block starts, and each block is a slice."""

    def cut(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return let(starts, lambda s: F.transform(s, lambda i, k: F.slice(t, i + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - i)))

    return let(turns, cut)


def _segments(block: Column) -> Column:
    """A block as pieces of the formatted text, each with its bit of the loss mask."""
    role = F.get(block, F.lit(0))["role"]

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    off = F.lit(False)
    inner = F.flatten(F.transform(block, lambda t, i: F.array(piece(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), off), piece(escape(t["text"]), role == LOSS_ROLE))))
    return F.concat(F.array(piece(F.concat(F.lit(OPEN), escape(role), F.lit(TEXT)), off)), inner, F.array(piece(F.lit(CLOSE), off)))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_spans)`` from ``(conv_id, turn, role, text)``, one row per conversation.

    Turns are ordered by turn number (null first), ties by role and text. ``loss_spans`` are the places and lengths, in
    bytes of ``formatted`` as UTF-8, of the text under the loss mask: assistant texts alone, in order. Null roles and texts count as
    empty; rows with a null conv_id form one conversation; repeated rows are turns of their own; an empty table gives
    an empty result; other columns are not read. A conversation is one row of the result, so its turns meet in one
    task; everything after that is linear in its length.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(F.transform(_blocks(F.col("turns")), _segments))
    pieces = grouped.select("conv_id", segments.alias("segments"))
    lengths = F.transform("segments", lambda s: F.octet_length(s["text"]))
    spans = let(starts_of(lengths), lambda at: F.transform("segments", lambda s, i: F.struct(F.get(at, i).alias("start"), F.octet_length(s["text"]).alias("length"), s["loss"].alias("loss"))))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: s.dropFields("loss"))
    return pieces.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def starts_of(lengths: Column) -> Column:
    """Where each of consecutive pieces starts: sums within blocks, then over blocks, so that no long array is copied per piece."""

    def summed(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["starts"], F.array(a["total"])).alias("starts")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: summed(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    return let(blocks, lambda bs: let(summed(F.transform(bs, lambda b: b["total"]))["starts"], lambda before: F.flatten(F.transform(bs, lambda b, k: F.transform(b["starts"], lambda x: x + F.get(before, k))))))


def read_back(formatted: Column) -> Column:
    """Turns ``array<struct<role, text>>`` of a formatted text, unescaped, merged turns apart again."""
    blocks = F.slice(F.split(formatted, r"\[END\]</s>"), 1, F.size(F.split(formatted, r"\[END\]</s>")) - 1)

    def turns_of(block: Column) -> Column:
        def parts(p: Column) -> Column:
            role = unescape(F.substring(F.get(p, F.lit(0)), len(OPEN) + 1, 1 << 30))
            return F.transform(F.split(F.get(p, F.lit(1)), r"\[NEXT\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

        return let(F.split(block, r"\[TEXT\]", 2), parts)

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, cut from the formatted text, unescaped, nothing between."""
    cut = let(formatted.cast("binary"), lambda raw: F.transform(loss_spans, lambda s: unescape(F.decode(F.substring(raw, s["start"] + 1, s["length"]), "UTF-8"))))
    return F.array_join(cut, "")
