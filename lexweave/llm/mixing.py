"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cut, epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import WORD, materialize, quoted

#: Hex digits of the random key that name a range; 16 ** 3 ranges per source.
RANGE_DIGITS = 3
_IN = "__mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: Column, seed: int) -> Column:
    """Uniform in 128 bits and the same on every run: MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Target of every source from ``(source key, source_size)``, one row per source.

    Sources in order of their key take the weights in turn. All targets together are ``share`` times all sizes; a
    target stops at ``max_epochs`` times its source's size and the excess is shared again by weight until none is
    above: the level at which this ends is found in one pass over the sources in order of size per weight. The one
    window without partitions sees a row per source.
    """
    order = Window.orderBy("skey")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    rows = rows.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
    level = F.min_by(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("skey")))).over(whole)
    return rows.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))).select("skey", "source_size", "target")


def _placed(docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float, id_col: str, source_col: str, text_col: str, seed: int, carry: bool) -> DataFrame:
    """``(id, size, source_size, target, taken)`` per row of ``docs`` and, if ``carry``, the row itself as a struct."""
    source, id_ = docs[quoted(source_col)], docs[quoted(id_col)]
    skey = F.when(source.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), source))
    key = random_key(id_, seed)
    lean = docs.select(id_.alias("id"), skey.alias("skey"), F.substring(key, 1, RANGE_DIGITS).alias("range"), key.alias("key"), word_count(docs[quoted(text_col)]).alias("size"), *([F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row")] if carry else []))
    sizes = lean.select("id", "skey", "range", "key", "size")
    sizes = materialize(sizes, "sizes")  # words are counted once
    if not carry:
        lean = sizes
    ranges = sizes.groupBy("skey", "range").agg(F.sum("size").alias("range_size"))
    by_range = Window.partitionBy("skey").orderBy("range")
    ranges = ranges.withColumn("range_before", F.sum("range_size").over(by_range) - F.col("range_size"))
    targets = source_targets(ranges.groupBy("skey").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    offsets = ranges.join(targets, "skey").select("skey", "range", "range_before", "source_size", "target")
    placed = lean.join(offsets, ["skey", "range"])
    within = Window.partitionBy("skey", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("before", F.col("range_before") + F.sum("size").over(within) - F.col("size"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS LONG) DIV source_size")).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("left", budget - epochs * F.col("source_size"))
    taken = F.col("epochs") * F.col("size") + F.least("size", F.greatest(F.lit(0).cast("long"), F.col("left") - F.col("before")))
    return placed.select("id", "size", "source_size", "target", taken.alias("taken"), *(["row"] if carry else []))


def _row(docs: DataFrame, besides: Sequence[str] = ()) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, but for those named."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in besides]


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, carry: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``__mix_size``, ``__mix_source_size``, ``__mix_target`` and ``__mix_taken``.

    Within a source the rows are ordered by a hash-random key. The first digits of the key name a range; word counts
    are summed per range, the ranges' prefix sums are taken over at most 16 ** 3 rows per source, and a second
    window sums within each range: no task sees a source. A source's budget is its target rounded down: whole
    epochs of all its rows, then rows in order up to the exact word, so the last row may be taken in part.
    ``carry=False`` leaves out the columns of ``docs`` other than the id.

    A null text has size zero and is never taken; null sources are one source, last in order; a null id is ordered
    by the key of an empty id; repeated rows are counted one by one; an empty table gives an empty result. A column of
    ``docs`` that has the name of one of the four is replaced by it.
    """
    placed = _placed(docs, weights, share, max_epochs, id_col, source_col, text_col, seed, carry)
    marks = {f"{_IN}_{c}": c for c in ("size", "source_size", "target", "taken")}
    return placed.select(*(_row(docs, tuple(marks)) if carry else [F.col("id").alias(id_col)]), *[F.col(c).alias(name) for name, c in marks.items()])


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row per epoch of a document, the last one cut to its words.

    A text cut in part keeps its first words and the white space before them. Null texts and texts without words are
    never taken; null sources, null ids, repeated rows and empty tables are as in ``mix``; columns of any name are carried.
    """
    rows = _placed(docs, weights, share, max_epochs, id_col, source_col, text_col, seed, True).where("taken > 0")
    rows = rows.withColumn("part", F.explode(F.expr("transform(sequence(1L, CAST(ceil(taken / size) AS LONG)), i -> least(size, taken - (i - 1) * size))")))
    text = F.col("row").getField(text_col)
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")
    whole = F.when(F.col("part") == F.col("size"), text).otherwise(cut)
    return rows.select(*[whole.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
