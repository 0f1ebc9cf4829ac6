"""Source divergence audit: which terms set a source apart from its language, and how far sources lie from each other."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import as_bytes, materialize, scratch, text_slices

#: A language keeps the terms that stand in at least so many of its documents; a group reports so many of them.
MIN_DOCS, TOP = 10, 10
#: Probabilities are whole numbers of this unit; every count is raised by ``PSEUDO``.
UNIT, PSEUDO = 1_000_000_000, 2
#: Distinct terms of all groups that a task counts before it hands its partial counts on.
HELD_TERMS = 200_000
#: Count buckets per doubling of the count; smaller counts have a bucket each.
_STEPS = 8
#: Terms over UTF-8 bytes: letters, lower-cased in A-Z only, and everything beyond ASCII; all else separates.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """All terms of one text in UTF-8, in order."""
    return text.translate(_LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task partial ``(lang, source, term, n, docs)``; handed on whenever ``HELD_TERMS`` are held."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string())]
            counts = [pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + counts, names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        for part in text_slices(batch, "text"):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), as_bytes(part.column("text"))):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                before, terms = len(n), terms_of(text)
                n.update(terms)
                docs.update(set(terms))
                held += len(n) - before
                if held > HELD_TERMS:
                    yield from handed()
                    held = 0
    yield from handed()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term in a group and documents of the group that have it.

    One scan; tasks hand on partial sums, so a common term or a large group is added up before it is shuffled. Dealt by
    ``(lang, term)``, so that what follows per language and term needs no other exchange.
    """
    rows = _named(docs, lang_col, source_col, text_col).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def kept_postings(docs: DataFrame, min_docs: int = MIN_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, lang_n, foremost)`` of the terms that a language keeps; ``foremost`` marks one row per language and term."""
    counts = term_counts(docs, lang_col, source_col, text_col)
    of_term = Window.partitionBy("lang", "term")
    rows = counts.select("*", F.sum("docs").over(of_term).alias("lang_docs"), F.sum("n").over(of_term).alias("lang_n"), F.min("source").over(of_term).alias("first_source"))
    return rows.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("first_source")).alias("foremost"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """Smoothed probability as a whole number of ``UNIT``, exact: null where a language keeps no term."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + PSEUDO).cast("decimal(19,0)")
    return 1 + F.call_function("div", above, F.nullif((total + PSEUDO * kept).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))


def gap(p: Column, q: Column) -> Column:
    """Divergence of one term, exact in 64 bits: both sides are at most ``UNIT`` + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _bucket(n: Column) -> Column:
    """Count bucket: counts under ``_STEPS`` alone, larger ones by doubling and its eighth."""
    halvings = F.greatest(F.floor(F.log2(n.cast("double"))) - 3, F.lit(0)).cast("int")
    return F.struct(halvings.alias("halvings"), F.floor(n / F.pow(F.lit(2.0), halvings)).cast("long").alias("step"))


def divergent_terms(postings: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """``(lang, source, item, value, rank)``: the terms a group uses more than its language, by divergence.

    Terms of a group lie in buckets of like counts. The largest probability in a bucket against the smallest of the
    language bounds the divergence of all its terms, as the divergence grows with the first and falls with the second.
    Buckets are taken best bound first: those that hold the first ``top`` terms between them give a k-th value, and all
    others whose bound is not strictly below it are evaluated too; the rest are never evaluated. A bucket's terms are
    ranked over all tasks by Spark's own group limit, so no group is one task's before it is down to a few rows a task.
    """
    rows = postings.join(groups, ["lang", "source"]).select("lang", "source", "term", _bucket(F.col("n")).alias("bucket"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    rows = rows.where("p > q")
    bounds = rows.groupBy("lang", "source", "bucket").agg(gap(F.max("p"), F.min("q")).alias("bound"), F.count("*").alias("terms"))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    bounds = materialize(bounds.withColumn("before", F.sum("terms").over(best_first) - F.col("terms")), "bounds")
    key = ["lang", "source", "bucket"]
    first = ranked(rows.join(bounds.where(F.col("before") < top).select(*key), key), top)
    kth = first.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
    open_ = bounds.join(kth, ["lang", "source"], "left").where(F.col("bound") >= F.coalesce("kth", F.lit(0))).select(*key)
    return ranked(rows.join(open_, key), top)


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of each group by value, then name."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    valued = rows.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def divergent_pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value, rank)``: divergence of every two sources of a language over all kept terms.

    The sum is taken apart by postings. As if neither source had any term: kept terms times one constant. What the terms
    of one source alone add against the bare other: a sum over the distinct counts of a source, few whatever the
    vocabulary. What a term that both have changes about that: from the postings of the term, summed per pair of sources in
    the task that joins them. Every part is a whole number, so the sum is exact.
    """
    bare = share(F.lit(0), F.col("total"), F.col("kept"))
    sides = groups.select("lang", "source", "total", "kept", bare.alias("bare"))
    one, two = (sides.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "bare")], "total", "kept").withColumnsRenamed({"total": f"total_{s}", "kept": f"kept_{s}"}) for s in ("a", "b"))
    both = one.join(two, "lang").where("source_a < source_b")
    key = ["lang", "source_a", "source_b"]
    base = both.select(*key, F.coalesce(F.col("kept_a") * gap(F.col("bare_a"), F.col("bare_b")), F.lit(0)).alias("value"))
    counts = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(sides, ["lang", "source"])
    counts = counts.select("lang", "source", "terms", "bare", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    other = sides.select("lang", F.col("source").alias("other"), F.col("bare").alias("other_bare"))
    alone = counts.join(other, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * (gap(F.col("p"), F.col("other_bare")) - gap(F.col("bare"), F.col("other_bare")))).alias("value"))
    alone = alone.select("lang", F.least("source", "other").alias("source_a"), F.greatest("source", "other").alias("source_b"), "value")
    held = postings.join(sides, ["lang", "source"]).select("lang", "term", "source", "bare", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    held = held.repartition("lang", "term")
    left, right = (held.select("lang", "term", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "bare", "p")]) for s in ("a", "b"))
    met = left.join(right, ["lang", "term"]).where("source_a < source_b")
    shared = met.groupBy(*key).agg(F.sum(gap(F.col("p_a"), F.col("p_b")) - gap(F.col("p_a"), F.col("bare_b")) - gap(F.col("bare_a"), F.col("p_b")) + gap(F.col("bare_a"), F.col("bare_b"))).alias("value"))
    sums = base.unionByName(alone).unionByName(shared).groupBy(*key).agg(F.sum("value").alias("value"))
    sums = materialize(sums, "pairs")
    rows = sums.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").union(sums.select("lang", "source_b", "source_a", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)`` over all of ``docs``.

    Part ``pair``: every other source of the language and its divergence, all ranks. Part ``term``: the kept terms that the
    group uses more than its language, ranks to ``top``.

    Null text, language and source count as empty; the empty language is one, and so is the empty source. A group without
    terms has a row for each other source, and no terms. Where a language keeps no term, pairs have value 0. Repeated rows
    count one by one; ties go by item in UTF-8 order; texts of any length are read whole, in slices of a batch; an empty
    table gives an empty result. Other columns are not read.
    """
    with scratch() as tables:
        postings = materialize(kept_postings(docs, min_docs, lang_col, source_col, text_col), "postings")
        langs = postings.groupBy("lang").agg(F.count_if("foremost").alias("kept"), F.sum("n").alias("lang_total"))
        totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        named = _named(docs, lang_col, source_col, text_col).select("lang", "source").distinct()
        groups = named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = materialize(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kept", "lang_total")]), "groups")
        parts = [divergent_pairs(postings, groups).withColumn("part", F.lit("pair")), divergent_terms(postings, groups, top).withColumn("part", F.lit("term"))]
        return tables.keep(parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank"), "divergence")
