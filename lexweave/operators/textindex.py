"""A stored inverted index over texts: terms sorted and cut into ranges, postings, and an index of deletions for fuzzy terms.

Texts are tokenised once, when the index is built. A query reads the shards whose range of terms it asks for: exact terms,
the terms that open with a prefix, and the terms within an edit distance, which meet in a common string of deletions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T

#: Postings of a shard, about. Letters of a term that deletions are taken from, and the largest edit distance they serve:
#: the first letters of two terms within a distance have a string of at most as many deletions in common.
SHARD_ROWS, DELETION_LETTERS, MOST_EDITS = 1 << 20, 8, 2
#: Terms that one fuzzy or prefix lookup may put into a plan as literals; beyond, they are joined.
LITERAL_TERMS = 200
#: Tasks that texts are dealt to, for each of a shuffle: counted words take more room than their text.
SPREAD = 4
BM25_K1, BM25_B = 1.2, 0.75


def _without_letter(strings: Column) -> Column:
    """All strings of the array with any one letter left out, and the strings themselves."""
    shorter = F.transform(strings, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))
    return F.array_distinct(F.concat(strings, F.flatten(shorter)))


def deletions(term: Column, edits: int = MOST_EDITS) -> Column:
    """Strings that are left of a term's first letters when up to ``edits`` of them are deleted."""
    out = F.array(F.substring(term, 1, DELETION_LETTERS))
    for _ in range(edits):
        out = _without_letter(out)
    return out


def deletions_of(term: str, edits: int = MOST_EDITS) -> list[str]:
    """The same for one term of a query."""
    head = term[:DELETION_LETTERS]
    return sorted({"".join(head[i] for i in kept) for n in range(max(0, len(head) - edits), len(head) + 1) for kept in combinations(range(len(head)), n)})


def _sharded(rows: DataFrame, cuts: list[str], order: list[str], shards: int, path: str) -> None:
    """``rows`` cut into ranges of ``cuts``, a folder each, sorted by ``order``; and which keys, the first of both, are where. The
    rows of one key may fill several shards, those of equal ``cuts`` fill one."""
    key = order[0]
    dealt = rows.repartitionByRange(shards, *cuts).sortWithinPartitions(*order).drop("part").withColumn("shard", F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)
    kept = rows.sparkSession.read.parquet(path)
    kept.groupBy("shard").agg(F.min(key).alias("low"), F.max(key).alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{path}.ranges")


def build_index(texts: DataFrame, folder: str, stemmed: bool = False, shard_rows: int = SHARD_ROWS) -> TextIndex:
    """The index of ``(id, text)`` in ``folder``; what was there is replaced. Ids are unique.

    ``stemmed``: terms are stems instead of tokens. Null and empty texts have no postings but count as documents of size 0.
    """
    spark = texts.sparkSession
    words = (T.stems if stemmed else T.tokens)(F.coalesce("text", F.lit("")))
    tasks = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = texts.select("id", "text").repartition(tasks, "id")  # texts cross as they are; their words are counted where they stand
    listed = whole.select("id", words.alias("words")).select("id", F.size("words").alias("size"), F.explode_outer("words").alias("term"))
    counted = listed.groupBy("id", "term", "size").agg(F.count("term").alias("tf"))
    counted.write.mode("overwrite").parquet(f"{folder}/counted")  # texts are tokenised once
    counted = spark.read.parquet(f"{folder}/counted")
    rows, n = counted.where("term IS NOT NULL"), counted.count()
    shards = max(1, -(-n // shard_rows))
    rows.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    # only a term of more postings than a shard holds is cut, into parts by id: such terms are fewer than shards
    large = terms.where(F.col("df") > shard_rows).select("term", F.ceil(F.col("df") / shard_rows).alias("parts"))
    parted = rows.join(F.broadcast(large), "term", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0)))
    _sharded(parted.select("term", "part", "id", F.col("tf").cast("int").alias("tf"), "size"), ["term", "part"], ["term", "id"], shards, f"{folder}/postings")
    _sharded(terms.select("term", "df", F.explode(deletions(F.col("term"))).alias("variant")), ["variant", "term"], ["variant", "term"], shards, f"{folder}/deletions")
    sizes = counted.groupBy("id").agg(F.max("size").alias("size"))
    sizes.agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    return TextIndex(spark, folder)


@dataclass(frozen=True)
class TextIndex:
    """An index that ``build_index`` has written."""

    spark: SparkSession
    folder: str

    @cached_property
    def _ranges(self) -> dict[str, list[tuple[int, str, str]]]:
        """Which terms are in which shard: a row per shard."""
        return {t: [(r.shard, r.low, r.high) for r in self.spark.read.parquet(f"{self.folder}/{t}.ranges").collect()] for t in ("postings", "deletions")}

    def _read(self, table: str, ranges: list[tuple[str, str]]) -> DataFrame:
        """The shards of a table that meet any of the ranges ``(first, last)``, both included."""
        wanted = sorted({s for s, low, high in self._ranges[table] if any(low <= last and first <= high for first, last in ranges)})
        return self.spark.read.parquet(f"{self.folder}/{table}").where(F.col("shard").isin(*wanted) if wanted else F.lit(False)).drop("shard")

    def postings_of(self, terms: list[str]) -> DataFrame:
        """``(term, id, tf, size)`` of the listed terms."""
        return self._read("postings", [(t, t) for t in terms]).where(F.col("term").isin(*terms) if terms else F.lit(False))

    def postings_from(self, prefix: str) -> DataFrame:
        """Postings of all terms that open with ``prefix``."""
        return self._read("postings", [(prefix, prefix + chr(0x10FFFF))]).where(F.startswith("term", F.lit(prefix)))

    def like(self, word: str, edits: int) -> DataFrame:
        """``(term, df)``: the terms within ``edits`` of a word, by common deletions, then by the distance itself."""
        if not 0 <= edits <= MOST_EDITS:
            raise ValueError(f"an edit distance of 0 to {MOST_EDITS} is served")
        variants = deletions_of(word, edits)
        rows = self._read("deletions", [(v, v) for v in variants]).where(F.col("variant").isin(*variants)).select("term", "df").distinct()
        return rows.where(F.levenshtein("term", F.lit(word)) <= edits)

    def matching(self, word: str, edits: int = 0) -> DataFrame:
        """Postings of a word and, with ``edits``, of the terms like it."""
        if not edits:
            return self.postings_of([word])
        found = self.like(word, edits)
        terms = [r.term for r in found.limit(LITERAL_TERMS + 1).collect()]
        if len(terms) <= LITERAL_TERMS:
            return self.postings_of(terms)
        return self.spark.read.parquet(f"{self.folder}/postings").drop("shard").join(found.select("term"), "term", "left_semi")

    def opening(self, word: str, least: int = 4) -> DataFrame:
        """Postings of the terms that open with ``word``, and of those of ``least`` letters or more that ``word`` opens with."""
        shorter = [word[:n] for n in range(least, len(word))]
        rows = self.postings_from(word)
        return rows.unionByName(self.postings_of(shorter)) if shorter else rows

    def full_text(self, words: list[str], edits: int = 0, limit: int | None = 10) -> DataFrame:
        """``(id, score)`` by BM25, best first; with ``edits`` the terms like a word count as the word. ``limit`` is a report's."""
        hits = None
        for word in dict.fromkeys(words):
            part = self.matching(word, edits).groupBy("id", "size").agg(F.sum("tf").alias("tf")).withColumn("word", F.lit(word))
            hits = part if hits is None else hits.unionByName(part)
        if hits is None:
            return self.spark.createDataFrame([], "id long, score double")
        stats = self.spark.read.parquet(f"{self.folder}/stats").first()
        df = hits.groupBy("word").agg(F.count("*").alias("df"))  # a row per word of the query
        idf = F.log(1 + (F.lit(stats.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("size") / F.lit(stats.mean)))
        scored = hits.join(F.broadcast(df), "word").groupBy("id").agg(F.sum(weight).alias("score")).orderBy(F.desc("score"), "id")
        return scored.limit(limit) if limit is not None else scored
