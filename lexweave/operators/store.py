"""The graph as tables, and the primitives that every service is made of."""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.numbers import ancestors_and_self, article_id, law_of, number_key, number_of


def flatten_articles(laws: DataFrame) -> DataFrame:
    """Provisions of nested laws, a row each, with sort key and ancestors."""
    return with_keys(laws.select("law_id", F.inline("articles")))


def with_keys(articles: DataFrame) -> DataFrame:
    """``articles`` with ``number_key`` and ``ancestor_ids`` (the provision itself first)."""
    up = F.transform(ancestors_and_self("number"), lambda n: article_id("law_id", n))
    return articles.withColumn("number_key", number_key("number")).withColumn("ancestor_ids", up)


@dataclass(frozen=True)
class GraphStore:
    """Immutable tables; every method is a lazy plan over them."""

    laws: DataFrame
    articles: DataFrame
    refs: DataFrame
    similar: DataFrame | None = None
    relations: DataFrame | None = None
    amendments: DataFrame | None = None
    drafts: DataFrame | None = None
    intl_sources: DataFrame | None = None
    intl_links: DataFrame | None = None
    dataset: str = "real"
    backend: str = "spark"
    #: Number of buckets of laws that ``articles`` lies in, in a column ``law_bucket``; 0 where it does not.
    law_buckets: int = 0

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if isinstance(v, DataFrame)}

    def laws_with_counts(self) -> DataFrame:
        """Every law with its number of provisions, zero included."""
        counts = self.articles.groupBy("law_id").agg(F.count("*").alias("article_count"))
        return self.laws.join(counts, "law_id", "left").withColumn("article_count", F.coalesce("article_count", F.lit(0)))

    def law(self, law_id: str) -> DataFrame:
        return self.laws_with_counts().where(F.col("law_id") == law_id)

    def _of_law(self, law_id: str) -> Column:
        """Condition for the provisions of a law; where they lie in buckets, the one bucket's files are all that is read."""
        own = F.col("law_id") == law_id
        return own & (F.col("law_bucket") == crc32(law_id.encode()) % self.law_buckets) if self.law_buckets else own

    def in_law(self, law_id: str) -> DataFrame:
        """The provisions of a law, in no order."""
        return self.articles.where(self._of_law(law_id))

    def articles_of(self, law_id: str) -> DataFrame:
        return self.in_law(law_id).orderBy("number_key", "article_id")

    def article(self, id_: str) -> DataFrame:
        """Provision by id; the law is part of the id and is filtered on too, so a clustered scan can skip files."""
        return self.articles.where(self._of_law(id_.partition(":")[0]) & (F.col("article_id") == id_))

    def articles_by_id(self, ids: DataFrame) -> DataFrame:
        return self.articles.join(ids.select("article_id").distinct(), "article_id", "left_semi")

    def refs_with_source(self) -> DataFrame:
        return self.refs.withColumn("from_law_id", law_of("from_article_id")).withColumn("from_number", number_of("from_article_id"))

    def refs_to(self, law_id: str, ids: DataFrame, prefixes: DataFrame | None, law_level: bool) -> DataFrame:
        """Citations of the listed provisions of the law, plus missing targets of the law under any prefix (``None``: all, an
        empty table: none), plus citations of the whole law. A bag: the three parts do not meet."""
        refs = self.refs_with_source()
        listed = refs.where(F.startswith("to_article_id", F.lit(f"{law_id}:"))).join(ids.select(F.col("article_id").alias("to_article_id")).distinct(), "to_article_id", "left_semi").select(*refs.columns)
        missing = refs.where((F.col("to_law_id") == law_id) & F.col("target_missing") & F.col("to_number").isNotNull())
        if prefixes is not None:  # the number or one of its ancestors is a prefix: an equi-join, not a LIKE
            missing = missing.withColumn("__row", F.monotonically_increasing_id()).withColumn("__up", F.explode(ancestors_and_self("to_number")))
            missing = missing.join(prefixes.select(F.col("number").alias("__up")).distinct(), "__up", "left_semi").dropDuplicates(["__row"]).select(*refs.columns)
        out = listed.unionByName(missing)
        if law_level:
            out = out.unionByName(refs.where((F.col("to_law_id") == law_id) & F.col("to_number").isNull()))
        return out

    def refs_from(self, ids: DataFrame) -> DataFrame:
        refs = self.refs_with_source()
        return refs.join(ids.select(F.col("article_id").alias("from_article_id")).distinct(), "from_article_id", "left_semi").select(*refs.columns)

    def _incident(self, edges: DataFrame, ids: DataFrame) -> DataFrame:
        """Undirected edges at any of the ids, each once, with both ends named mine and other."""
        own = ids.select("article_id").distinct().withColumn("in_a", F.lit(True))
        a = own.withColumnRenamed("article_id", "a_article_id")
        b = own.withColumnRenamed("article_id", "b_article_id").withColumnRenamed("in_a", "in_b")
        met = edges.join(a, "a_article_id", "left").join(b, "b_article_id", "left").where("in_a OR in_b")
        mine = F.when(F.col("in_a"), F.col("a_article_id")).otherwise(F.col("b_article_id"))
        other = F.when(F.col("in_a"), F.col("b_article_id")).otherwise(F.col("a_article_id"))
        return met.select(*edges.columns, mine.alias("mine"), other.alias("other"), (F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("inside"))

    def similar_at(self, ids: DataFrame) -> DataFrame:
        return self._incident(self.similar, ids)

    def relations_at(self, ids: DataFrame) -> DataFrame:
        return self._incident(self.relations, ids)

    def intl_links_at(self, ids: DataFrame) -> DataFrame:
        links = self.intl_links.join(ids.select("article_id").distinct(), "article_id", "left_semi")
        return links.join(self.intl_sources, "source_id")

    def amendments_at(self, ids: DataFrame) -> DataFrame:
        return self.amendments.join(ids.select("article_id").distinct(), "article_id", "left_semi").orderBy("article_id", "suggested_text")

    def draft(self, draft_id: str) -> DataFrame:
        return self.drafts.where(F.col("draft_id") == draft_id)

    def subtree(self, id_: str) -> DataFrame:
        """A provision and all below it."""
        return self.articles.where(self._of_law(id_.partition(":")[0]) & F.array_contains("ancestor_ids", id_))
