"""Queries over the exploration graph: structure, mentions, citations, amendments, norms. One table per list of a parsed
law; every query is a plan over these tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.numbers import number_key
from lexweave.functions.text import modality, stems
from lexweave.operators.extract import extract_terms
from lexweave.operators.phrases import phrase_matches
from lexweave.operators.relational import collected, having_all
from lexweave.operators.similarity import centroids, lexical_rows, neighbour_edges, topic_names
from lexweave.operators.similarity import topics as find_topics
from lexweave.operators.structure import current_provisions, extract_links, next_articles
from lexweave.operators.traverse import paths

#: Relations of a norm to its bearer, by kind of norm; fixed values.
NORM_EDGES = {"right": "HAS_RIGHT", "duty": "HAS_DUTY", "prohibition": "IS_PROHIBITED", "power": "HAS_POWER", "liability": "IS_LIABLE"}


@dataclass(frozen=True)
class Exploration:
    """``provisions(law_id, id, number, article, parent, text, status, modality)``, ``mentions(law_id, from_id, to_id)``,
    ``refs(law_id, from_id, to_id, role)`` and so on; ids are local to a law."""

    chapters: DataFrame
    sections: DataFrame
    articles: DataFrame
    provisions: DataFrame
    refs: DataFrame
    amendments: DataFrame
    external: DataFrame | None = None
    mentions: DataFrame | None = None
    terms: DataFrame | None = None
    actors: DataFrame | None = None
    norms: DataFrame | None = None
    topics: DataFrame | None = None
    similar: DataFrame | None = None


def load(parsed: DataFrame, actors: DataFrame | None = None, norms: DataFrame | None = None, vectors: DataFrame | None = None, topic_count: int = 30) -> Exploration:
    """All tables of parsed laws (see ``structure.parse_structure``).

    Terms are those that a law defines, mentions the provisions that name a term of their law or one of ``actors(id, name,
    category, phrase)`` in any case of its last word, the longest first; what defines a term does not mention it. ``norms``
    come from outside. Similar provisions and topics of articles are found on ``vectors(law_id, id, vec)``, else on lexical
    ones. The chain of articles is ``article_chain``.
    """
    spark = parsed.sparkSession
    provisions = current_provisions(parsed).withColumn("modality", modality("text"))
    articles = parsed.select("law_id", F.inline("articles"))
    links = extract_links(provisions, articles)
    refs = links.where("kind = 'ref'").select("law_id", "from_id", F.col("target").alias("to_id"), "raw_text", F.lit(None).cast("string").alias("role"))
    terms = extract_terms(provisions).select("law_id", F.concat(F.lit("term:"), "name").alias("id"), "name", "definition", "defined_in")
    if actors is None:
        actors = spark.createDataFrame([], "id string, name string, category string, phrase string")
    texts = provisions.select("law_id", "id", "text")
    named = phrase_matches(texts, terms.select("law_id", F.col("id").alias("name"), F.col("name").alias("phrase")), True, ("law_id",)).join(terms.select("law_id", F.col("defined_in").alias("id")).distinct(), ["law_id", "id"], "left_anti")
    everywhere = phrase_matches(texts.withColumn("id", F.concat("law_id", F.lit("\u0001"), "id")), actors.select(F.col("id").alias("name"), "phrase"), True)
    everywhere = everywhere.select(F.substring_index("id", "\u0001", 1).alias("law_id"), F.substring_index("id", "\u0001", -1).alias("id"), "name")
    mentions = named.select("law_id", "id", "name").unionByName(everywhere).select("law_id", F.col("id").alias("from_id"), F.col("name").alias("to_id")).distinct()
    if vectors is None:
        rows = provisions.where("text <> ''").select(F.struct("law_id", "id").alias("id"), F.col("article").alias("group"), "text")
        vectors = lexical_rows(rows.withColumn("id", F.to_json("id"))).select(F.from_json("id", "law_id STRING, id STRING").alias("o"), "vec").select("o.*", "vec")
    placed = provisions.select("law_id", "id", "article").join(vectors, ["law_id", "id"])
    whole = placed.select(F.to_json(F.struct("law_id", "id")).alias("id"), F.concat_ws(" ", "law_id", "article").alias("group"), "vec")
    pair = lambda c: F.from_json(c, "law_id STRING, id STRING")
    near = neighbour_edges(whole).select(pair("a").alias("a"), pair("b").alias("b"), "score").where("a.law_id = b.law_id")
    similar = near.select("a.law_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "score")
    middle = centroids(placed.select(F.to_json(F.struct("law_id", F.col("article").alias("id"))).alias("group"), "vec")).withColumnRenamed("group", "id")
    assigned = find_topics(middle, topic_count)
    words = placed.select("law_id", "id", F.col("article").alias("art")).join(provisions.select("law_id", "id", F.explode(stems("text")).alias("word")), ["law_id", "id"])
    words = words.where(F.length("word") > 2).select(F.to_json(F.struct("law_id", F.col("art").alias("id"))).alias("id"), "word")
    sizes = assigned.groupBy("topic").agg(F.count("*").alias("size"))
    topics = assigned.join(topic_names(assigned, words), "topic").join(sizes, "topic").select("topic", "name", F.col("size").cast("int").alias("size"), pair("id").alias("o")).select("topic", "name", "size", "o.law_id", F.col("o.id").alias("article"))
    if norms is None:
        norms = spark.createDataFrame([], "law_id string, id string, kind string, bearer string, towards string, action string, condition string")
    return Exploration(
        chapters=parsed.select("law_id", F.inline("chapters")), sections=parsed.select("law_id", F.inline("sections")), articles=articles, provisions=provisions, refs=refs,
        amendments=parsed.select("law_id", F.inline("amendments")), external=links.where("kind = 'law'"), mentions=mentions, terms=terms, actors=actors.select("id", "name", "category"), norms=norms, topics=topics, similar=similar,
    )


def nodes(x: Exploration) -> DataFrame:
    """All addressable nodes ``(law_id, id, label, number, title, text)`` for queries whose target may be of any kind."""
    null = lambda c: F.lit(None).cast("string").alias(c)
    a = x.articles.select("law_id", "id", F.lit("Article").alias("label"), "number", "title", "text")
    p = x.provisions.select("law_id", "id", F.lit("Provision").alias("label"), "number", null("title"), "text")
    c = x.chapters.select("law_id", "id", F.lit("Chapter").alias("label"), F.col("number").cast("string").alias("number"), "title", null("text"))
    return a.unionByName(p).unionByName(c)


def _by_number(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` ordered by columns and ``key``, the key of their number: a column first, as a sort evaluates an expression
    anew at each comparison."""
    return rows.withColumn("key", number_key("number")).orderBy(*order).drop("key")


def chapter_sizes(x: Exploration, law: str) -> DataFrame:
    """1: articles per chapter, directly or in a section."""
    through = x.sections.select("law_id", F.col("id").alias("chapter"), F.col("chapter").alias("upper"))
    a = x.articles.where(F.col("law_id") == law).join(through, ["law_id", "chapter"], "left").withColumn("in_chapter", F.coalesce("upper", "chapter"))
    counts = a.groupBy("in_chapter").agg(F.count("*").alias("articles"))
    return x.chapters.where(F.col("law_id") == law).join(counts, F.col("id") == F.col("in_chapter")).select("number", "title", "articles").orderBy("number")


def article_tree(x: Exploration, law: str, article: str) -> DataFrame:
    """2: everything in an article."""
    return _by_number(x.provisions.where((F.col("law_id") == law) & (F.col("article") == article)), "key")


def _mentioning(x: Exploration, target: str) -> DataFrame:
    who = x.mentions.where(F.col("to_id") == target).select("law_id", F.col("from_id").alias("id")).distinct()
    return x.provisions.join(who, ["law_id", "id"], "left_semi")


def provisions_that(x: Exploration, kind: str, target: str, limit: int | None = None) -> DataFrame:
    """3, 4: provisions of a modality that mention a term, by number; 4 reports the first 25."""
    rows = _mentioning(x, target).where(F.array_contains("modality", kind)).select("number", "text").withColumn("key", number_key("number")).orderBy("key", "number")
    return (rows.limit(limit) if limit else rows).drop("key")


def term_usage(x: Exploration) -> DataFrame:
    """5: definitions and how often each term is mentioned, zero included."""
    counts = x.mentions.groupBy("law_id", F.col("to_id").alias("id")).agg(F.count("*").alias("mentioned"))
    return x.terms.join(counts, ["law_id", "id"], "left").select("name", "defined_in", F.coalesce("mentioned", F.lit(0)).alias("mentioned"), "definition").orderBy(F.desc("mentioned"), "name")


def most_cited(x: Exploration, limit: int = 10) -> DataFrame:
    """6: the most cited targets of any kind; a report of the first ``limit``."""
    counts = x.refs.groupBy("law_id", F.col("to_id").alias("id")).agg(F.count("*").alias("cited"))
    rows = counts.join(nodes(x), ["law_id", "id"]).select(F.coalesce("number", "title").alias("target"), "label", "cited", number_key("number").alias("key"))
    return rows.orderBy(F.desc("cited"), "label", "key", "target").limit(limit).drop("key")


def citation_paths(x: Exploration, law: str, start: str, length: int = 3) -> DataFrame:
    """7: chains of citations from a provision."""
    edges = x.refs.where(F.col("law_id") == law).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return paths(edges, x.refs.sparkSession.range(1).select(F.lit(start).alias("id")), length)


def history(x: Exploration) -> DataFrame:
    """8: what was amended when and how: the numbers of the provisions, in order."""
    numbered = x.amendments.join(nodes(x).select("law_id", F.col("id").alias("target"), "number"), ["law_id", "target"])
    rows = numbered.withColumn("key", number_key("number"))
    return collected(rows, ["date", "type"], "number", ["key", "number"]).orderBy("date", "type")


def repealed(x: Exploration) -> DataFrame:
    """9."""
    return x.provisions.where(F.col("status") == "хүчингүй").select("number", "text")


def external_laws(x: Exploration) -> DataFrame:
    """10: other laws that are cited, how often and where."""
    return collected(x.external.select("law_id", "target", "from_id").distinct(), ["target"], "from_id", ["from_id"]).orderBy(F.desc("n"), "target")


def category_mentions(x: Exploration, category: str, limit: int = 10) -> DataFrame:
    """11: actors of a category, how often they are mentioned, and some places."""
    who = x.actors.where(F.col("category") == category).select(F.col("id").alias("to_id"), "name")
    rows = x.mentions.join(who, "to_id")
    return collected(rows, ["name"], "from_id", ["from_id"], limit).orderBy(F.desc("n"), "name")


def co_mentions(x: Exploration, targets: list[str]) -> DataFrame:
    """12: provisions that mention all targets."""
    keyed = x.mentions.withColumn("key", F.struct("law_id", F.col("from_id").alias("id")))
    both = having_all(keyed, "key", "to_id", targets).select("key.law_id", "key.id")
    return x.provisions.join(both, ["law_id", "id"], "left_semi").select("number", "text")


def retrieval_context(x: Exploration, hits: DataFrame) -> DataFrame:
    """14: for found provisions ``(law_id, id, score)`` their article, their parent's text and what they cite."""
    p = x.provisions.select("law_id", "id", "number", "article", "parent", "text")
    parent = x.provisions.select("law_id", F.col("id").alias("parent"), F.col("text").alias("parent_text"))
    article = x.articles.select("law_id", F.col("id").alias("article"), F.col("number").alias("article_number"), "title")
    named = nodes(x).select("law_id", F.col("id").alias("to_id"), F.coalesce("number", "title").alias("cited"))
    cited = x.refs.join(named, ["law_id", "to_id"]).groupBy("law_id", F.col("from_id").alias("id")).agg(F.array_sort(F.collect_set("cited")).alias("cites"))
    rows = hits.join(p, ["law_id", "id"]).join(article, ["law_id", "article"]).join(parent, ["law_id", "parent"], "left").join(cited, ["law_id", "id"], "left")
    return rows.select("article_number", "title", "parent_text", "number", "text", F.coalesce("cites", F.array().cast("array<string>")).alias("cites"), "score").orderBy(F.desc("score"), "number")


def topic_articles(x: Exploration, limit: int = 6) -> DataFrame:
    """15: topics ``(topic, name, size, law_id, article)`` with their first articles."""
    named = x.topics.join(x.articles.select("law_id", F.col("id").alias("article"), "number", "title"), ["law_id", "article"]).withColumn("label", F.concat_ws(" ", "number", "title"))
    return collected(named, ["name", "size"], "label", ["number"], limit).orderBy(F.desc("size"), "name")


def neighbours(x: Exploration, law: str, provision: str) -> DataFrame:
    """16, 17: provisions similar to one, best first, whichever end it is."""
    at = lambda a, b: x.similar.where((F.col("law_id") == law) & (F.col(a) == provision)).select("law_id", F.col(b).alias("id"), "score")
    return at("a", "b").union(at("b", "a")).join(x.provisions, ["law_id", "id"]).select("number", "score", "text").orderBy(F.desc("score"), "number")


def norms_between(x: Exploration, kind: str, bearer: str, towards: str) -> DataFrame:
    """19: norms of one actor towards another and where they are stated."""
    rows = x.norms.where((F.col("kind") == kind) & (F.col("bearer") == bearer) & (F.col("towards") == towards))
    return _by_number(rows.join(x.provisions.select("law_id", "id", "number"), ["law_id", "id"]).select("number", "action", "condition"), "key", "action")


def actor_matrix(x: Exploration) -> DataFrame:
    """20: who owes what to whom, counted."""
    edge = F.create_map(*[F.lit(v) for pair in NORM_EDGES.items() for v in pair])
    return x.norms.where("towards IS NOT NULL").groupBy("bearer", edge[F.col("kind")].alias("edge"), "towards").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bearer", "edge", "towards")


def refs_with_role(x: Exploration, role: str) -> DataFrame:
    """21: citations in a given role."""
    named = nodes(x).select("law_id", F.col("id").alias("to_id"), F.col("number").alias("to_number"))
    rows = x.refs.where(F.col("role") == role).join(x.provisions.select("law_id", F.col("id").alias("from_id"), "number", "text"), ["law_id", "from_id"])
    return rows.join(named, ["law_id", "to_id"], "left").select("number", "text", "to_number")


def histogram_of_labels(x: Exploration) -> DataFrame:
    """Nodes by label and edges by type."""
    labels = nodes(x).groupBy("label").agg(F.count("*").alias("n"))
    edges = [x.refs.agg(F.count("*").alias("n")).select(F.lit("REFERS_TO").alias("label"), "n"), x.amendments.agg(F.count("*").alias("n")).select(F.lit("AMENDED_BY").alias("label"), "n")]
    return labels.union(edges[0]).union(edges[1])


def article_chain(x: Exploration) -> DataFrame:
    return next_articles(x.articles, number_key("number"))


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("n = 1").drop("n")
