"""Composite queries over a graph store: connections, impact, gaps, sources, search, export. Every answer is a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.numbers import ancestors_and_self, article_id, law_of, number_key, number_of, under
from lexweave.operators.store import GraphStore
from lexweave.operators.textindex import TextIndex, build_index
from lexweave.operators.traverse import first_witness, indirect_refs, labelled_reach

SELF_NAMES = ("энэ хууль", "энэ зүйл")
DEFAULT_URL = "https://legalinfo.mn/mn"
SUGGESTION_LIMIT, SEARCH_LIMIT, MAX_QUERY_TOKENS = 200, 60, 12
ITEM = ("law_id", "law_name", "article_id", "number", "snippet", "source_url", "type", "confidence", "uses_old_name", "target_missing", "anchor_number", "explanation", "raw_text", "matched_name", "current_number", "model", "score")
#: Names of the lists in an export; fixed values.
RELATIONSHIPS = {
    "incoming": "Үүнийг иш татсан", "outgoing": "Үүнээс иш татсан", "former_name_refs": "Хуучин нэр / дугаар", "missing_target_refs": "Заалт олдсонгүй",
    "similar": "Ижил асуудлыг зохицуулсан", "overlaps": "Болзошгүй давхардал", "conflicts": "Болзошгүй зөрчил", "international": "Олон улсын эх сурвалж",
    "depth1": "Шууд нөлөөлөл", "depth2": "Дам нөлөөлөл", "depth3": "Дам нөлөөлөл (3)", "new_similar": "Шинэ бичвэртэй төстэй",
    "covered": "Тусгагдсан", "missing": "Орхигдсон", "review": "Шалгах шаардлагатай", "search": "Хайлтын үр дүн",
}


def _ids(frame: DataFrame, column: str = "article_id") -> DataFrame:
    return frame.select(F.col(column).alias("article_id"))


def _no_ids(store: GraphStore) -> DataFrame:
    return store.articles.select("number").where(F.lit(False))


def article_url(number: Column) -> Column:
    return F.when(number.isNotNull() & (number != "") & F.coalesce("l_text", F.lit(False)), F.concat("l_url", F.lit("#"), number)).otherwise(F.col("l_url"))


def _with_law(store: GraphStore, rows: DataFrame, law_col: str) -> DataFrame:
    """Left join to the law, with a stand-in where it is unknown. The law table is small; Spark broadcasts it by size."""
    laws = store.laws.select(F.col("law_id").alias("l_id"), F.col("name").alias("l_name"), F.col("source_url").alias("l_known_url"), F.col("text_available").alias("l_text"))
    out = rows.join(laws, rows[law_col] == laws["l_id"], "left")
    return out.withColumn("l_name", F.coalesce("l_name", law_col)).withColumn("l_url", F.coalesce("l_known_url", F.lit(DEFAULT_URL))).withColumn("l_text", F.coalesce("l_text", F.col("l_id").isNotNull()))


def _with_text(store: GraphStore, rows: DataFrame, id_col: str) -> DataFrame:
    texts = store.articles.select(F.col("article_id").alias("t_id"), F.col("text").alias("t_text"))
    return rows.join(texts, rows[id_col] == texts["t_id"], "left")


def describe_ref(target_name: Column) -> Column:
    """What is to be said of a citation: an old name, a missing provision, its present number; null if nothing."""
    old = F.when(F.coalesce("uses_old_name", F.lit(False)), F.concat(F.lit("Хуучин нэрээр («"), "matched_name", F.lit("») иш татсан. Одоогийн нэр: «"), target_name, F.lit("».")))
    missing = F.when(F.coalesce("target_missing", F.lit(False)), F.concat(T.genitive(target_name), F.lit(" одоогийн бичвэрт "), F.coalesce("to_number", F.lit("None")), F.lit(" дугаартай заалт олдсонгүй.")))
    now = F.when(F.coalesce("target_missing", F.lit(False)) & F.col("current_number").isNotNull(), F.concat(F.lit("Харьцуулсан хүснэгтээр одоогийн дугаар: "), "current_number", F.lit(".")))
    return F.nullif(F.concat_ws(" ", old, missing, now), F.lit(""))


def _items(store: GraphStore, refs: DataFrame, side: str, explanation: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """References as items, seen from the cited side (``incoming``: the citing provision) or the citing side."""
    law, id_, number, anchor = ("from_law_id", "from_article_id", "from_number", "to_number") if side == "incoming" else ("to_law_id", "to_article_id", "to_number", "from_number")
    rows = _with_text(store, _with_law(store, refs, law), id_)
    targets = store.laws.select(F.col("law_id").alias("g_id"), F.col("name").alias("g_name"))
    rows = rows.join(targets, rows["to_law_id"] == targets["g_id"], "left")
    told = explanation if explanation is not None else describe_ref(F.coalesce("g_name", "to_law_id"))
    fact = F.coalesce(F.col("method") == "regex", F.lit(False))
    return rows.select(
        F.col(law).alias("law_id"), F.col("l_name").alias("law_name"), F.col(id_).alias("article_id"), F.col(number).alias("number"),
        T.excerpt(F.coalesce(F.nullif("t_text", F.lit("")), "raw_text")).alias("snippet"), article_url(F.col(number)).alias("source_url"),
        F.when(fact, "fact").otherwise("suggestion").alias("type"), "confidence",
        F.coalesce("uses_old_name", F.lit(False)).alias("uses_old_name"), F.coalesce("target_missing", F.lit(False)).alias("target_missing"),
        F.col(anchor).alias("anchor_number"), told.alias("explanation"), "raw_text", "matched_name", "current_number",
        F.when(~fact, F.col("method")).alias("model"), F.lit(None).cast("double").alias("score"), *extra,
    )


def _suggestions(store: GraphStore, edges: DataFrame, confidence: str, score: Column, explanation: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    rows = edges.where("NOT inside").withColumn("o_law", law_of("other")).withColumn("o_number", number_of("other"))
    texts = store.articles.select(F.col("article_id").alias("t_id"), F.col("text").alias("t_text"))
    rows = rows.join(texts, rows["other"] == texts["t_id"])  # a suggestion for a provision that is not there is left out
    rows = _with_law(store, rows, "o_law")
    return rows.select(
        F.col("o_law").alias("law_id"), F.col("l_name").alias("law_name"), F.col("other").alias("article_id"), F.col("o_number").alias("number"),
        T.excerpt("t_text").alias("snippet"), article_url(F.col("o_number")).alias("source_url"), F.lit("suggestion").alias("type"), F.round(confidence, 3).alias("confidence"),
        F.lit(False).alias("uses_old_name"), F.lit(False).alias("target_missing"), number_of("mine").alias("anchor_number"), explanation.alias("explanation"),
        *[F.lit(None).cast("string").alias(c) for c in ("raw_text", "matched_name", "current_number")], "model", score.alias("score"), *extra,
    )


def similar_explanation() -> Column:
    return F.concat(F.lit("Ижил асуудлыг зохицуулсан байж болзошгүй ("), "model", F.lit(")."))


def similar_items(store: GraphStore, selection: DataFrame) -> DataFrame:
    return _suggestions(store, store.similar_at(selection), "score", F.col("score"), similar_explanation())


def relation_items(store: GraphStore, selection: DataFrame) -> DataFrame:
    """Judged pairs at the selection with their kind (conflict or overlap) and the pair's similarity, if known."""
    pair = [F.least("a_article_id", "b_article_id"), F.greatest("a_article_id", "b_article_id")]
    scores = store.similar.select(pair[0].alias("p"), pair[1].alias("q"), F.col("score").alias("s_score")).dropDuplicates(["p", "q"])
    edges = store.relations_at(selection).where(F.col("kind").isin("conflict", "overlap")).withColumn("p", pair[0]).withColumn("q", pair[1])
    edges = edges.join(scores, ["p", "q"], "left")
    return _suggestions(store, edges, "confidence", F.col("s_score"), F.col("explanation"), ("kind",))


def law_groups(items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Items by law: how many, and the items in order of number and anchor. Order the result by ``-count, law_name``."""
    keys = F.struct(number_key("number").alias("k1"), number_key("anchor_number").alias("k2"), F.coalesce("article_id", F.lit("")).alias("k3"))
    item = F.struct(*[F.col(c) for c in ITEM])
    grouped = items.groupBy(*by, "law_id").agg(F.max("law_name").alias("law_name"), F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct(keys.alias("k"), F.coalesce("raw_text", F.lit("")).alias("r"), item.alias("item")))).alias("sorted"))
    return grouped.select(*by, "law_id", "law_name", "count", F.transform("sorted", lambda s: s["item"]).alias("items"))


LISTS = ("incoming", "outgoing", "former_name_refs", "missing_target_refs", "similar", "overlaps", "conflicts")


def _connections(store: GraphStore, selection: DataFrame, incoming: DataFrame, outgoing: DataFrame, limit: int | None) -> DataFrame:
    """The seven lists in one table, ``list`` and the item; facts are read once and stand in up to three of them.

    ``place`` is a suggestion's rank in its list, strongest first (similar provisions by score, judged ones by confidence),
    then by provision, score and anchor; facts have none. A list of suggestions is one window's: it is of one provision or law.
    """
    ends = {"incoming": incoming, "outgoing": outgoing}
    inc, out = (_items(store, refs, side).withColumn("list", F.lit(side)) for side, refs in ends.items())
    names = F.array("list", F.when(F.col("uses_old_name"), "former_name_refs"), F.when(F.col("target_missing"), "missing_target_refs"))
    facts = inc.unionByName(out).withColumn("list", F.explode(F.array_compact(names)))
    relations = relation_items(store, selection).withColumn("list", F.concat("kind", F.lit("s"))).drop("kind")
    suggested = similar_items(store, selection).withColumn("list", F.lit("similar")).unionByName(relations)
    strength = F.when(F.col("list") == "similar", F.col("score")).otherwise(F.col("confidence"))
    order = Window.partitionBy("list").orderBy(F.desc(strength), "article_id", F.desc("score"), number_key("anchor_number"))
    suggested = suggested.withColumn("place", F.row_number().over(order))
    if limit is not None:
        suggested = suggested.where(F.col("place") <= limit)
    return facts.withColumn("place", F.lit(None).cast("int")).unionByName(suggested)


def article_connections(store: GraphStore, id_: str) -> DataFrame:
    """All links of a provision and what is below it, but those within; a citation without a resolved target stays."""
    law, _, number = id_.partition(":")
    selection = _ids(store.subtree(id_))
    prefixes = store.subtree(id_).select("number")
    inside = selection.distinct()
    incoming = store.refs_to(law, selection, prefixes, False).join(inside.withColumnRenamed("article_id", "from_article_id"), "from_article_id", "left_anti")
    outgoing = store.refs_from(selection).join(inside.withColumnRenamed("article_id", "to_article_id"), "to_article_id", "left_anti")
    return _connections(store, selection, incoming, outgoing, None)


def law_connections(store: GraphStore, law_id: str, limit: int | None = SUGGESTION_LIMIT) -> DataFrame:
    """Links of a law to others: facts whole, of each list of suggestions the ``limit`` most confident ones."""
    selection = _ids(store.articles.where(F.col("law_id") == law_id))
    incoming = store.refs_to(law_id, selection, None, True).where(F.col("from_law_id") != law_id)
    outgoing = store.refs_from(selection).where(F.col("to_law_id") != law_id)
    return _connections(store, selection, incoming, outgoing, limit)


def connection_totals(connections: DataFrame) -> DataFrame:
    """One row: the length of each list."""
    return connections.agg(*[F.count_if(F.col("list") == name).alias(name) for name in LISTS])


@dataclass(frozen=True)
class Change:
    """What is to be changed; a new name comes before a new number, and that before a new text."""

    article_id: str | None = None
    law_id: str | None = None
    new_text: str | None = None
    new_name: str | None = None
    new_number: str | None = None
    depth: int = 1

    def kind(self) -> str:
        if self.new_name:
            return "rename"
        if self.article_id and self.new_number:
            return "renumber"
        return "text" if self.article_id and self.new_text else "none"

    def __post_init__(self) -> None:
        if not (self.article_id or self.law_id):
            raise ValueError("a change needs article_id or law_id")
        if not 1 <= self.depth <= 3:
            raise ValueError("depth is 1 to 3")
        for value, most in ((self.new_text, 20_000), (self.new_name, 300)):
            if value and len(value) > most:
                raise ValueError(f"longer than {most} characters")


def impact(store: GraphStore, change: Change) -> DataFrame:
    """Items with ``depth``: provisions that a change touches directly, and over citations of citations.

    A provision of depth 1 is listed once, by its first reference; deeper ones by their first witness.
    """
    kind = change.kind()
    law = change.law_id or change.article_id.partition(":")[0]
    of_law = store.in_law(law)
    nothing = _no_ids(store)
    whole = kind == "rename" or not change.article_id
    if whole:
        seeds = _ids(of_law)
        refs = store.refs_to(law, seeds, None, True).where(F.col("from_law_id") != law)
        if kind == "rename":
            refs = refs.where(~F.col("matched_name").isin(*SELF_NAMES))
    elif kind == "renumber":
        seeds = _ids(store.subtree(change.article_id))
        refs = store.refs_to(law, seeds, nothing, False)
    else:
        seeds = _ids(store.article(change.article_id))
        number = change.article_id.partition(":")[2]
        up = store.laws.sparkSession.range(1).select(F.explode(F.transform(ancestors_and_self(F.lit(number)), lambda n: article_id(F.lit(law), n))).alias("article_id"))
        refs = store.refs_to(law, up, nothing, False)
    if not whole:  # else the seeds are the law's provisions, which a filter on the law keeps out
        refs = refs.join(seeds.distinct().withColumnRenamed("article_id", "from_article_id"), "from_article_id", "left_anti")
    order = Window.partitionBy("from_article_id").orderBy(number_key("to_number"), "to_article_id", "raw_text")
    direct = refs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    if kind in ("rename", "none"):
        via = F.lit("шууд иш татсан")
    else:
        hit = seeds.distinct().select(F.col("article_id").alias("s_id"), F.lit(True).alias("is_seed"))
        direct = direct.join(hit, direct["to_article_id"] == hit["s_id"], "left").drop("s_id")
        via = F.when(F.coalesce("is_seed", F.lit(False)), "шууд иш татсан").otherwise("агуулсан зүйл/хэсгийг иш татсан")
    told = F.concat(F.coalesce("to_number", F.lit("хуулийг бүхэлд нь")), F.lit(": "), via, F.lit("."))
    if kind == "rename":
        told = F.concat(told, F.lit(" Нэр өөрчлөгдвөл энэ ишлэл хуучин нэртэй болно."))
        direct = direct.withColumn("uses_old_name", F.lit(True))
    if kind == "renumber":
        told = F.concat(told, F.lit(f" Дугаар {change.new_number} болбол энэ ишлэл олдохгүй заалт руу заана."))
        direct = direct.withColumn("target_missing", F.lit(True))
    out = _items(store, direct, "incoming", told).withColumn("depth", F.lit(1))
    if change.depth > 1:
        columns = store.refs_with_source().columns
        every, frontier = store.refs_with_source().select(*columns), direct.select(F.col("from_article_id").alias("article_id"))
        if whole:
            found = indirect_refs(every.where(F.col("from_law_id") != law), frontier, seeds.where(F.lit(False)), change.depth)
        else:
            found = indirect_refs(every, frontier, seeds, change.depth)
        names = store.laws.select(F.col("law_id").alias("v_id"), F.col("name").alias("v_name"))
        found = first_witness(found).withColumn("v_law", law_of("via_article_id")).join(names, F.col("v_law") == names["v_id"], "left")
        told = F.concat(T.genitive(F.coalesce("v_name", "v_law")), F.lit(" "), number_of("via_article_id"), F.lit("-ээр дамжсан: "), F.coalesce("to_number", F.lit("None")), F.lit("-ийг иш татсан."))
        out = out.unionByName(_items(store, found, "incoming", told, ("depth",)))
    return out


def impact_of_article(store: GraphStore, id_: str, new_text: str | None = None, new_name: str | None = None, new_number: str | None = None, depth: int = 2) -> DataFrame:
    """Impact of a change to a provision; a new name is a change of its law."""
    if new_name:
        return impact(store, Change(law_id=id_.partition(":")[0], new_name=new_name, depth=depth))
    return impact(store, Change(article_id=id_, new_text=new_text, new_number=new_number, depth=depth))


def impact_totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count_distinct("law_id").alias("laws"), F.count("*").alias("articles"), F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"))


def draft_gap(store: GraphStore, draft: dict) -> DataFrame:
    """Laws that a draft should touch: ``(law_id, law_name, status)``, covered, missing or review.

    ``draft`` is one record of the drafts table. A law met directly is covered if it is submitted with the draft, else
    missing; one met only indirectly is for review. The amended provisions that exist are examined two levels deep,
    each for itself but all in one search; a draft that renames its law is examined as such.
    """
    target, together = draft["target_law_id"], list(draft["cosubmitted_law_ids"] or [])
    if draft.get("new_name"):
        items = impact(store, Change(law_id=target, new_name=draft["new_name"], depth=2)).select("law_id", "law_name", "depth")
    else:
        amended = list(draft["amended_article_ids"] or [])
        items = gap_items(store, amended).select("law_id", "law_name", "depth") if amended else impact(store, Change(law_id=target, depth=2)).select("law_id", "law_name", "depth")
    nearest = items.where(F.col("law_id") != target).groupBy("law_id").agg(F.max("law_name").alias("law_name"), F.min("depth").alias("depth"))
    status = F.when(F.col("law_id").isin(*together) if together else F.lit(False), "covered").when(F.col("depth") == 1, "missing").otherwise("review")
    return nearest.select("law_id", "law_name", status.alias("status"))


def gap_items(store: GraphStore, amended: list[str]) -> DataFrame:
    """``(seed, article_id, law_id, law_name, depth)``: the impact of each amended provision that exists, two levels deep.

    One plan for all of them: a search whose rows carry the provision they start from.
    """
    asked = store.laws.sparkSession.createDataFrame([(i, i.partition(":")[0]) for i in dict.fromkeys(amended)], "seed string, law string")
    there = store.articles.select(F.col("article_id").alias("seed"), F.col("law_id").alias("law"))
    seeds = asked.join(there, ["seed", "law"], "left_semi").select("seed")
    found = labelled_reach(store.refs, seeds, 2).withColumn("law_id", law_of("article_id"))
    return _with_law(store, found, "law_id").select("seed", "article_id", "law_id", F.col("l_name").alias("law_name"), "depth")


def best_links(store: GraphStore, id_: str) -> DataFrame:
    """Per foreign or treaty source the most relevant link in a subtree; ties by provision number."""
    links = store.intl_links_at(_ids(store.subtree(id_)))
    order = Window.partitionBy("source_id").orderBy(F.desc("relevance"), number_key(number_of("article_id")), "article_id")
    return links.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n").withColumn("anchor_number", number_of("article_id"))


def amendment(store: GraphStore, id_: str) -> DataFrame:
    """The first suggested amendment in a subtree, with each of its bases resolved to a source or a provision."""
    found = store.amendments.join(_ids(store.subtree(id_)).distinct(), "article_id", "left_semi").orderBy(number_key(number_of("article_id")), "suggested_text").limit(1)
    bases = found.select("*", F.posexplode_outer("based_on_source_ids").alias("pos", "base_id"))
    sources = store.intl_sources.select(F.col("source_id").alias("s_id"), F.col("title").alias("s_title"), F.col("url").alias("s_url"))
    texts = store.articles.select(F.col("article_id").alias("t_id"), F.col("law_id").alias("t_law"), F.col("text").alias("t_text"))
    rows = bases.join(sources, bases["base_id"] == sources["s_id"], "left").join(texts, bases["base_id"] == texts["t_id"], "left")
    kind = F.when(F.col("s_id").isNotNull(), "source").when(F.col("t_id").isNotNull(), "article")
    return rows.select("article_id", "reason", "suggested_text", "model", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "pos", "base_id", kind.alias("base_kind"), F.coalesce("s_title", T.excerpt("t_text")).alias("base_text"))


def relation_detail(store: GraphStore, a: str, b: str) -> DataFrame:
    """A judged pair side by side, with the suggested amendment that builds on the pair, or else any of the pair's."""
    pair = sorted((a, b))
    judged = store.relations.where((F.least("a_article_id", "b_article_id") == pair[0]) & (F.greatest("a_article_id", "b_article_id") == pair[1])).limit(1)
    texts = store.articles.select("article_id", "text")
    side = lambda name, id_: texts.where(F.col("article_id") == id_).select(F.col("text").alias(name))
    both = F.array(F.lit(a), F.lit(b))
    offers = store.amendments.where(F.col("article_id").isin(a, b)).select("suggested_text", "reason", F.arrays_overlap("based_on_source_ids", both).alias("on_pair"), F.col("article_id").alias("for_article"))
    offer = offers.orderBy(F.desc("on_pair"), "for_article", "suggested_text").limit(1)
    return judged.join(side("a_text", a), F.lit(True), "left").join(side("b_text", b), F.lit(True), "left").join(offer, F.lit(True), "left")


def list_laws(store: GraphStore, query: str | None = None) -> DataFrame:
    """Laws whose current, former or short name holds the query; without text last, then by size and name."""
    laws = store.laws_with_counts()
    if query:
        wanted = T.normal_form(F.lit(query))
        blank = F.array().cast("array<string>")
        names = F.concat(F.array("name"), F.coalesce("former_names", blank), F.coalesce("short_names", blank))
        laws = laws.where(F.exists(names, lambda n: F.contains(T.normal_form(n), wanted)))
    return laws.orderBy(F.desc("text_available"), F.desc("article_count"), "name")


def search(store: GraphStore, query: str, index: TextIndex | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Provisions for a query: ``(article_id, number, law_id, law_name, exact, matched, snippet)`` in order of rank.

    Every word stands in the law's names or in the text, in either direction of prefix; a query without a number needs
    a word in the text; a number limits to it and what is below. A report of the best ``limit``. ``index`` is one of
    ``provision_index``: with it only the terms asked for are read, which pays where many searches share it; else
    the texts are read for the query, and those stemmed that have the first letters of a word.
    """
    words, numbers = query_words(store, query)
    laws = store.laws.withColumn("law_bag", T.stems(_all_names())).select("law_id", F.col("name").alias("law_name"), "law_bag")
    named = _any([under("number", F.lit(n)) for n in numbers]) if numbers else F.lit(True)
    if index is None:
        whole = F.concat_ws(" ", "title", "text")
        near = [T.may_match(whole, w) for w in words]
        rows = store.articles.where(named if numbers or not words else _any(near)).withColumn("bag", T.stems(whole))
        in_text = [n & T.prefix_match(F.col("bag"), F.lit(w)) for n, w in zip(near, words)]
    else:
        hits = None
        for k, w in enumerate(words):
            part = index.opening(w).select("id", F.lit(k).alias("k"))
            hits = part if hits is None else hits.unionByName(part)
        rows = store.articles.where(named)
        if hits is not None:
            found = hits.groupBy(F.col("id").alias("hit_id")).agg(F.collect_set("k").alias("hit"))  # a number per word of the query
            rows = rows.join(found, rows["article_id"] == found["hit_id"], "left" if numbers else "inner")
        in_text = [F.coalesce(F.array_contains("hit", k), F.lit(False)) for k in range(len(words))]
    rows = rows.join(laws, "law_id")
    hit = [t | T.prefix_match(F.col("law_bag"), F.lit(w)) for t, w in zip(in_text, words)]
    keep = F.lit(bool(words or numbers))
    for h in hit:
        keep = keep & h
    if words and not numbers:
        keep = keep & _any(in_text)
    matched = sum([t.cast("int") for t in in_text], F.lit(0))
    exact = F.col("number").isin(*numbers) if numbers else F.lit(False)
    key = number_key("number").alias("number_key")  # of what is found, not of every provision
    rows = rows.where(keep).select("article_id", "number", key, "law_id", "law_name", exact.alias("exact"), matched.alias("matched"), T.excerpt(F.coalesce(F.nullif("text", F.lit("")), "title"), 240).alias("snippet"))
    return rows.orderBy(F.desc("exact"), F.desc("matched"), "number_key", "law_name", "article_id").limit(limit).drop("number_key")


def provision_index(store: GraphStore, folder: str) -> TextIndex:
    """The stored index of stems of all titles and texts that ``search`` reads."""
    return build_index(store.articles.select(F.col("article_id").alias("id"), F.concat_ws(" ", "title", "text").alias("text")), folder, stemmed=True)


def search_laws(store: GraphStore, query: str) -> DataFrame:
    """Laws in whose names every word of the query stands."""
    words, numbers = query_words(store, query)
    keep = F.lit(bool(words))
    laws = store.laws.withColumn("law_bag", T.stems(_all_names()))
    for w in words:
        keep = keep & T.prefix_match(F.col("law_bag"), F.lit(w))
    return laws.where(keep).drop("law_bag")


def query_words(store: GraphStore, query: str) -> tuple[list[str], list[str]]:
    """Stemmed words of two letters or more and numbers among the first twelve tokens of a query: one tiny row."""
    row = store.laws.sparkSession.range(1).select(T.tokens(F.lit(query)).alias("t"), T.stems(F.lit(query)).alias("s")).first()
    pairs = list(zip(row.t, row.s))[:MAX_QUERY_TOKENS]
    return [s for t, s in pairs if not t[0].isdigit() and len(s) >= 2], [t for t, _ in pairs if t[0].isdigit()]


def _all_names() -> Column:
    return F.concat_ws(" ", "name", F.array_join("former_names", " "), F.array_join("short_names", " "))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def export_rows(items: DataFrame, list_col: str = "list", list_name: str | None = None) -> DataFrame:
    """Items as the flat rows of an export; ``list_name`` limits to one list."""
    names = F.create_map(*[F.lit(x) for pair in RELATIONSHIPS.items() for x in pair])
    flags = F.concat_ws("; ", F.when(F.col("uses_old_name"), "Хуучин нэр"), F.when(F.col("target_missing"), "Заалт олдсонгүй"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = items if list_name is None else items.where(F.col(list_col) == list_name)
    return rows.select("law_name", F.coalesce("number", F.lit("")).alias("provision_number"), names[F.col(list_col)].alias("relationship"), "type", T.label(F.col("type"), F.col("confidence")).alias("label"), "confidence", flags.alias("flags"), "source_url", blank("anchor_number"), blank("explanation"), blank("model"), "snippet")


def children(store: GraphStore, id_: str) -> DataFrame:
    """What is below a provision, in order, the provision itself not."""
    return store.subtree(id_).where(F.col("article_id") != id_).orderBy("number_key", "article_id")


def laws_of_titles(titles: DataFrame, store: GraphStore) -> DataFrame:
    """``titles(title)`` with the law whose name, but for its last word, opens the title; the longest such name.

    Names are few beside titles: each title is cut to its possible beginnings by word, so the match is an equi-join.
    """
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, "хууль$", "")))
    names = store.laws.select(F.col("law_id"), F.regexp_replace(key(F.col("name")), r"\s+", " ").alias("start"))
    words = F.split(F.regexp_replace(F.lower(F.trim("title")), r"\s+", " "), " ")
    starts = titles.select("title", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("start"))
    order = Window.partitionBy("title").orderBy(F.length("start").desc(), "law_id")
    best = starts.join(names, "start").withColumn("__n", F.row_number().over(order)).where("__n = 1").select("title", "law_id")
    return titles.join(best, "title", "left")


def draft_detail(store: GraphStore, draft_id: str) -> DataFrame:
    """A draft's operations, a row each, with the present text of the provision they amend."""
    ops = store.draft(draft_id).select("draft_id", "title", "target_law_id", F.posexplode_outer("operations").alias("pos", "op"))
    ops = ops.select("draft_id", "title", "target_law_id", "pos", "op.*")
    texts = store.articles.select(F.col("article_id").alias("t_id"), F.col("title").alias("provision_title"), F.col("text").alias("provision_text"))
    names = store.laws.select(F.col("law_id").alias("n_id"), F.col("name").alias("law_name"))
    return ops.join(texts, ops["article_id"] == F.col("t_id"), "left").join(names, ops["law_id"] == F.col("n_id"), "left").drop("t_id", "n_id").orderBy("pos")


def cosubmitted_laws(store: GraphStore, draft_id: str) -> DataFrame:
    """Laws that are submitted with a draft, in order."""
    ids = store.draft(draft_id).select(F.posexplode("cosubmitted_law_ids").alias("pos", "law_id"))
    return ids.join(store.laws_with_counts(), "law_id").orderBy("pos")


def new_similar(store: GraphStore, change: Change, limit: int = 10) -> DataFrame:
    """Provisions of other laws similar to the new text of a change, best first; none without a new text."""
    from lexweave.operators.similarity import similar_to_text

    law = change.law_id or change.article_id.partition(":")[0]
    rows = similar_to_text(store, change.new_text or "", law, limit)
    return rows if (change.new_text or "").strip() else rows.where(F.lit(False))


def export(store: GraphStore, kind: str, *, article_id: str | None = None, law_id: str | None = None, draft_id: str | None = None, query: str | None = None, change: Change | None = None, list_name: str | None = None) -> DataFrame:
    """The rows of an export of one kind: connections, law_connections, impact, draft_gap, international or search.

    Lists are never limited here. Only a draft gap reads a record (the draft's) on the driver.
    """
    if kind == "connections":
        rows = export_rows(article_connections(store, _needed(article_id, "article_id")), list_name=list_name)
    elif kind == "law_connections":
        rows = export_rows(law_connections(store, _needed(law_id, "law_id"), limit=None), list_name=list_name)
    elif kind == "impact":
        items = impact(store, _needed(change, "change")).withColumn("list", F.concat(F.lit("depth"), F.col("depth").cast("string")))
        rows = export_rows(items, list_name=list_name)
    elif kind == "draft_gap":
        draft = store.draft(_needed(draft_id, "draft_id")).first()
        if draft is None:
            raise KeyError(draft_id)
        gap = draft_gap(store, draft.asDict())
        blank = [F.lit("").alias(c) for c in ("provision_number", "flags", "anchor_number", "explanation", "model", "snippet")]
        laws = store.laws.select("law_id", "source_url")
        names = F.create_map(*[F.lit(x) for pair in RELATIONSHIPS.items() for x in pair])
        rows = gap.join(laws, "law_id", "left").select("law_name", names[F.col("status")].alias("relationship"), F.lit("fact").alias("type"), T.label(F.lit("fact"), F.lit(1.0)).alias("label"), F.lit(1.0).alias("confidence"), "source_url", *blank)
    elif kind == "international":
        links = best_links(store, _needed(article_id, "article_id"))
        rows = links.select(F.col("title").alias("law_name"), F.coalesce("provision", F.lit("")).alias("provision_number"), F.lit(RELATIONSHIPS["international"]).alias("relationship"), F.lit("suggestion").alias("type"), T.label(F.lit("suggestion"), F.col("relevance")).alias("label"), F.col("relevance").alias("confidence"), F.lit("").alias("flags"), F.col("url").alias("source_url"), "anchor_number", "explanation", F.coalesce("model", F.lit("")).alias("model"), F.col("summary").alias("snippet"))
    elif kind == "search":
        hits = search(store, _needed(query, "query"))
        found = _with_law(store, hits, "law_id")
        rows = found.select(F.col("l_name").alias("law_name"), F.col("number").alias("provision_number"), F.lit(RELATIONSHIPS["search"]).alias("relationship"), F.lit("fact").alias("type"), T.label(F.lit("fact"), F.lit(1.0)).alias("label"), F.lit(1.0).alias("confidence"), F.lit("").alias("flags"), article_url(F.col("number")).alias("source_url"), *[F.lit("").alias(c) for c in ("anchor_number", "explanation", "model")], "snippet")
    else:
        raise ValueError(f"unknown kind of export: {kind}")
    return rows


def _needed(value, name: str):
    if not value:
        raise ValueError(f"{name} is required")
    return value
