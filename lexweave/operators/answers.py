"""Whole answers as nested JSON, one row each, and their recording and replay.

An answer is built by Spark from the tables of the services: lists of items, grouped by law where the request asks for it,
with totals beside them. Recorded answers are JSON lines; a replay builds them anew and tells which ones differ in structure
or value, whatever the order of keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.numbers import number_key
from lexweave.operators import services
from lexweave.operators.services import Change
from lexweave.operators.store import GraphStore

IMPACT_NOTE = "Энэ нь түр тооцоолол бөгөөд хуульд өөрчлөлт оруулахгүй."
#: Lists that an answer gives by law, and those it gives as they are ranked.
BY_LAW, RANKED = ("incoming", "outgoing", "former_name_refs", "missing_target_refs"), ("similar", "conflicts", "overlaps")
_PLAIN = ("law_id", "law_name", "article_id", "number", "snippet", "source_url", "type", "confidence")
_MORE = ("anchor_number", "score", "explanation", "raw_text", "matched_name", "current_number", "model")


def _item(of: Column | None = None) -> Column:
    """An item as an answer shows it: its two flags in an object of their own."""
    at = (lambda c: F.col(c)) if of is None else of.getField
    flags = F.struct(at("uses_old_name").alias("uses_old_name"), at("target_missing").alias("target_missing")).alias("flags")
    return F.struct(*[at(c).alias(c) for c in _PLAIN], flags, *[at(c).alias(c) for c in _MORE])


def _listed(rows: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """One row: ``value`` of all rows as an array in order; an empty one where there are none."""
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], value.alias("v"))
    found = rows.agg(F.sort_array(F.collect_list(keyed)).alias("s"))
    return found.select(F.transform("s", lambda s: s["v"]).alias(name))


def _beside(*parts: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, F.lit(True))  # one row each
    return out


def _by_law(items: DataFrame, by: str, names: list) -> DataFrame:
    """One row with a column per name of ``by``: its items grouped by law, most items first."""
    groups = services.law_groups(items, (by,))
    group = F.struct("law_id", "law_name", "count", F.transform("items", _item).alias("items"))
    keyed = F.struct((-F.col("count")).alias("k0"), F.col("law_name").alias("k1"), F.col("law_id").alias("k2"), group.alias("v"))
    found = groups.agg(*[F.sort_array(F.collect_list(F.when(F.col(by) == n, keyed))).alias(f"s{k}") for k, n in enumerate(names)])
    return found.select(*[F.transform(f"s{k}", lambda s: s["v"]).alias(n if isinstance(n, str) else f"depth{n}") for k, n in enumerate(names)])


def _number_of_items(groups: str) -> Column:
    return F.aggregate(groups, F.lit(0).cast("long"), lambda n, g: n + g["count"])


def _connections(rows: DataFrame) -> DataFrame:
    """The seven lists and their totals as one row; the items are read once for the facts and once for the suggestions."""
    facts = _by_law(rows.where("place IS NULL"), "list", list(BY_LAW))
    keyed = F.struct("place", _item().alias("v"))
    ranked = rows.where("place IS NOT NULL").agg(*[F.sort_array(F.collect_list(F.when(F.col("list") == n, keyed))).alias(n) for n in RANKED])
    ranked = ranked.select(*[F.transform(n, lambda s: s["v"]).alias(n) for n in RANKED])
    totals = F.struct(*[_number_of_items(n).alias(n) for n in BY_LAW], *[F.size(n).cast("long").alias(n) for n in RANKED])
    return _beside(facts, ranked).withColumn("totals", totals)


def _provision(store: GraphStore, id_: str, name: str) -> DataFrame:
    """A provision with its law, one row or none."""
    rows = services._with_law(store, store.article(id_), "law_id")
    shown = F.struct("article_id", "number", "title", "text", "parent_number", "law_id", F.col("l_name").alias("law_name"), services.article_url(F.col("number")).alias("source_url"))
    return rows.select(shown.alias(name)).limit(1)


def law_list(store: GraphStore, query: str | None = None) -> DataFrame:
    laws = services.list_laws(store, query)
    shown = F.struct("law_id", "name", "former_names", "article_count", "short_names", "text_available", "source_url")
    return _listed(laws, shown, [F.col("text_available").cast("int") * -1, -F.col("article_count"), F.col("name"), F.col("law_id")], "laws")


def law_detail(store: GraphStore, law_id: str) -> DataFrame:
    law = store.law(law_id).select(F.struct("law_id", "name", "former_names", "short_names", "adopted_date", "source_url", "text_available").alias("law")).limit(1)
    return _beside(law, law_articles(store, law_id))


def law_articles(store: GraphStore, law_id: str) -> DataFrame:
    rows = store.articles_of(law_id)
    return _listed(rows, F.struct("article_id", "number", "title", "text", "parent_number"), [F.col("number_key"), F.col("article_id")], "articles")


def article_connections(store: GraphStore, article_id: str) -> DataFrame:
    return _beside(_provision(store, article_id, "article"), _connections(services.article_connections(store, article_id)))


def law_connections(store: GraphStore, law_id: str) -> DataFrame:
    return _connections(services.law_connections(store, law_id))


def impact(store: GraphStore, **change) -> DataFrame:
    """Levels of what a change touches, by law, with totals; and what is similar to a new text."""
    asked = Change(**change)
    items = services.impact(store, asked)
    levels = _by_law(items, "depth", list(range(1, asked.depth + 1)))
    near = services.new_similar(store, asked)
    near = _listed(near, F.struct("article_id", "law_id", "number", "score", "model"), [-F.col("score"), F.col("article_id")], "new_similar")
    return _beside(levels, near, services.impact_totals(items).select(F.struct("*").alias("totals"))).withColumn("note", F.lit(IMPACT_NOTE))


def draft_list(store: GraphStore) -> DataFrame:
    return _listed(store.drafts, F.struct("draft_id", "lawforum_id", "title", "target_law_id", "source_url"), [F.col("draft_id")], "drafts")


def draft_detail(store: GraphStore, draft_id: str) -> DataFrame:
    ops = services.draft_detail(store, draft_id)
    head = store.draft(draft_id).select("draft_id", "lawforum_id", "title", "target_law_id", "new_name", "source_url").limit(1)
    shown = F.struct("op", "law_id", "law_name", "number", "article_id", "old_text", "new_text", "raw_text", "provision_title", "provision_text")
    laws = services.cosubmitted_laws(store, draft_id)
    return _beside(head, _listed(ops.where("op IS NOT NULL"), shown, [F.col("pos")], "operations"), _listed(laws, F.struct("law_id", "name", "article_count"), [F.col("pos")], "cosubmitted"))


def draft_gap(store: GraphStore, draft_id: str) -> DataFrame:
    """Laws covered, missing and for review, and how many laws were found. Reads the draft's record on the driver."""
    draft = store.draft(draft_id).first()
    if draft is None:
        raise KeyError(draft_id)
    rows = services.draft_gap(store, draft.asDict())
    laws = F.struct("law_name", "law_id")
    found = rows.agg(*[F.sort_array(F.collect_list(F.when(F.col("status") == s, laws))).alias(s) for s in ("covered", "missing", "review")], F.count("*").alias("found"))
    shown = lambda s: F.transform(s, lambda x: F.struct(x["law_id"].alias("law_id"), x["law_name"].alias("law_name"))).alias(s)
    return found.select(*map(shown, ("covered", "missing", "review")), "found")


def international(store: GraphStore, article_id: str) -> DataFrame:
    rows = services.best_links(store, article_id)
    shown = F.struct("source_id", "kind", "country_or_org", "title", "url", "summary", "provision", "relevance", "explanation", "model", "article_id", "anchor_number", T.label(F.lit("suggestion"), F.col("relevance")).alias("label"))
    return _listed(rows, shown, [-F.col("relevance"), F.col("source_id")], "sources")


def amendment(store: GraphStore, article_id: str) -> DataFrame:
    rows = services.amendment(store, article_id)
    base = F.struct("pos", F.struct(F.col("base_id").alias("id"), F.col("base_kind").alias("kind"), F.col("base_text").alias("text")).alias("v"))
    found = rows.groupBy("article_id", "reason", "suggested_text", "confidence", "model").agg(F.sort_array(F.collect_list(F.when(F.col("base_kind").isNotNull(), base))).alias("s"))
    return found.select("article_id", "reason", "suggested_text", "confidence", "model", F.transform("s", lambda s: s["v"]).alias("sources"))


def relation(store: GraphStore, a: str, b: str) -> DataFrame:
    pair = services.relation_detail(store, a, b).select("kind", "confidence", "explanation", "model", F.struct("suggested_text", "reason", "for_article", "on_pair").alias("resolution"))
    return _beside(pair, _provision(store, a, "a"), _provision(store, b, "b"))


def search(store: GraphStore, query: str) -> DataFrame:
    hits = services.search(store, query).select("*", number_key("number").alias("key"))
    order = [F.col("exact").cast("int") * -1, -F.col("matched"), F.col("key"), F.col("law_name"), F.col("article_id")]
    laws = services.search_laws(store, query)
    return _beside(_listed(laws, F.struct("law_id", "name"), [F.col("name"), F.col("law_id")], "laws"), _listed(hits, F.struct("article_id", "number", "law_id", "law_name", "snippet"), order, "provisions"))


def health(store: GraphStore) -> DataFrame:
    return store.laws.sparkSession.range(1).select(F.lit("ok").alias("status"), F.lit(store.dataset).alias("dataset"), F.lit(store.backend).alias("graph"))


#: What can be asked, by name.
ANSWERS: dict[str, Callable[..., DataFrame]] = {
    "health": health, "laws_list": law_list, "law_detail": law_detail, "law_articles": law_articles, "law_connections": law_connections, "article_connections": article_connections,
    "impact": impact, "drafts_list": draft_list, "draft_detail": draft_detail, "draft_gap": draft_gap, "international": international, "amendment": amendment, "relation_detail": relation, "search": search,
}


def answer(store: GraphStore, name: str, **request) -> DataFrame:
    """``(name, request, response)``: one row with an answer as JSON, null fields included; no row where what is asked for is not there."""
    found = ANSWERS[name](store, **request)
    response = F.to_json(F.struct(*found.columns), {"ignoreNullFields": "false"})
    return found.select(F.lit(name).alias("name"), F.lit(json.dumps(request, ensure_ascii=False, sort_keys=True)).alias("request"), response.alias("response"))


def record(store: GraphStore, requests: list[tuple[str, dict]], folder: str) -> None:
    """The answers to all requests as JSON lines in ``folder``."""
    rows = None
    for name, request in requests:
        one = answer(store, name, **request)
        rows = one if rows is None else rows.unionByName(one)
    rows.coalesce(1).write.mode("overwrite").json(folder)


def replay(store: GraphStore, folder: str) -> DataFrame:
    """``(name, request, recorded, response)`` of recorded answers that are different now, or gone."""
    kept = store.laws.sparkSession.read.schema("name STRING, request STRING, response STRING").json(folder)
    rows = None
    for r in kept.select("name", "request").collect():  # a row a recorded request
        one = answer(store, r.name, **json.loads(r.request))
        rows = one if rows is None else rows.unionByName(one)
    same = F.to_json(F.parse_json("recorded")) == F.to_json(F.parse_json("response"))  # objects by key, not by order
    met = kept.withColumnRenamed("response", "recorded").join(rows, ["name", "request"], "left")
    return met.where(~F.coalesce(same, F.lit(False))).select("name", "request", "recorded", "response")
