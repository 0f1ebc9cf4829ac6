"""Store, traversal and services on a small hand-written graph with the traps of each."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import build, services, traverse
from lexweave.operators.services import Change
from lexweave.operators.store import GraphStore, with_keys
from lexweave.sources.schemas import schema

LAWS = [("a", "А хууль"), ("b", "Б хууль"), ("c", "В хууль")]
NUMBERS = {"a": ["80", "80.1", "80.1.2", "80.2", "801", "9", "9¹", "10"], "b": ["1", "1.1", "2", "3"], "c": ["5", "6"]}


def ref(source, law, number, found=True, **more):
    row = {"from_article_id": source, "to_law_id": law, "to_number": number, "to_article_id": f"{law}:{number}" if found and number else None, "raw_text": f"{law} {number}", "matched_name": law, "uses_old_name": False, "target_missing": bool(number) and not found, "method": "regex", "confidence": 1.0, "current_number": None}
    return row | more


REFS = [
    ref("b:1", "a", "80.1"), ref("b:2", "a", "80"), ref("a:9", "a", "80.1.2"), ref("a:80.2", "a", "80.1"), ref("c:5", "b", "1"), ref("c:6", "b", "1.1"), ref("b:3", "c", "5"),
    ref("a:80.1", "b", "1"), ref("c:6", "a", "80.9", found=False), ref("c:5", "a", None), ref("b:3", "a", "801", uses_old_name=True, matched_name="хуучин"),
]


@pytest.fixture(scope="module")
def store(spark):
    laws = spark.createDataFrame([(i, n, ["хуучин " + n], [], None, "https://x.example/" + i, True) for i, n in LAWS], "law_id string, name string, former_names array<string>, short_names array<string>, adopted_date string, source_url string, text_available boolean")
    rows = [(law, f"{law}:{n}", n, n.rpartition(".")[0] or None, None, f"{law} {n} цагийн бичвэр") for law, ns in NUMBERS.items() for n in ns]
    articles = with_keys(spark.createDataFrame(rows, "law_id string, article_id string, number string, parent_number string, title string, text string"))
    similar = spark.createDataFrame([("a:80.1", "b:2", 0.9, "m"), ("a:80", "a:80.2", 0.8, "m")], schema("similar"))
    relations = spark.createDataFrame([("a:80.1", "b:2", "conflict", 0.7, "e", "m"), ("a:80.1", "c:5", "consistent", 0.9, "e", "m")], schema("relations"))
    sources = spark.createDataFrame([("s1", "treaty", "X", "T1", "https://s", "sum", None)], schema("intl_sources"))
    links = spark.createDataFrame([("a:80.1", "s1", 0.5, "e", "m"), ("a:80.2", "s1", 0.9, "e", "m"), ("b:1", "s1", 1.0, "e", "m")], schema("intl_links"))
    amendments = spark.createDataFrame([("a:80.1", "why", "new", ["s1", "b:2", "gone"], "m", None)], schema("amendments"))
    drafts = spark.createDataFrame([], schema("drafts"))
    return GraphStore(laws, articles, spark.createDataFrame(REFS, schema("refs")), similar, relations, amendments, drafts, sources, links)


def ids(rows, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in rows.collect())


def test_order_and_subtree(store):
    assert [r.number for r in store.articles_of("a").collect()] == ["9", "9¹", "10", "80", "80.1", "80.1.2", "80.2", "801"]
    assert ids(store.subtree("a:80"), "number") == ["80", "80.1", "80.1.2", "80.2"]


def test_refs_to_keeps_missing_and_whole_law(store):
    tree = store.subtree("a:80")
    assert len(ids(store.refs_to("a", tree, None, True), "raw_text")) == 6
    assert ids(store.refs_to("a", tree, tree.select("number"), False), "raw_text") == sorted(["a 80.1", "a 80", "a 80.1.2", "a 80.1", "a 80.9"])
    assert "a 80.9" not in ids(store.refs_to("a", tree, tree.select("number").where("false"), False), "raw_text")


def test_connections(store):
    rows = services.article_connections(store, "a:80")
    assert ids(rows.where("list = 'incoming'"), "article_id") == ["a:9", "b:1", "b:2", "c:6"]
    assert ids(rows.where("list = 'outgoing'"), "article_id") == ["b:1"]
    totals = services.connection_totals(rows).first().asDict()
    assert totals == {"incoming": 4, "outgoing": 1, "former_name_refs": 0, "missing_target_refs": 1, "similar": 1, "overlaps": 0, "conflicts": 1}


def test_law_connections_leave_the_law_itself_out(store):
    rows = services.law_connections(store, "a")
    assert ids(rows.where("list = 'incoming'"), "article_id") == ["b:1", "b:2", "b:3", "c:5", "c:6"]


def test_text_impact_takes_ancestors_but_not_descendants(store):
    rows = services.impact(store, Change(article_id="a:80.1", new_text="x", depth=2))
    assert ids(rows, "depth", "article_id") == [(1, "a:80.2"), (1, "b:1"), (1, "b:2"), (2, "c:5")]
    assert services.impact_totals(rows).first().asDict() == {"laws": 3, "articles": 4, "direct": 3, "indirect": 1}
    assert {r.article_id: "шууд" in r.explanation for r in rows.where("depth = 1").collect()} == {"a:80.2": True, "b:1": True, "b:2": False}


def test_renumber_takes_the_subtree_and_marks_missing(store):
    rows = services.impact(store, Change(article_id="a:80.1", new_number="90"))
    assert ids(rows, "article_id", "target_missing") == [("a:80.2", True), ("a:9", True), ("b:1", True)]


def test_rename_marks_old_names_of_other_laws(store):
    rows = services.impact(store, Change(law_id="a", new_name="Шинэ"))
    assert ids(rows, "article_id", "uses_old_name") == [("b:1", True), ("b:2", True), ("b:3", True), ("c:5", True), ("c:6", True)]


def test_change_is_checked():
    for bad in ({}, {"law_id": "a", "depth": 4}, {"law_id": "a", "new_name": "x" * 301}):
        with pytest.raises(ValueError):
            Change(**bad)


def test_search_sees_a_cycle_once_and_all_witnesses(spark):
    edges = [("x:1", "y:1"), ("y:1", "x:1"), ("z:1", "x:1"), ("w:1", "z:1"), ("w:1", "y:1"), ("v:1", "w:1")]
    refs = spark.createDataFrame([(a, b, b.partition(":")[2]) for a, b in edges], "from_article_id string, to_article_id string, to_number string")
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "article_id string")
    found = traverse.indirect_refs(refs, frame("y:1", "z:1"), frame("x:1"), 3)
    assert ids(found, "depth", "from_article_id", "via_article_id") == [(2, "w:1", "y:1"), (2, "w:1", "z:1"), (3, "v:1", "w:1")]
    assert ids(traverse.first_witness(found), "depth", "via_article_id") == [(2, "y:1"), (3, "w:1")]


def test_paths_use_no_edge_twice(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    rows = traverse.paths(edges, spark.createDataFrame([("a",)], "id string"), 3)
    assert sorted("".join(r.path) for r in rows.collect()) == ["ab", "aba", "abc"]


def test_gap(store):
    draft = {"target_law_id": "a", "cosubmitted_law_ids": ["b"], "new_name": None, "amended_article_ids": ["a:80.1", "a:none"]}
    assert ids(services.draft_gap(store, draft), "law_id", "status") == [("b", "covered"), ("c", "review")]


def test_best_link_amendment_and_detail(store):
    assert ids(services.best_links(store, "a:80"), "source_id", "anchor_number", "relevance") == [("s1", "80.2", 0.9)]
    rows = services.amendment(store, "a:80").orderBy("pos").collect()
    assert [(r.base_id, r.base_kind) for r in rows] == [("s1", "source"), ("b:2", "article"), ("gone", None)] and rows[0].confidence == 0.5
    detail = services.relation_detail(store, "b:2", "a:80.1").first()
    assert (detail.kind, detail.a_text, detail.on_pair) == ("conflict", "b 2 цагийн бичвэр", True)


def test_search(store):
    assert [r.article_id for r in services.search(store, "цаг 80").collect()] == ["a:80", "a:80.1", "a:80.1.2", "a:80.2"]
    assert services.search(store, "").count() == 0
    assert ids(services.list_laws(store, "хуучин б"), "law_id") == ["b"]


def test_groups_and_export(store):
    items = services.article_connections(store, "a:80")
    groups = services.law_groups(items.where("list = 'incoming'")).orderBy(F.desc("count"), "law_name").collect()
    assert [(g.law_id, g["count"]) for g in groups] == [("b", 2), ("a", 1), ("c", 1)]
    row = services.export_rows(items, list_name="missing_target_refs").first()
    assert (row.flags, row.label, row.anchor_number) == ("Заалт олдсонгүй", "Баримт", "80.9")


def test_problems(store, spark):
    assert ids(build.problems(store), "rule", "subject") == []
    broken = [ref("zz:1", "a", "80.1"), ref("b:1", "q", "1"), ref("b:1", "a", "80.1", target_missing=True), ref("b:1", "a", "80", confidence=0.5)]
    bad = GraphStore(store.laws, store.articles, spark.createDataFrame(broken, schema("refs")), store.similar, store.relations, store.amendments, store.drafts, store.intl_sources, store.intl_links)
    assert {r for r in ids(build.problems(bad), "rule")} == {"ref_from_unknown", "ref_to_unknown_law", "ref_to_unknown_article", "missing_flag_wrong", "missing_with_target", "fact_not_certain"}


def test_children_titles_and_labels(store, spark):
    assert [r.number for r in services.children(store, "a:80").collect()] == ["80.1", "80.1.2", "80.2"]
    titles = spark.createDataFrame([("А хуульд өөрчлөлт",), ("юу ч биш",)], "title string")
    assert sorted((r.title, r.law_id) for r in services.laws_of_titles(titles, store).collect()) == [("А хуульд өөрчлөлт", "a"), ("юу ч биш", None)]
    from lexweave.functions import text as T

    said = spark.createDataFrame([("80",), ("104",), ("40",), ("100",), ("80.1",), (None,)], "n string").select(T.provision_label("n").alias("x"))
    assert [r.x for r in said.collect()] == ["80 дугаар зүйл", "104 дүгээр зүйл", "40 дүгээр зүйл", "100 дугаар зүйл", "80.1", "Хууль бүхэлдээ"]


def test_draft_detail_and_every_export(store, spark):
    op = ("replace", "a", "80.1", "a:80.1", "x", "y", "raw", False, False)
    draft = ("d1", "1", "t", "a", None, ["a:80.1"], ["b"], "u", [op], [])
    from dataclasses import replace

    full = replace(store, drafts=spark.createDataFrame([draft], schema("drafts")))
    (row,) = services.draft_detail(full, "d1").collect()
    assert (row.op, row.provision_text, row.law_name) == ("replace", "a 80.1 цагийн бичвэр", "А хууль")
    assert [r.law_id for r in services.cosubmitted_laws(full, "d1").collect()] == ["b"]
    from lexweave.sources.files import CSV_COLUMNS, csv_text

    calls = {"connections": {"article_id": "a:80"}, "law_connections": {"law_id": "a"}, "impact": {"change": Change(article_id="a:80.1", new_text="x", depth=2)}, "draft_gap": {"draft_id": "d1"}, "international": {"article_id": "a:80"}, "search": {"query": "цаг"}}
    for kind, arguments in calls.items():
        rows = services.export(full, kind, **arguments)
        assert set(rows.columns) == set(CSV_COLUMNS) and rows.count() > 0, kind
        assert csv_text(rows).count() == rows.count()
    with pytest.raises(ValueError):
        services.export(full, "search")
    with pytest.raises(ValueError):
        services.export(full, "nothing")
    assert services.new_similar(store, Change(article_id="a:80.1", new_text="цагийн бичвэр")).count() > 0
    assert services.new_similar(store, Change(article_id="a:80.1")).count() == 0


def test_paths_are_told_once_and_deal_no_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string")
    rows = traverse.paths(edges, spark.createDataFrame([("a",)], "id string"), 3)
    assert sorted("".join(r.path) for r in rows.collect()) == ["ab", "abc"]
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_impact_of_a_law_does_not_look_for_each_provision_of_the_law(store):
    found = services.impact(store, Change(law_id="a", depth=2))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1  # before: the seeds at each depth too
    assert {r.law_id for r in found.select("law_id").collect()}.isdisjoint({"a"})
