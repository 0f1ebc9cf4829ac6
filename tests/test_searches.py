"""Searches that carry their seed or recurse, the rules of the data format one by one, and ranges of cross references."""

from dataclasses import replace

import pytest

from lexweave.operators import build, services, structure, traverse
from lexweave.operators.services import Change
from lexweave.operators.store import GraphStore, with_keys
from lexweave.sources.schemas import schema


def ref(source, law, number, **more):
    row = {"from_article_id": source, "to_law_id": law, "to_number": number, "to_article_id": f"{law}:{number}" if number else None, "raw_text": "r", "matched_name": law, "uses_old_name": False, "target_missing": False, "method": "regex", "confidence": 1.0, "current_number": None}
    return row | more


LAWS = "law_id string, name string, former_names array<string>, short_names array<string>, adopted_date string, source_url string, text_available boolean"
ARTICLES = "law_id string, article_id string, number string, parent_number string, title string, text string"


def law(id_, **more):
    return {"law_id": id_, "name": id_, "former_names": [], "short_names": [], "adopted_date": None, "source_url": "https://x", "text_available": True} | more


def article(law_id, number, **more):
    return {"law_id": law_id, "article_id": f"{law_id}:{number}", "number": number, "parent_number": number.rpartition(".")[0] or None, "title": None, "text": "t"} | more


@pytest.fixture(scope="module")
def store(spark):
    """Ten laws of a few provisions with citations that form cycles, diamonds and chains, and climb to what contains them."""
    arts = [article(f"l{i}", n) for i in range(10) for n in ("1", "1.1", "1.1.1", "2", "2.1")]
    ids = [a["article_id"] for a in arts]
    refs = [ref(ids[k * 7 % 50], *ids[(k * k + 3 * k) % 50].split(":")) for k in range(90)]
    refs = [r for r in refs if r["from_article_id"] != r["to_article_id"]] + [ref("l1:1", "l2", None), ref("l3:2", "l4", "9", target_missing=True, to_article_id=None)]
    return GraphStore(spark.createDataFrame([law(f"l{i}") for i in range(10)], LAWS), with_keys(spark.createDataFrame(arts, ARTICLES)), spark.createDataFrame(refs, schema("refs")), *[spark.createDataFrame([], schema(n)) for n in ("similar", "relations", "amendments", "drafts", "intl_sources", "intl_links")])


def test_one_labelled_search_equals_a_search_per_seed(store):
    asked = ["l0:1.1", "l3:2.1", "l7:1", "l7:1.1.1", "l0:1.1", "l9:none"]
    found = services.gap_items(store, asked)
    got = {(r.seed, r.article_id, r.law_id, r.law_name, r.depth) for r in found.collect()}
    wanted = {(s, r.article_id, r.law_id, r.law_name, r.depth) for s in set(asked[:4]) for r in services.impact(store, Change(article_id=s, new_text="x", depth=2)).collect()}
    assert got == wanted and len(got) == found.count() > 10 and {d for *_, d in got} == {1, 2}


def test_a_gap_of_many_provisions_is_one_plan(store):
    ids = [f"l{i}:{n}" for i in range(5) for n in ("1", "1.1", "2")]
    draft = {"target_law_id": "l0", "cosubmitted_law_ids": ["l6"], "new_name": None, "amended_article_ids": ids}
    rows = services.draft_gap(store, draft)
    few = services.draft_gap(store, draft | {"amended_article_ids": ids[:1]})
    joins = lambda f: f._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(rows) == joins(few)
    depth = {}
    for s in ids:
        for r in services.impact(store, Change(article_id=s, new_text="x", depth=2)).collect():
            depth[r.law_id] = min(depth.get(r.law_id, 9), r.depth)
    assert {r.law_id: r.status for r in rows.collect()} == {k: "covered" if k == "l6" else "missing" if d == 1 else "review" for k, d in depth.items() if k != "l0"}


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_recursion_finds_what_the_levels_find(store, spark, depth):
    seeds, frontier = (spark.createDataFrame([(i,) for i in x], "article_id string") for x in (["l0:1", "l0:1.1"], ["l3:1", "l4:2.1", "l5:1.1"]))
    key = lambda f: sorted(tuple(map(str, (r.depth, r.from_article_id, r.to_article_id, r.via_article_id))) for r in f.collect())
    assert key(traverse.recursive_refs(store.refs, frontier, seeds, depth)) == key(traverse.indirect_refs(store.refs, frontier, seeds, depth))


@pytest.mark.parametrize("length", [1, 2, 4])
def test_recursive_paths(spark, length):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("a", "a")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("c",), ("z",)], "id string")
    key = lambda f: sorted((r.path, r.length) for r in f.collect())
    assert key(traverse.recursive_paths(edges, starts, length)) == key(traverse.paths(edges, starts, length))


def test_every_rule_fires(spark):
    f = spark.createDataFrame
    laws = f([law("a"), law("a"), law("Bad Id"), law("c", source_url="http://c"), law("d", text_available=False), law("e", text_available=None)], LAWS)
    arts = [article("a", "1"), article("a", "1"), article("a", "1.1"), article("a", "3.1"), article("a", "2", article_id="a:x"), article("d", "1"), article("e", "1", text="[ЖИШЭЭ] ok")]
    refs = [
        ref("a:none", "a", "1"), ref("a:1", "q", None), ref("a:1.1", "a", "7", to_article_id="a:7"), ref("e:1", "a", "1", target_missing=True, to_article_id=None), ref("a:1", "a", "1.1", target_missing=True),
        ref("a:1", "d", "9", target_missing=False, to_article_id=None), ref("a:1", "a", "1.1", confidence=0.9), ref("a:1", "a", "1.1", confidence=1.5, method="llm"), ref("a:1", "a", None),
    ]
    similar = f([("a:1", "zz:1", 0.9, "m"), ("yy:1", "a:1", 0.9, None)], schema("similar"))
    relations = f([("a:1", "a:9", "overlap", 0.5, "e", "")], schema("relations"))
    amendments = f([("a:8", "r", "s", [], None, None)], schema("amendments"))
    sources = f([("s1", "treaty", "X", "T", "http://s", "s", None)], schema("intl_sources"))
    links = f([("a:1", "s1", 0.5, "e", "m"), ("a:6", "s1", 0.5, "e", "m"), ("a:1", "s2", 0.5, "e", "m"), ("a:1", "s1", 0.5, "e", None)], schema("intl_links"))
    drafts = f([("d1", "1", "t", "zz", None, ["a:1", "a:77"], ["a", "yy"], "u", [], []), ("d2", "2", "t", "a", None, None, None, "u", [], [])], schema("drafts"))
    bad = GraphStore(laws, with_keys(f(arts, ARTICLES)), f(refs, schema("refs")), similar, relations, amendments, drafts, sources, links)
    found = sorted(tuple(r) for r in build.problems(bad, sample=True).collect())
    assert found == sorted([
        ("law_id_repeated", "a"), ("law_id_not_slug", "Bad Id"), ("law_url_not_https", "c"), ("article_id_repeated", "a:1"), ("article_id_not_of_law_and_number", "a:x"), ("parent_not_there", "a:3"), ("name_only_law_with_text", "d:1"),
        *[("sample_not_labelled", i) for i in ("a:1", "a:1", "a:1.1", "a:3.1", "a:x", "d:1")],
        ("ref_from_unknown", "a:none"), ("ref_to_unknown_law", "q"), ("ref_to_unknown_article", "a:7"), ("missing_flag_wrong", "a:1.1"), ("missing_flag_wrong", "e:1"), ("missing_flag_wrong", "a:1"), ("missing_with_target", "a:1"),
        ("fact_not_certain", "a:1"), ("confidence_out_of_range", "a:1"),
        ("similar_orphan", "zz:1"), ("similar_orphan", "yy:1"), ("similar_without_model", "yy:1"), ("relations_orphan", "a:9"), ("relations_without_model", "a:1"), ("amendments_orphan", "a:8"), ("amendments_without_model", "a:8"),
        ("source_url_not_https", "s1"), ("link_of_unknown_article", "a:6"), ("link_to_unknown_source", "s2"), ("link_without_model", "a:1"),
        ("draft_of_unknown_law", "zz"), ("draft_of_unknown_law", "yy"), ("draft_amends_unknown_article", "a:77"),
    ])
    assert build.problems(replace(bad, similar=None, relations=None, amendments=None, drafts=None, intl_links=None)).count() > 0


def test_suggestions_have_their_place(spark, store):
    similar = spark.createDataFrame([("l0:1", "l1:1", 0.90004, "m"), ("l0:1", "l2:1", 0.90001, "m"), ("l0:1.1", "l1:1", 0.95, "m"), ("l0:1", "l0:2", 0.99, "m")], schema("similar"))
    relations = spark.createDataFrame([("l0:1", "l1:1", "overlap", 0.5, "e", "m"), ("l0:1.1", "l1:1", "overlap", 0.5, "e", "m"), ("l0:1", "l3:1", "overlap", 0.7, "e", "m")], schema("relations"))
    rows = services.law_connections(replace(store, similar=similar, relations=relations), "l0").where("place IS NOT NULL").orderBy("list", "place").collect()
    assert [(r.list, r.place, r.article_id, r.anchor_number) for r in rows] == [
        ("overlaps", 1, "l3:1", "1"), ("overlaps", 2, "l1:1", "1.1"), ("overlaps", 3, "l1:1", "1"), ("similar", 1, "l1:1", "1.1"), ("similar", 2, "l1:1", "1"), ("similar", 3, "l2:1", "1"),
    ]


def test_ranges_are_filled_whole_and_only_with_what_exists(spark):
    rows = [("l", f"1.{k}", "art1", f"1.{k}") for k in range(1, 61) if k != 30] + [("l", "2.1", "art2", "энэ хуулийн 1.1-1.60-д, энэ хуулийн 3.1-3.999999999-т заасан"), ("l", "3.2", "art3", "энэ зүйлийн 3.1-3.3-т"), ("l", "3.7", "art3", "")]
    provisions = spark.createDataFrame(rows, "law_id string, id string, article string, text string")
    articles = spark.createDataFrame([("l", "art1"), ("l", "art2")], "law_id string, id string")
    links = structure.extract_links(provisions, articles).collect()
    assert sorted(r.target for r in links if r.from_id == "2.1") == sorted([f"1.{k}" for k in range(1, 61) if k != 30] + ["3.2", "3.7"])
    assert [r.target for r in links if r.from_id == "3.2"] == []


def test_recursion_goes_on_from_what_cites_nothing(spark):
    refs = spark.createDataFrame([("y:1", "x:1"), ("y:1", "x:1"), ("z:2.1", "y:1"), ("w:3", "z:2"), ("s:1", "y:1"), ("v:1", None)], "from_article_id string, to_article_id string")
    seeds, frontier = (spark.createDataFrame([(i,)], "article_id string") for i in ("s:1", "x:1"))
    found = [sorted(map(tuple, f(refs, frontier, seeds, 4).collect())) for f in (traverse.recursive_refs, traverse.indirect_refs)]
    assert found[0] == found[1] == [("w:3", "z:2", "z:2.1", 4), ("y:1", "x:1", "x:1", 2), ("y:1", "x:1", "x:1", 2), ("z:2.1", "y:1", "y:1", 3)]


def test_recursion_deals_no_references_anew(spark, tmp_path, monkeypatch):
    walks, written = [], traverse.written
    monkeypatch.setattr(traverse, "written", lambda frame, kind: walks.append(frame._jdf.queryExecution().optimizedPlan().toString()) or written(frame, kind))
    chain = spark.createDataFrame([(f"a:{i}", f"a:{i // 2}") for i in range(2, 60)], "from_article_id string, to_article_id string")
    frames = {"refs": chain, "seeds": spark.createDataFrame([("a:4",)], "article_id string"), "frontier": spark.createDataFrame([("a:5",)], "article_id string")}
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}")
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in frames}
    found = traverse.recursive_refs(read["refs"], read["frontier"], read["seeds"], 3)
    plan = found._jdf.queryExecution()
    assert "UnionLoop" not in plan.optimizedPlan().toString() and "Exchange hashpartitioning" not in plan.executedPlan().toString()
    assert len(walks) == 1 and walks[0].count("UnionLoop ") == 1 and "strategy=broadcast" in walks[0]
    assert found.count() == traverse.indirect_refs(read["refs"], read["frontier"], read["seeds"], 3).count() == 6
