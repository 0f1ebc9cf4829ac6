"""Whole answers as JSON on the hand-written graph, recorded and replayed; and an export as one ordered file."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_graph import store  # noqa: F401  the hand-written graph

from lexweave.operators import answers, services
from lexweave.sources.files import CSV_COLUMNS, write_csv
from lexweave.sources.schemas import schema

REQUESTS = [
    ("health", {}), ("laws_list", {}), ("laws_list", {"query": "хуучин б"}), ("law_detail", {"law_id": "b"}), ("law_articles", {"law_id": "a"}), ("law_connections", {"law_id": "a"}), ("article_connections", {"article_id": "a:80"}),
    ("impact", {"article_id": "a:80.1", "new_text": "цагийн бичвэр", "depth": 2}), ("impact", {"law_id": "a", "new_name": "Шинэ", "depth": 2}), ("drafts_list", {}), ("draft_detail", {"draft_id": "d1"}), ("draft_gap", {"draft_id": "d1"}),
    ("international", {"article_id": "a:80"}), ("amendment", {"article_id": "a:80"}), ("relation_detail", {"a": "b:2", "b": "a:80.1"}), ("search", {"query": "цаг 80"}),
]


@pytest.fixture(scope="module")
def full(spark, store):  # noqa: F811
    op = ("replace", "a", "80.1", "a:80.1", "x", "y", "raw", False, False)
    return replace(store, drafts=spark.createDataFrame([("d1", "1", "t", "a", None, ["a:80.1", "a:none"], ["b"], "u", [op], [])], schema("drafts")))


@pytest.fixture(scope="module")
def said(full):
    out = {}
    for name, request in REQUESTS:
        (row,) = answers.answer(full, name, **request).collect()
        assert row.name == name and json.loads(row.request) == request
        out[name, json.dumps(request, ensure_ascii=False)] = json.loads(row.response)
    return out


def of(said, name, k=0):
    return [v for (n, _), v in said.items() if n == name][k]


def test_laws(said):
    assert of(said, "health") == {"status": "ok", "dataset": "real", "graph": "spark"}
    assert [law["law_id"] for law in of(said, "laws_list")["laws"]] == ["a", "b", "c"]
    assert of(said, "laws_list", 1) == {"laws": [{"law_id": "b", "name": "Б хууль", "former_names": ["хуучин Б хууль"], "article_count": 4, "short_names": [], "text_available": True, "source_url": "https://x.example/b"}]}
    detail = of(said, "law_detail")
    assert detail["law"] == {"law_id": "b", "name": "Б хууль", "former_names": ["хуучин Б хууль"], "short_names": [], "adopted_date": None, "source_url": "https://x.example/b", "text_available": True}
    assert detail["articles"][1] == {"article_id": "b:1.1", "number": "1.1", "title": None, "text": "b 1.1 цагийн бичвэр", "parent_number": "1"}
    assert [a["number"] for a in of(said, "law_articles")["articles"]] == ["9", "9¹", "10", "80", "80.1", "80.1.2", "80.2", "801"]


def test_connections(said):
    found = of(said, "article_connections")
    assert found["article"] == {"article_id": "a:80", "number": "80", "title": None, "text": "a 80 цагийн бичвэр", "parent_number": None, "law_id": "a", "law_name": "А хууль", "source_url": "https://x.example/a#80"}
    assert [(g["law_id"], g["count"], [i["article_id"] for i in g["items"]]) for g in found["incoming"]] == [("b", 2, ["b:1", "b:2"]), ("a", 1, ["a:9"]), ("c", 1, ["c:6"])]
    assert found["outgoing"][0]["items"] == [{
        "law_id": "b", "law_name": "Б хууль", "article_id": "b:1", "number": "1", "snippet": "b 1 цагийн бичвэр", "source_url": "https://x.example/b#1", "type": "fact", "confidence": 1.0, "flags": {"uses_old_name": False, "target_missing": False},
        "anchor_number": "80.1", "score": None, "explanation": None, "raw_text": "b 1", "matched_name": "b", "current_number": None, "model": None,
    }]
    (missing,) = found["missing_target_refs"]
    assert missing["items"][0]["flags"] == {"uses_old_name": False, "target_missing": True} and "80.9" in missing["items"][0]["explanation"]
    assert [(i["article_id"], i["score"]) for i in found["similar"]] == [("b:2", 0.9)] and [i["article_id"] for i in found["conflicts"]] == ["b:2"] and found["overlaps"] == []
    assert found["totals"] == {"incoming": 4, "outgoing": 1, "former_name_refs": 0, "missing_target_refs": 1, "similar": 1, "overlaps": 0, "conflicts": 1}
    assert of(said, "law_connections")["totals"]["incoming"] == 5 and [g["law_id"] for g in of(said, "law_connections")["former_name_refs"]] == ["b"]


def test_changes_and_drafts(said):
    text, name = of(said, "impact"), of(said, "impact", 1)
    ids = lambda groups: sorted(i["article_id"] for g in groups for i in g["items"])
    assert (ids(text["depth1"]), ids(text["depth2"])) == (["a:80.2", "b:1", "b:2"], ["c:5"]) and text["totals"] == {"laws": 3, "articles": 4, "direct": 3, "indirect": 1}
    assert text["note"] == answers.IMPACT_NOTE and {n["law_id"] for n in text["new_similar"]} <= {"b", "c"} and len(text["new_similar"]) == 6
    assert ids(name["depth1"]) == ["b:1", "b:2", "b:3", "c:5", "c:6"] and name["new_similar"] == [] and all(i["flags"]["uses_old_name"] for g in name["depth1"] for i in g["items"])
    assert of(said, "drafts_list") == {"drafts": [{"draft_id": "d1", "lawforum_id": "1", "title": "t", "target_law_id": "a", "source_url": "u"}]}
    assert of(said, "draft_gap") == {"covered": [{"law_id": "b", "law_name": "Б хууль"}], "missing": [], "review": [{"law_id": "c", "law_name": "В хууль"}], "found": 2}
    detail = of(said, "draft_detail")
    assert detail["operations"][0]["provision_text"] == "a 80.1 цагийн бичвэр" and detail["cosubmitted"] == [{"law_id": "b", "name": "Б хууль", "article_count": 4}]


def test_suggestions_and_search(said):
    (source,) = of(said, "international")["sources"]
    assert (source["source_id"], source["anchor_number"], source["relevance"], source["label"]) == ("s1", "80.2", 0.9, "Санал, 90%")
    assert of(said, "amendment") == {"article_id": "a:80.1", "reason": "why", "suggested_text": "new", "confidence": 0.5, "model": "m", "sources": [{"id": "s1", "kind": "source", "text": "T1"}, {"id": "b:2", "kind": "article", "text": "b 2 цагийн бичвэр"}]}
    pair = of(said, "relation_detail")
    assert (pair["kind"], pair["a"]["article_id"], pair["b"]["law_name"], pair["resolution"]["suggested_text"], pair["resolution"]["on_pair"]) == ("conflict", "b:2", "А хууль", "new", True)
    assert [p["article_id"] for p in of(said, "search")["provisions"]] == ["a:80", "a:80.1", "a:80.1.2", "a:80.2"] and of(said, "search")["laws"] == []


def test_recorded_answers_are_replayed(full, tmp_path):
    some = [r for r in REQUESTS if r[0] in ("laws_list", "law_detail", "article_connections", "draft_gap", "international")]
    answers.record(full, some, str(tmp_path / "kept"))
    assert answers.replay(full, str(tmp_path / "kept")).count() == 0
    other = replace(full, intl_links=full.intl_links.withColumn("relevance", F.col("relevance") / 2), drafts=full.drafts.withColumn("cosubmitted_law_ids", F.array().cast("array<string>")))
    assert sorted(r.name for r in answers.replay(other, str(tmp_path / "kept")).collect()) == ["draft_gap", "international"]
    with pytest.raises(KeyError):
        answers.answer(full, "draft_gap", draft_id="none")
    assert answers.answer(full, "article_connections", article_id="a:none").count() == 0


def test_an_export_is_one_ordered_file(full, tmp_path):
    rows = services.export(full, "connections", article_id="a:80")
    rows = rows.unionByName(rows.limit(1).withColumn("snippet", F.lit('a "quoted", text'))).repartition(3)
    write_csv(rows, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("*.csv")
    raw = file.read_bytes().decode("utf-8")
    assert raw.startswith("﻿" + CSV_COLUMNS[0]) and raw.count("﻿") == 1 and raw.count(CSV_COLUMNS[-1] + "\r\n") == 1
    lines = raw.removesuffix("\r\n").split("\r\n")
    assert len(lines) == rows.count() + 1 and '"a ""quoted"", text"' in raw
    at = CSV_COLUMNS.index("relationship")
    said = [line.split(",")[at] for line in lines[1:]]
    assert said == sorted(said)
