"""Exploration queries on a small parsed graph, the build from texts to the processed dataset, and streams."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import build, explore, relational, similarity, structure
from lexweave.operators.extract import parse_law_texts
from lexweave.operators.store import with_keys
from lexweave.streaming import refs as stream


@pytest.fixture(scope="module")
def x(spark):
    f = spark.createDataFrame
    articles = f([("l", "art1", "1", "Зорилт", "ch1", ""), ("l", "art2", "2", "Хүрээ", "ch1.sec1", ""), ("l", "art10", "10", "Бусад", "ch2", "")], "law_id string, id string, number string, title string, chapter string, text string")
    rows = [("1.1", "art1", "art1", "хориглоно", "хүчинтэй", ["хориглол"]), ("1.2", "art1", "art1", "эрхтэй", "хүчинтэй", ["эрх"]), ("1.2.1", "art1", "1.2", "нарийн", "хүчинтэй", []), ("2.1", "art2", "art2", "хуучин", "хүчингүй", [])]
    provisions = f([("l", i, i, a, p, t, s, m) for i, a, p, t, s, m in rows], "law_id string, id string, number string, article string, parent string, text string, status string, modality array<string>")
    edge = "law_id string, from_id string, to_id string, role string"
    return explore.Exploration(
        chapters=f([("l", "ch1", 1, "Нэг"), ("l", "ch2", 2, "Хоёр")], "law_id string, id string, number int, title string"),
        sections=f([("l", "ch1.sec1", 1, "Дэд", "ch1")], "law_id string, id string, number int, title string, chapter string"),
        articles=articles, provisions=provisions,
        refs=f([("l", "1.1", "1.2", None), ("l", "1.2", "art2", "үл хамаарах"), ("l", "1.2.1", "1.2", None), ("l", "1.2", "1.1", None)], edge),
        amendments=f([("l", "2.1", "2022-01-05", "хүчингүй"), ("l", "1.2", "2022-01-05", "хүчингүй"), ("l", "1.1", "2021-01-01", "нэмсэн")], "law_id string, target string, date string, type string"),
        external=f([("l", "1.1", "law", "Ойн", "r"), ("l", "1.2", "law", "Ойн", "r"), ("l", "1.2", "law", "Усны", "r")], "law_id string, from_id string, kind string, target string, raw_text string"),
        mentions=f([("l", "1.1", "term:a"), ("l", "1.2", "term:a"), ("l", "1.2", "actor:b")], "law_id string, from_id string, to_id string"),
        terms=f([("l", "term:a", "a", "d", "4.1"), ("l", "term:z", "z", "d", "4.2")], "law_id string, id string, name string, definition string, defined_in string"),
        actors=f([("actor:b", "b", "шүүх")], "id string, name string, category string"),
        norms=f([("l", "1.2", "duty", "b", "c", "pay", None), ("l", "1.1", "right", "c", None, "ask", None)], "law_id string, id string, kind string, bearer string, towards string, action string, condition string"),
        topics=f([(0, "t", 2, "l", "art1"), (0, "t", 2, "l", "art2")], "topic int, name string, size int, law_id string, article string"),
        similar=f([("l", "1.1", "1.2", 0.9), ("l", "2.1", "1.1", 0.95)], "law_id string, a string, b string, score double"),
    )


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_exploration_queries(x):
    assert rows(explore.chapter_sizes(x, "l")) == [(1, "Нэг", 2), (2, "Хоёр", 1)]
    assert [r.id for r in explore.article_tree(x, "l", "art1").collect()] == ["1.1", "1.2", "1.2.1"]
    assert rows(explore.provisions_that(x, "хориглол", "term:a")) == [("1.1", "хориглоно")]
    assert rows(explore.provisions_that(x, "эрх", "term:a", 25)) == [("1.2", "эрхтэй")]
    assert [(r.name, r.mentioned) for r in explore.term_usage(x).collect()] == [("a", 2), ("z", 0)]
    assert rows(explore.most_cited(x)) == [("1.2", "Provision", 2), ("2", "Article", 1), ("1.1", "Provision", 1)]
    assert sorted("-".join(r.path) for r in explore.citation_paths(x, "l", "1.1").collect()) == ["1.1-1.2", "1.1-1.2-1.1", "1.1-1.2-art2"]
    assert rows(explore.history(x)) == [("2021-01-01", "нэмсэн", 1, ["1.1"]), ("2022-01-05", "хүчингүй", 2, ["1.2", "2.1"])]
    assert rows(explore.repealed(x)) == [("2.1", "хуучин")]
    assert rows(explore.external_laws(x)) == [("Ойн", 2, ["1.1", "1.2"]), ("Усны", 1, ["1.2"])]
    assert rows(explore.category_mentions(x, "шүүх")) == [("b", 1, ["1.2"])]
    assert rows(explore.co_mentions(x, ["term:a", "actor:b"])) == [("1.2", "эрхтэй")]
    assert rows(explore.topic_articles(x)) == [("t", 2, 2, ["1 Зорилт", "2 Хүрээ"])]
    assert [(r.number, r.score) for r in explore.neighbours(x, "l", "1.1").collect()] == [("2.1", 0.95), ("1.2", 0.9)]
    assert rows(explore.norms_between(x, "duty", "b", "c")) == [("1.2", "pay", None)]
    assert rows(explore.actor_matrix(x)) == [("b", "HAS_DUTY", "c", 1)]
    assert rows(explore.refs_with_role(x, "үл хамаарах")) == [("1.2", "эрхтэй", "2")]
    assert dict(rows(explore.histogram_of_labels(x))) == {"Article": 3, "Provision": 4, "Chapter": 2, "REFERS_TO": 4, "AMENDED_BY": 3}
    assert sorted(rows(explore.article_chain(x)), key=str) == [("l", "art1", "art2"), ("l", "art10", None), ("l", "art2", "art10")]


def test_retrieval_context(x, spark):
    hits = spark.createDataFrame([("l", "1.2.1", 2.0), ("l", "1.1", 1.0)], "law_id string, id string, score double")
    found = explore.retrieval_context(x, hits).collect()
    assert [(r.article_number, r.parent_text, r.number, r.cites) for r in found] == [("1", "эрхтэй", "1.2.1", ["1.2"]), ("1", None, "1.1", ["1.2"])]


def test_repealed_closure_takes_what_is_below(spark):
    provisions = spark.createDataFrame([("l", "1.1", "art1", "хүчингүй"), ("l", "1.1.1", "art1", "x"), ("l", "1.10", "art1", "x"), ("l", "2.1", "art2", "x")], "law_id string, id string, article string, status string")
    notes = spark.createDataFrame([("l", "art2", "хүчингүй")], "law_id string, target string, type string")
    assert sorted(r.id for r in structure.repealed_ids(provisions, notes).collect()) == ["1.1", "1.1.1", "2.1", "art2"]


def test_latest_version_prefers_what_is_in_force(spark):
    data = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True), ("b", 2, True), ("c", 1, False), ("c", 2, False)], "k string, at int, gone boolean")
    found = relational.latest_version(data, ["k"], F.col("gone"), [F.desc("at")])
    assert sorted((r.k, r.at) for r in found.collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_names_resolve_with_precedence(spark):
    registry = spark.createDataFrame([("x", "l1", "alias", 5), ("x", "l2", "current", 1), ("y", "l3", "alias", 1), ("y", "l4", "alias", 2)], "variant string, law_id string, kind string, position int")
    found = relational.resolve_names(spark.createDataFrame([("X",), ("Y",), ("Z",)], "name string"), registry, F.lower("name"), F.col("variant"))
    assert sorted((r.name, r.law_id) for r in found.collect()) == [("X", "l2"), ("Y", "l4"), ("Z", None)]


def test_build_from_texts(spark):
    texts = [("ajlyn-tukhai-khuuli", "1 дүгээр зүйл.Нэг\n1.1.Ойн тухай хуулийн 3.1-д заасан долоо хоногт 40 цаг ажиллана."), ("amraltyn-tukhai-khuuli", "1 дүгээр зүйл.Нэг\n1.1.Ажлын тухай хуулийн 9 дүгээр зүйлд\n1.2.долоо хоногт 48 цаг ажиллана заасан")]
    articles = with_keys(parse_law_texts(spark.createDataFrame(texts, "law_id string, text string")).drop("block"))
    laws = spark.createDataFrame([("ajlyn-tukhai-khuuli", "Ажлын тухай хууль", [], [], None, "https://x", True), ("amraltyn-tukhai-khuuli", "Амралтын тухай хууль", [], [], None, "https://x", True)], "law_id string, name string, former_names array<string>, short_names array<string>, adopted_date string, source_url string, text_available boolean")
    bills = spark.createDataFrame([("7", "Ажлын тухай хуульд өөрчлөлт оруулах тухай", "Ажлын тухай хуулийн 1.1 дэх хэсгийн \"40\" гэснийг \"38\" гэж өөрчилсүгэй.", "https://b", ["Амралтын тухай хуульд", "Ажлын тухай хуульд"], None, None)], "lawforum_id string, title string, text string, source_url string, cosubmitted array<string>, target_law string, new_name string")
    store = build.build(laws, articles, bills=bills)
    assert sorted((r.from_article_id, r.to_law_id, r.to_number, r.target_missing) for r in store.refs.collect()) == [("ajlyn-tukhai-khuuli:1.1", "oin-tukhai-khuuli", "3.1", False), ("amraltyn-tukhai-khuuli:1.1", "ajlyn-tukhai-khuuli", "9", True)]
    assert [(r.law_id, r.text_available) for r in store.laws.where("NOT text_available").collect()] == [("oin-tukhai-khuuli", False)]
    draft = store.drafts.first()
    assert (draft.draft_id, draft.target_law_id, draft.amended_article_ids, draft.cosubmitted_law_ids) == ("draft-7", "ajlyn-tukhai-khuuli", ["ajlyn-tukhai-khuuli:1.1"], ["amraltyn-tukhai-khuuli"])
    assert build.problems(store).collect() == []
    assert build.summary(store).first().asDict() == {"laws": 3, "name_only": 1, "articles": 5, "refs": 2, "old_name": 0, "missing": 1, "similar": store.similar.count(), "relations": store.similar.count(), "drafts": 1}


def test_neighbours_centroids_and_topics(spark):
    vectors = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [0.0, 1.0]), (4, "b", [0.1, 0.9]), (5, "b", [1.0, 0.01])], "id long, group string, vec array<double>")
    near = similarity.nearest(vectors, vectors, 1, same_group=False)
    assert {r.id: r.other for r in near.collect()} == {1: 5, 2: 5, 3: 2, 4: 2, 5: 1}
    middle = {r.group: r.vec for r in similarity.centroids(vectors.where("id < 5").select("group", "vec")).collect()}
    assert abs(sum(v * v for v in middle["a"]) - 1) < 1e-9 and middle["a"][0] > 0.99
    topic = {r.id: r.topic for r in similarity.topics(vectors.select("id", "vec"), 2).collect()}
    assert topic[1] == topic[2] == topic[5] != topic[3] == topic[4]


def test_streamed_references_are_counted_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = '{"from_article_id":"a:1","to_law_id":"b","to_number":"2"}\n'
    (folder / "1.json").write_text(line * 3 + line.replace("a:1", "a:2"))
    query = stream.first_refs(stream.read_refs(spark, str(folder))).writeStream.foreachBatch(stream.merge_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_number_keys_are_made_once_per_row_before_a_sort(x):
    for rows in (explore.norms_between(x, "duty", "a", "b"), explore.article_tree(x, "l", "art1"), explore.provisions_that(x, "duty", "a"), explore.most_cited(x)):
        sorts = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Sort [" in line]
        assert sorts and not any("regexp" in line for line in sorts)
        assert "key" not in rows.columns
