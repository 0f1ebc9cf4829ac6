"""Dictionary matches against a scan by hand, inflected words, the exploration load, and topics against plain k-means."""

import random
import re

import numpy as np
import pytest

from lexweave.operators import explore, phrases, similarity, structure
from lexweave.operators.extract import mentions_of, stem_pattern


def tokens(text):
    return re.findall(r"\w+|[^\s\w]", (text or "").lower())


def by_hand(texts, wanted):
    out = set()
    for i, text in texts:
        own, spans = tokens(text), {}
        for name, phrase in wanted:
            p = tokens(phrase)
            for at in range(len(own) - len(p) + 1 if p else 0):
                if own[at : at + len(p)] == p:
                    spans.setdefault((at + 1, at + 1 + len(p)), set()).add(name)
        taken = []
        for s, e in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
            if not any(s < f and b < e for b, f in taken):
                taken.append((s, e))
                out |= {(str(i), s, e, n) for n in spans[s, e]}
    return out


def test_matches_equal_a_scan(spark):
    rng = random.Random(3)
    letters = ["a", "b", "c", "Д", ",", "a1", "é"]
    text = lambda n: rng.choice([" ", "  ", "\n"]).join(rng.choice(letters) for _ in range(n))
    texts = [(i, text(rng.choice([0, 1, 5, 40, 400]))) for i in range(60)] + [(100, None), (101, ""), (102, "a,b")]
    wanted = [(f"p{k}", text(rng.randint(1, 7))) for k in range(40)] + [("same", "a b"), ("again", "A  B"), ("none", ""), ("null", None), ("same", "a b")]
    found = phrases.phrase_matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(wanted, "name string, phrase string"))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == by_hand(texts, wanted) and len(set(rows)) == len(rows) > 500


def test_matches_within_a_law_and_inflected(spark):
    wanted = [("l1", "t1", "ажилтан"), ("l1", "t2", "ажил олгогч"), ("l1", "t3", "ажил"), ("l2", "t4", "ажил"), ("l2", "t5", "цалин хөлс")]
    texts = [
        ("l1", "a", "Ажилтны эрх, ажил олгогчийн үүрэг"), ("l1", "b", "ажилд орно; ажилтанд цалин хөлс"), ("l2", "a", "Цалин хөлсийг ажилтны"), ("l2", "b", "цалин, хөлс"), ("l1", "c", None), ("l1", "d", "хамтын-ажиллагаа"),
    ]
    found = phrases.phrase_matches(spark.createDataFrame(texts, "law_id string, id string, text string"), spark.createDataFrame(wanted, "law_id string, name string, phrase string"), True, ("law_id",)).collect()
    got = {(r.law_id, r.id): set() for r in found}
    for r in found:
        got[r.law_id, r.id].add(r.name)
    wanted_names = {}
    for law, i, text in texts:
        patterns = sorted(((n, re.compile(stem_pattern(p))) for own, n, p in wanted if own == law), key=lambda x: -len(x[1].pattern))
        if names := set(mentions_of(text or "", patterns)):
            wanted_names[law, i] = names
    assert got == wanted_names


def test_dictionary_plan_has_no_nested_loop(spark):
    rows = spark.createDataFrame([("1", "a b")], "id string, text string")
    plan = phrases.phrase_matches(rows, spark.createDataFrame([("n", "a b")], "name string, phrase string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Join Inner") == 2


LAW = """МОНГОЛ УЛСЫН ХУУЛЬ
НЭГДҮГЭЭР БҮЛЭГ
Нийтлэг үндэслэл
1 дүгээр зүйл.Зорилт
1.1.Ажилтны эрхийг хамгаалах, ажил олгогч хариуцна.
2 дугаар зүйл.Хүрээ
2.1.Энэ хуулийн 1.1-д заасан ажилтан хөдөлмөр эрхэлнэ.
3 дугаар зүйл.Үүрэг
3.1.Ажил олгогчийн үүрэг. Шүүх шийднэ.
4 дүгээр зүйл.Нэр томьёо
4.1."ажилтан" гэж хөдөлмөр эрхлэх хүнийг;
4.2."ажил олгогч" гэж хүн авах этгээдийг."""


def test_load_fills_every_table(spark):
    parsed = structure.parse_structure(spark.createDataFrame([("l", LAW), ("m", LAW.replace("4.1.", "4.3."))], "law_id string, text string"))
    actors = spark.createDataFrame([("actor:court", "шүүх", "state", "шүүх"), ("actor:none", "сум", "state", "сум")], "id string, name string, category string, phrase string")
    x = explore.load(parsed, actors, topic_count=3)
    rows = lambda f, *c: sorted(tuple(r[k] for k in c) for r in f.where("law_id = 'l'").collect())
    assert rows(x.terms, "id", "defined_in") == [("term:ажил олгогч", "4.2"), ("term:ажилтан", "4.1")]
    assert rows(x.mentions, "from_id", "to_id") == [("1.1", "term:ажил олгогч"), ("1.1", "term:ажилтан"), ("2.1", "term:ажилтан"), ("3.1", "actor:court"), ("3.1", "term:ажил олгогч")]
    assert rows(x.refs, "from_id", "to_id") == [("2.1", "1.1")]
    assert {n: f.count() > 0 for n, f in vars(x).items() if n not in ("sections", "amendments", "external", "norms", "similar")} == {n: True for n in ("chapters", "articles", "provisions", "refs", "mentions", "terms", "actors", "topics")}
    assert all(f is not None and f.columns for f in vars(x).values()) and x.similar.columns == ["law_id", "a", "b", "score"]
    assert [(r.term if "term" in r else r.name, r.mentioned) for r in explore.term_usage(x).where("name = 'ажилтан'").collect()] == [("ажилтан", 2)] * 2
    assert sum(r["size"] for r in x.topics.select("topic", "size").distinct().collect()) == 8


def plain_topics(vectors, k, seed, rounds=50):
    centres = similarity.first_centres(vectors, k, seed)
    for _ in range(rounds):
        label = (vectors @ centres.T).argmax(1)
        moved = centres.copy()
        for t in range(len(centres)):
            if (label == t).any() and np.linalg.norm(total := vectors[label == t].sum(0)) > 0:
                moved[t] = total / np.linalg.norm(total)
        if np.abs(moved - centres).max() < 1e-12:
            break
        centres = moved
    return (vectors @ centres.T).argmax(1), centres


@pytest.mark.parametrize("k, seed", [(4, 0), (7, 3)])
def test_topics_equal_plain_k_means(spark, k, seed):
    rng = np.random.default_rng(5)
    rows = np.eye(6)[rng.integers(0, 6, 200)] * rng.uniform(1, 3, (200, 1)) + 0.25 * rng.normal(size=(200, 6))
    frame = spark.createDataFrame([*[(i, r) for i, r in enumerate(rows.tolist())], (900, [0.0] * 6), (901, None)], "id long, vec array<double>").repartition(3)
    found = {r.id: r.topic for r in similarity.topics(frame, k, seed).collect()}
    order = [r.id for r in frame.where("id < 900").selectExpr("id", "xxhash64(id) AS h").orderBy("h", "id").collect()]
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    label, centres = plain_topics(unit[order], k, seed)
    groups = {}
    for i, t in zip(order, label.tolist()):
        groups.setdefault(t, set()).add(i)
    numbered = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    assert found == {i: n for n, g in enumerate(numbered) for i in g} and len(found) == 200
    first = similarity.first_centres(unit[order], k, seed)
    assert (unit[order] @ centres.T).max(1).sum() >= (unit[order] @ first.T).max(1).sum()


def test_topics_of_few_directions(spark):
    frame = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 2.0]) for i in range(9)], "id long, vec array<double>")
    assert sorted({(r.topic) for r in similarity.topics(frame, 5).collect()}) == [0, 1]
    assert similarity.topics(frame.where("false"), 2).count() == 0
