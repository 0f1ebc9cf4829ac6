"""Names, citations, amendments and documents: the forms that a text can take."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import extract, similarity, structure
from lexweave.operators.extract import Name, Registry
from lexweave.operators.store import GraphStore, with_keys
from lexweave.sources import files
from lexweave.sources.schemas import schema

L = "khodolmor"
REGISTRY = Registry([
    Name(L, "Хөдөлмөрийн тухай хууль", "Хөдөлмөрийн тухай хууль", "current"), Name("aj", "Ажлын тухай хууль", "Ажлын тухай хууль", "current"),
    Name("aj", "Хуучин ажлын тухай хууль", "Ажлын тухай хууль", "former"), Name("irg", "Иргэний хууль", "Иргэний хууль", "current"), Name("zz", "Ажлын тухай хууль", "x", "alias"),
])


def numbers(text, law="self", article="80"):
    return [(c.to_law_id, c.to_number) for c in extract.citations(text, law, article, REGISTRY)]


@pytest.mark.parametrize("text,expected", [
    ("Хөдөлмөрийн тухай хуулийн 15.1-д заасан", [(L, "15.1")]),
    ("Хөдөлмөрийн тухай хуулийн 6 дугаар зүйлийн 8 дахь хэсэгт", [(L, "6.8")]),
    ("Хөдөлмөрийн тухай хуулийн 3 дугаар зүйлийн 2 дахь хэсгийн 1, 2, 4 дэх заалтад", [(L, "3.2.1"), (L, "3.2.2"), (L, "3.2.4")]),
    ("Хөдөлмөрийн тухай хуулийн 12 дугаар зүйлд", [(L, "12")]),
    ("Хөдөлмөрийн тухай хуулийн 18, 19-21 дүгээр зүйлд", [(L, n) for n in ("18", "19", "20", "21")]),
    ("Хөдөлмөрийн тухай хуулийн 3.1.1-3.1.4-д", [(L, f"3.1.{k}") for k in range(1, 5)]),
    ("Иргэний хуулиар зохицуулна", [("irg", None)]),
    ("энэ хуулийн 80.1.4, 80.1.5-д", [("self", "80.1.4"), ("self", "80.1.5")]),
    ("энэ хуульд заасан", []),
    ("энэ зүйлийн 2 дахь хэсэгт", [("self", "80.2")]),
    ("энэ зүйлийн 2 дахь хэсгийн 3 дахь заалтад", [("self", "80.2.3")]),
    ("ямар ч ишлэл алга 12.3", []),
    ("Хөдөлмөрийн тухай хуулийн 7.1 дүгээр зүйлийн 2, 3 дахь хэсэгт", [(L, "7.1.2"), (L, "7.1.3")]),
    ("Хөдөлмөрийн тухай хуулийн 5 дугаар зүйлийн 2 дахь заалтад", [(L, "5.2")]),
    ("Хөдөлмөрийн тухай хуулийн 5 дугаар зүйл, 6.1-д, 7-д болон 8 дугаар зүйлд", [(L, "5"), (L, "6.1"), (L, "7"), (L, "8")]),
    ("Хөдөлмөрийн тухай хуулийн 1-99 дүгээр зүйлд", [(L, "1"), (L, "99")]),
    ("Хөдөлмөрийн тухай хуулийн 3.1.1 – 4.1.2-т", [(L, "3.1.1"), (L, "4.1.2")]),
    ("Хөдөлмөрийн тухай хуулийн 15 цаг", [(L, None)]),
    ("ХӨДӨЛМӨРИЙН  тухай\nхуулиас 5-д", [(L, "5")]),
    ("энэ зүйлийн 1.2-1.4-т, 80.7-д", [("self", f"80.{k}") for k in ("1.2", "1.3", "1.4", "7")]),
])
def test_citation_forms(text, expected):
    assert numbers(text) == expected


def test_longest_name_wins_and_old_names_are_marked():
    (c,) = extract.citations("Хуучин ажлын тухай хуулийн 5.1-д", "s", "1", REGISTRY)
    assert (c.to_law_id, c.uses_old_name, c.raw_text) == ("aj", True, "Хуучин ажлын тухай хуулийн 5.1-д")
    assert REGISTRY.resolve("ажлын  тухай хуулийн").law_id == "aj"


def test_unknown_law_gets_an_id_from_its_name():
    (f,) = REGISTRY.find("Ойн тухай хуулийн")
    assert (f.name.kind, f.name.law_id) == ("unknown", "oin-tukhai-khuuli") and REGISTRY.find("Ойн тухай хуулийн", unknown=False) == []


def test_chapter_numbered_codes_count_from_two_parts(spark):
    """Two parts where they are a number of the law and the first alone is not."""
    rows = [("code", "7.1"), ("code", "7.1.2"), ("code", "8.1.1"), ("plain", "7"), ("plain", "7.1"), ("plain", "7.1.2")]
    found = extract.with_article(spark.createDataFrame(rows, "law_id string, number string")).collect()
    assert {(r.law_id, r.number): r.article for r in found} == {("code", "7.1"): "7.1", ("code", "7.1.2"): "7.1", ("code", "8.1.1"): "8", ("plain", "7"): "7", ("plain", "7.1"): "7", ("plain", "7.1.2"): "7"}
    assert numbers("энэ зүйлийн 1 дэх хэсэгт", article="7.1") == [("self", "7.1.1")]


def test_names_do_not_touch_and_need_whole_words():
    taken = extract.Spans()
    assert [taken.add(*x) for x in ((5, 9), (0, 5), (4, 6), (9, 12), (8, 9), (20, 30), (12, 20))] == [True, True, False, True, False, True, True]
    assert REGISTRY.find("Иргэний хуультайгаа", unknown=False) == [] and REGISTRY.find("бИргэний хууль", unknown=False) == []
    assert [f.name.law_id for f in REGISTRY.find("Иргэний хууль, Ажлын тухай хуулиар")] == ["irg", "aj"] and Registry([]).find("Иргэний хууль") == []


def test_flags_are_joined(spark):
    rows = [("a", "a:1", "1", None, "энэ хуулийн 1, 2 дугаар зүйлд, Ажлын тухай хуулийн 9.1, 5-д"), ("a", "a:2", "2", None, "Хөдөлмөрийн тухай хуулийн 3.3-д энэ хуулийн 1.1, 1.1-д"), ("aj", "aj:5", "5", None, None)]
    articles = spark.createDataFrame(rows, "law_id string, article_id string, number string, parent_number string, text string")
    renumbering = spark.createDataFrame([("aj", "9.1", "8.1")], "law_id string, old_number string, new_number string")
    found = sorted((r.from_article_id, r.to_law_id, r.to_number, r.to_article_id, r.target_missing, r.current_number) for r in extract.extract_references(articles, REGISTRY, renumbering).collect())
    assert found == [
        ("a:1", "a", "2", "a:2", False, None), ("a:1", "aj", "5", "aj:5", False, None), ("a:1", "aj", "9.1", None, True, "8.1"),
        ("a:2", "a", "1.1", None, True, None), ("a:2", L, "3.3", None, False, None),
    ]


@pytest.mark.parametrize("text,expected", [
    ('Ажлын тухай хуулийн 5.1 дэх хэсгийн "хуучин" гэснийг "шинэ" гэж өөрчилсүгэй.', [("replace", "5.1", "хуучин", "шинэ")]),
    ('Ажлын тухай хуулийн 5 дугаар зүйлийн "а" гэсний дараа "б" гэж нэмсүгэй.', [("insert", "5", "а", "б")]),
    ('Ажлын тухай хуулийн 5.2-ын "а" гэснийг хассугай.', [("delete", "5.2", "а", None)]),
    ("Ажлын тухай хуулийн 6, 7 дугаар зүйлийг хүчингүй болсонд тооцсугай.", [("repeal", "6", None, None), ("repeal", "7", None, None)]),
    ('Ажлын тухай хуулийн нэрийг "Шинэ хууль" гэж өөрчилсүгэй.', [("rename", None, None, "Шинэ хууль")]),
    ("Энэ хуулийг дагаж мөрдсүгэй.", []),
])
def test_amendment_wording(text, expected):
    assert [(op, number, old, new) for op, _, number, old, new, _, _ in extract.amendment_operations(text, REGISTRY)] == expected


def test_plain_law_text(spark):
    text = "НЭГДҮГЭЭР БҮЛЭГ\nөмнөх мөр\n12 дугаар зүйл. Гарчиг\nорох  хэсэг\n12.1.Нэг\nүргэлжлэл\n13.1.өөр зүйлийнх\n12.3.1.Гурав\n13 дугаар зүйл."
    rows = extract.parse_law_texts(spark.createDataFrame([("l", text)], "law_id string, text string")).orderBy("block").collect()
    assert [(r.number, r.parent_number, r.title, r.text) for r in rows] == [("12", None, "Гарчиг", "орох хэсэг"), ("12.1", "12", None, "Нэг үргэлжлэл 13.1.өөр зүйлийнх"), ("12.3.1", "12.3", None, "Гурав"), ("13", None, None, "")]


DOCUMENT = """МОНГОЛ УЛСЫН ХУУЛЬ
ТУРШИЛТЫН ТУХАЙ
2021 оны 7 дугаар сарын 2-ны өдөр
НЭГДҮГЭЭР БҮЛЭГ
НИЙТЛЭГ ҮНДЭСЛЭЛ
1 дүгээр зүйл.Зорилт
1.1.Энэ хуулийн 2.1-д заасан
үргэлжлэл.
1.1.а.нэмэлт
12/48
2 дугаар зүйл.Хүрээ
2.1.Хуучин бичвэр.
/Энэ хэсгийг 2022 оны 1 дүгээр сарын 5-ны өдрийн хуулиар хүчингүй болсонд тооцсон./
2.1.1.доторх
2.2.Үлдсэн
МОНГОЛ УЛСЫН ИХ ХУРЛЫН ДАРГА Г.ДАРГА
хавсралт 9.9.Үл хамаарах"""


def test_document_structure(spark):
    parsed = structure.parse_structure(spark.createDataFrame([("l", DOCUMENT)], "law_id string, text string"))
    row = parsed.first()
    assert (row.law.title, row.law.adopted, row.law.signed_by) == ("Туршилтын тухай хууль", "2021-07-02", "Г.ДАРГА")
    assert [(c.number, c.title) for c in row.chapters] == [(1, "Нийтлэг үндэслэл")]
    assert [(a.id, a.title, a.chapter) for a in row.articles] == [("art1", "Зорилт", "ch1"), ("art2", "Хүрээ", "ch1")]
    assert [(p.id, p.parent, p.status) for p in row.provisions] == [("1.1", "art1", "хүчинтэй"), ("2.1", "art2", "хүчингүй"), ("2.1.1", "2.1", "хүчинтэй"), ("2.2", "art2", "хүчинтэй")]
    assert row.provisions[0].text == "Энэ хуулийн 2.1-д заасан үргэлжлэл. а.нэмэлт"
    assert [(a.target, a.date, a.type) for a in row.amendments] == [("2.1", "2022-01-05", "хүчингүй")]
    assert sorted(r.article_id for r in structure.to_articles(parsed).collect()) == ["l:1", "l:1.1", "l:2", "l:2.2"]
    links = structure.extract_links(structure.current_provisions(parsed), parsed.select("law_id", F.inline("articles"))).collect()
    assert [(r.from_id, r.kind, r.target) for r in links] == [("1.1", "ref", "2.1")]


def parsed(spark, text, web=False):
    return structure.parse_structure(spark.createDataFrame([("l", text)], "law_id string, text string"), web).first()


def test_local_numbers_and_raised_articles(spark):
    r = parsed(spark, "Арван ес1 дүгээр зүйл.Нэр\n1.Нэгдүгээр хэсэг\n2.Хоёрдугаар\n2.1.доторх\n300.Он")
    assert [a.number for a in r.articles] == ["19¹"] and [p.id for p in r.provisions] == ["19¹.1", "19¹.2", "19¹.2.1"]
    assert r.provisions[2].text == "доторх 300.Он" and r.provisions[2].parent == "19¹.2"


def test_articles_in_words_chapters_sections_and_divisions(spark):
    text = "I ХЭСЭГ\nЕРӨНХИЙ АНГИЙН НЭР\nАРВАН НЭГДҮГЭЭР БҮЛЭГ\nнэр нь\nДООД МӨР\nНэгдүгээр дэд бүлэг\nДэд нэр\nХорин хоёрдугаар зүйл.Гарчиг\nүргэлжлэл\n1.Эхний\nХОЁРДУГААР БҮЛЭГ\nХоёр дахь\nХорин гуравдугаар зүйл.Дараагийн"
    r = parsed(spark, text)
    assert [(c.id, c.number, c.title) for c in r.chapters] == [("ch11", 11, "Нэр нь доод мөр"), ("ch2", 2, "Хоёр дахь")]
    assert [(s.id, s.title, s.chapter) for s in r.sections] == [("ch11.sec1", "Дэд нэр", "ch11")]
    assert [(a.number, a.title, a.chapter) for a in r.articles][:1] == [("22", "Гарчиг үргэлжлэл", "ch11")] and [p.id for p in r.provisions] == ["22.1"]


def test_dotted_articles_and_inserted_ones(spark):
    note = "/Энэ зүйлийг 2020 оны 3 дугаар сарын 4-ний өдрийн хуулиар нэмсэн./"
    r = parsed(spark, f"7.1 дүгээр зүйл.Нэг\n1.хэсэг\n7.2.Хоёр\n{note}\n1.хэсэг")
    assert [a.number for a in r.articles] == ["7.1", "7.2"] and [p.id for p in r.provisions] == ["7.1.1", "7.2.1"]
    assert [(a.target, a.date, a.type) for a in r.amendments] == [("art7.2", "2020-03-04", "нэмсэн")]


def test_missing_headings_slips_letters_and_notes(spark):
    text = "1 дүгээр зүйл.А\n1.1.нэг\n1.1.а.эхний\n1.1.б.хоёр\n2.1.хоёрдугаар зүйлийнх\n3.1.гурав\n3.2 .дөрөв\n9.1.хэн ч биш\n3.3./Энэ хэсгийг 2021 оны 2 дугаар сарын 3-ны өдрийн хуулиар хүчингүй болсонд тооцсон./\n3.4.тав\n/Энэ хэсэгт 2021 оны 2 дугаар сарын 3-ны өдрийн хуулиар өөрчлөлт оруулсан./\nүргэлжлэл"
    r = parsed(spark, text)
    assert [(a.number, a.title) for a in r.articles] == [("1", "А"), ("2", ""), ("3", "")]
    assert [(p.id, p.text, p.status) for p in r.provisions][:4] == [("1.1", "нэг а.эхний б.хоёр", "хүчинтэй"), ("2.1", "хоёрдугаар зүйлийнх", "хүчинтэй"), ("3.1", "гурав", "хүчинтэй"), ("3.2", "дөрөв 9.1.хэн ч биш", "хүчинтэй")]
    assert (r.provisions[4].id, r.provisions[4].status) == ("3.3", "хүчингүй") and r.provisions[5].text == "тав үргэлжлэл"
    assert [(a.target, a.type) for a in r.amendments] == [("3.4", "өөрчлөлт")]


def test_web_pages_lack_dots_and_hold_running_heads(spark):
    text = "1 дүгээр зүйл.А\nорох үг\n1.1.нэг\n1.1.1 доторх\nХУУДСЫН ТОЛГОЙ\n1.2 дэх хэсэг\n5.5.1 гадна"
    r = parsed(spark, text, web=True)
    assert [(p.id, p.text) for p in r.provisions] == [("1.1", "нэг"), ("1.1.1", "доторх 1.2 дэх хэсэг 5.5.1 гадна")]
    assert (r.articles[0].title, r.articles[0].text) == ("А", "орох үг")


def test_later_wording_wins_unless_repealed_and_empty_documents_stay(spark):
    note = "/Энэ хэсгийг 2021 оны 2 дугаар сарын 3-ны өдрийн хуулиар хүчингүй болсонд тооцсон./"
    rows = [("l", f"1 дүгээр зүйл.А\n1.1.анх\n1.1.дараа\n1.2.үлдэх\n1.2.хуучин\n{note}"), ("none", None), ("blank", " \n")]
    got = structure.parse_structure(spark.createDataFrame(rows, "law_id string, text string"))
    assert {r.law_id: len(r.provisions) for r in got.collect()} == {"l": 4, "none": 0, "blank": 0}
    assert sorted((r.id, r.text) for r in structure.current_provisions(got).collect()) == [("1.1", "дараа"), ("1.2", "үлдэх")]


@pytest.mark.parametrize("text,targets", [
    ("энэ хуулийн 5, 6 дугаар зүйлд", ["art5", "art6"]), ("энэ хуулийн 3.1-3.3-т", ["3.1", "3.3", "3:1:3"]), ("энэ зүйлийн 2, 1.4-д", ["1.2", "1.4"]),
    ("энэ хуулийн Арван нэгдүгээр бүлэг", ["Арван нэгдүгээр"]), ("Ойн тухай хуулиар, Иргэний хуульд", ["Ойн тухай хууль", "Иргэний хууль"]), ("энэ хуулиар", []),
])
def test_links(text, targets):
    assert [t for _, t, _ in structure.links_of(text, "art1")] == targets


def test_mentions_take_the_longest_first():
    import re

    patterns = [("long", re.compile("ажил олгогчийн төлөөлөгч")), ("short", re.compile(extract.stem_pattern("ажил олгогч")))]
    assert extract.mentions_of("Ажил олгогчийн төлөөлөгч", patterns) == ["long"]
    assert re.search(extract.stem_pattern("ажилтан"), "ажилтны эрх")


def test_dictionary_match(spark):
    rows = extract.dictionary_match(spark.createDataFrame([("1", "abcabc ab"), ("2", None)], "id string, text string"), ["ab", "abc", ""]).collect()
    assert [(r.id, r.phrase, r.start) for r in rows] == [("1", "abc", 0), ("1", "abc", 3), ("1", "ab", 7)]


def test_web_page_lines(spark):
    page = '<script>x</script><div>Нэг &amp; хоёр<sup>1</sup></div><p style="display:none">нуусан</p><p>5<span>1</span></p>'
    rows = files.html_lines(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html").orderBy("pos").collect()
    assert [r.line for r in rows] == ["Нэг & хоёр¹", "51"]


def test_superscripts_of_several_digits(spark):
    pages = spark.createDataFrame([(1, "<p>9<sup>12</sup>7, 3<sup> 421&nbsp;</sup>, x<sup>a1</sup></p>")], "id long, html string")
    assert [r.line for r in files.html_lines(pages, "id", "html").collect()] == ["9¹²7, 3⁴²¹, xa1"]


def test_a_dataset_survives_save_and_load(spark, tmp_path):
    """Drafts, sources and links come back, and a table that is not there comes back empty."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "laws.jsonl").write_text('{"law_id":"a","name":"А","former_names":[],"short_names":[],"source_url":"https://a","articles":[{"article_id":"a:1","number":"1","text":"t"}]}\n')
    (folder / "drafts.json").write_text('[{"draft_id":"d1","title":"x","target_law_id":"a","amended_article_ids":["a:1"],"cosubmitted_law_ids":[],"operations":[{"op":"repeal","law_id":"a","number":"1"}]},{"draft_id":"d2"}]')
    (folder / "international.json").write_text('{"sources":[{"source_id":"s","title":"S"}],"links":[{"article_id":"a:1","source_id":"s","relevance":0.5}]}')
    first = files.load_processed(spark, str(folder))
    files.write_processed(first, str(tmp_path / "out"))
    again = files.load_processed(spark, str(tmp_path / "out"))
    for name in ("drafts", "intl_sources", "intl_links", "refs", "laws"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(first, name).collect())), name
    assert (again.drafts.count(), again.intl_sources.count(), again.intl_links.count()) == (2, 1, 1)
    files.write_processed(GraphStore(first.laws, first.articles, first.refs), str(tmp_path / "bare"))
    assert files.load_processed(spark, str(tmp_path / "bare")).drafts.count() == 0


def test_bills_are_split(spark):
    text = "Төсөл\nМОНГОЛ УЛСЫН ХУУЛЬ\nАЖЛЫН ТУХАЙ\nХУУЛЬД\n1 дүгээр зүйл.Нэг\nхоёр\nГАРЫН үсэг\nМОНГОЛ УЛСЫН ХУУЛЬ\nӨӨР ХУУЛЬ\n1 дүгээр зүйл.Гурав"
    rows = files.split_bills(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("bill").collect()
    assert [(r.title, r.text) for r in rows] == [("Ажлын тухай хуульд", "1 дүгээр зүйл.Нэг\nхоёр"), ("Өөр хууль", "1 дүгээр зүйл.Гурав")]


def test_registry_files_and_law_files(spark, tmp_path):
    (tmp_path / "names.json").write_text('{"laws": [{"current_name": "Ойн тухай хууль", "former_names": ["Мод"], "aliases": ["Ой"]}]}')
    (tmp_path / "legacy.json").write_text('{"Усны тухай хууль": ["Ус"], "_note": ["x"]}')
    assert [(r.law_id, r.former_names, r.aliases) for r in files.read_registry(spark, str(tmp_path / "names.json")).collect()] == [("oin-tukhai-khuuli", ["Мод"], ["Ой"])]
    assert [(r.law_id, r.former_names) for r in files.read_registry(spark, str(tmp_path / "legacy.json")).collect()] == [("usny-tukhai-khuuli", ["Ус"])]
    (tmp_path / "law.txt").write_text("law_id: x\n# c: d\nname: Нэр: хоёр\n---\n1 дүгээр зүйл. А")
    row = files.read_law_texts(spark, str(tmp_path / "law.txt")).first()
    assert row.meta == {"law_id": "x", "name": "Нэр: хоёр"} and row.body == "1 дүгээр зүйл. А"


def test_lexical_similarity_and_judgement(spark):
    texts = {"a:1": "ажилтан долоо хоногт 40 цаг ажиллана", "b:1": "ажилтан долоо хоногт 48 цаг ажиллана", "b:2": "огт өөр сэдэв", "a:2": "ажилтан долоо хоногт 40 цаг ажиллана", "c:1": ""}
    laws = spark.createDataFrame([(x, x.upper(), [], [], None, "https://x", True) for x in "abc"], "law_id string, name string, former_names array<string>, short_names array<string>, adopted_date string, source_url string, text_available boolean")
    articles = with_keys(spark.createDataFrame([(k[0], k, k[2:], None, None, t) for k, t in texts.items()], "law_id string, article_id string, number string, parent_number string, title string, text string"))
    linked = [{"from_article_id": "a:2", "to_law_id": "b", "to_number": "1", "to_article_id": "b:1", "raw_text": "", "matched_name": "", "uses_old_name": False, "target_missing": False, "method": "regex", "confidence": 1.0, "current_number": None}]
    store = GraphStore(laws, articles, spark.createDataFrame(linked, schema("refs")))
    pairs = similarity.similar_provisions(store)
    assert [(r.a_article_id, r.b_article_id, r.score) for r in pairs.collect()] == [("a:1", "b:1", 1.0)]
    judged = similarity.judge(store, pairs).first()
    assert (judged.kind, judged.confidence, judged.model) == ("conflict", 0.55, "demo-heuristic")
    assert [r.id for r in similarity.text_query(articles.select(F.col("article_id").alias("id"), "text"), "ажилтан долоо хоногт ажиллана").collect()][:2] == ["a:1", "a:2"]


def test_processed_files_round_trip(spark, tmp_path):
    folder = str(tmp_path / "p")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "laws.jsonl").write_text('{"law_id":"a","name":"А","former_names":[],"short_names":[],"source_url":"https://a","articles":[{"article_id":"a:1","number":"1","text":"t"}]}\n\n')
    store = files.load_processed(spark, folder)
    assert store.refs.count() == 0 and store.drafts.count() == 0
    row = store.laws_with_counts().first()
    assert (row.article_count, row.text_available) == (1, True)
    files.write_processed(store, str(tmp_path / "q"))
    assert files.load_processed(spark, str(tmp_path / "q")).articles.select("article_id", "text").collect() == [("a:1", "t")]


def test_lines_are_dealt_to_tasks_by_the_length_of_texts(spark, monkeypatch):
    rows = [(f"l{i}", f"НЭГДҮГЭЭР БҮЛЭГ\nНийтлэг\n{i + 1} дугаар зүйл. Гарчиг\n{i + 1}.1.Заалт\nүргэлжлэл") for i in range(12)]
    documents = spark.createDataFrame(rows, "law_id string, text string")
    found = lambda: structure.current_provisions(structure.parse_structure(documents)).select("law_id", "id", "parent", "text", "status")
    whole = found()
    monkeypatch.setattr(structure, "TASK_LETTERS", 50)
    tasks = -(-sum(len(t) for _, t in rows) // 50)
    dealt = found()
    assert tasks > 4 and f", {tasks})" in dealt._jdf.queryExecution().executedPlan().toString()  # before: the session's partitions, however long the texts
    assert sorted(dealt.collect()) == sorted(whole.collect()) and whole.count() == 12
