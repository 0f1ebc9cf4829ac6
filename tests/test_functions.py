"""Numbers, ids and text functions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import numbers as N
from lexweave.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers_sort_by_part_and_superscript(spark):
    rows = spark.createDataFrame([(n,) for n in ("801", "80.10", "10", "80", "9¹", "80.2", "9", "80.1", None)], "n string")
    assert [r.n for r in rows.orderBy(N.number_key("n"), "n").collect()] == ["9", "9¹", "10", "80", "80.1", "80.2", "80.10", "801", None]


def test_a_part_that_is_no_number_counts_zero(spark):
    assert one(spark, N.number_key(F.lit("8.x.3"))) == [800, 0, 300]


@pytest.mark.parametrize("number,prefix,result", [("80", "80", True), ("80.1", "80", True), ("801", "80", False), ("8", "80", False)])
def test_under(spark, number, prefix, result):
    assert one(spark, N.under(F.lit(number), F.lit(prefix))) is result


def test_id_algebra(spark):
    assert one(spark, N.ancestors(F.lit("12.3.1"))) == ["12.3", "12"]
    assert one(spark, N.ancestors(F.lit("12"))) == []
    assert one(spark, N.parent_number(F.lit("12.3"))) == "12" and one(spark, N.parent_number(F.lit("12"))) is None
    assert one(spark, N.law_of(F.lit("law-a:1.2"))) == "law-a" and one(spark, N.number_of(F.lit("law-a:1.2"))) == "1.2"


@pytest.mark.parametrize("name,slug", [("Зөвшөөрлийн тухай хууль", "zovshoorliin-tukhai-khuuli"), ("  Ajil, 2!", "ajil-2"), ("Ясны", "yasny")])
def test_slug(spark, name, slug):
    assert one(spark, N.slug(F.lit(name))) == slug


def test_normal_form_joins_blanks_and_quotes(spark):
    assert one(spark, T.normal_form(F.lit("  «А» Б\n\tв "))) == '"а" б в'


@pytest.mark.parametrize("word,stem", [("хөдөлмөрийн", "хөдөлмөр"), ("хуулийн", "хуул"), ("она", "она"), ("12.3", "12.3"), ("тай", "тай")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.lit(word))) == stem


def test_excerpt(spark):
    assert one(spark, T.excerpt(F.lit("  ab cd  "), 5)) == "ab cd"
    assert one(spark, T.excerpt(F.lit("abc def"), 5)) == "abc…"
    assert one(spark, T.excerpt(F.lit(None).cast("string"), 5)) == ""


@pytest.mark.parametrize("text,numbers", [("18, 19-21 болон 24", ["18", "19", "20", "21", "24"]), ("1-99", ["1", "99"]), ("5-3", ["5", "3"]), ("", [])])
def test_expand_numbers(spark, text, numbers):
    assert one(spark, T.expand_numbers(F.lit(text))) == numbers


def test_quantities_clash_only_within_a_unit(spark):
    q = lambda s: T.quantities(F.lit(s))
    assert one(spark, T.quantities_clash(q("8 цаг"), q("9 цаг"))) is True
    assert one(spark, T.quantities_clash(q("8 цаг"), q("9 хоног"))) is False
    assert one(spark, q("хоёр жил, 30 хоног")) == ["жил:2", "хоног:30"]


def test_ordinals(spark):
    assert [one(spark, T.ordinal_number(F.lit(w))) for w in ("Хорин нэгдүгээр", "Далдугаар", "юу ч")] == [21, 70, 0]


def test_label_rounds_half_to_even(spark):
    assert one(spark, T.label(F.lit("suggestion"), F.lit(0.725))) == "Санал, 72%"
    assert one(spark, T.label(F.lit("fact"), F.lit(1.0))) == "Баримт"


def test_dates_in_words(spark):
    assert one(spark, T.adopted_date(F.lit("2021 оны 7 дугаар сарын 2-ны өдөр"))) == "2021-07-02"


def test_canonical_form(spark):
    said = {"Хөдөлмөрийн  тухай хуулийн": "Хөдөлмөрийн тухай хууль", "Ойн тухай хуулиудын": "Ойн тухай хууль", "Иргэний хуульд": "Иргэний хууль", "Усны тухай хууль": "Усны тухай хууль", "хуулийн тухай журам": "хуулийн тухай журам"}
    for text, form in said.items():
        assert one(spark, T.canonical_form(F.lit(text))) == form


@pytest.mark.parametrize("line, wanted", [
    ("174.3 ./Энэ хэсгийг", "174.3./Энэ хэсгийг"), ("13¹. 2. Монгол", "13¹.2. Монгол"), ("1.1. 2. Хоёр", "1.1.2. Хоёр"), ("1. 2. жагсаалт", "1. 2. жагсаалт"), ("1.1. 25 хоног", "1.1. 25 хоног"),
    ("7.З. бичвэр", "7.3. бичвэр"), ("1.3өвшөөрөлгүй", "1.Зөвшөөрөлгүй"), ("1.3.өв", "1.3.өв"), ("1.3Өв", "1.3Өв"), ("3өв", "3өв"), ("бичвэр 7.З.", "бичвэр 7.З."), ("12 . текст", "12 . текст"), ("12 .текст", "12.текст"), ("", ""),
])
def test_slips_of_numbers(spark, line, wanted):
    assert one(spark, T.normalize_number(F.lit(line))) == wanted


def test_normalize_number(spark):
    assert one(spark, T.normalize_number(F.lit("7.З. бичвэр"))) == "7.3. бичвэр"
    assert one(spark, T.normalize_number(F.lit("174.3 ./Энэ"))) == "174.3./Энэ"


def test_numbers_without_or_beside_digits(spark):
    from lexweave.functions import numbers

    values = ["9", "9¹", "10", "12а", "x.2", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "n string").select("n", numbers.number_key("n").alias("k")).collect()
    assert [list(r.k) for r in rows] == [[900], [901], [1000], [1200], [0, 200], [10**9], [10**9]]


def test_python_stems_equal_the_column(spark):
    from lexweave.functions import text as T

    words = ["хөдөлмөрийн", "хуулиар", "ажилтанд", "цагаас", "зүйлүүд", "ажлын", "она", "12.3", "нн", "дддддд", "abcт", "гаараар", "ынхынх", "a"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem("w").alias("s")).collect()
    assert {r.w: r.s for r in rows} == {w: T.stem_of(w) for w in words}


def test_lexical_vectors_by_hand(spark):
    import hashlib
    import math

    from lexweave.operators.similarity import lexical_vectors

    def bucket(f):
        d = hashlib.md5(f.encode()).digest()
        return (d[0] + 256 * d[1]) % 1024

    sums = {}
    for f, v in [("w:abcd", 2.0), ("c:#ab", 0.6), ("c:abc", 0.6), ("c:bcd", 0.6), ("c:cd#", 0.6), ("w:xyz", 1.0), ("c:#xy", 0.3), ("c:xyz", 0.3), ("c:yz#", 0.3)]:
        sums[bucket(f)] = sums.get(bucket(f), 0) + v
    rows = spark.createDataFrame([(1, "abcd xyz 12 ab ABCD"), (2, ""), (3, None), (4, "12 of")], "id long, text string")
    found = {(r.id, r.bucket): r.weight for r in lexical_vectors(rows, ()).collect()}
    assert found.keys() == {(1, b) for b in sums}
    assert all(math.isclose(found[1, b], math.sqrt(v / sum(sums.values()))) for b, v in sums.items())
