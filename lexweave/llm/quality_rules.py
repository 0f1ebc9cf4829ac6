"""Quality rules: repetition and size limits, and the divergence of a text's histograms from its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.chat import let
from lexweave.llm.common import WORD, materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Common words of each language that has a reference of its own; fixed values.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
}
OTHER_LANGUAGE = "*"
#: Verdict: distances beyond these fail, but only for texts of at least so many characters or words.
MAX_CLASS_DISTANCE, MIN_CLASS_CHARS = 0.25, 200
MAX_WORD_DISTANCE, MIN_WORD_WORDS = 0.26, 100
CLASSES = ("upper", "digit", "blank", "point", "symbol", "rest")
BINS = tuple(f"word{i}" for i in range(1, 13)) + ("word0",)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of five that stand twice or more in the text, the first ones included.

    Equal windows have equal hashes, so a text whose window hashes are all different repeats none. In any other the
    windows whose hash stands twice are found by a sort of the hashes; these alone are sorted by hash and words, and
    those whose words equal a neighbour's are repeated. What they cover is summed over the gaps of their places, so
    time is n log n whatever the text repeats.
    """

    def windows(h: Column) -> Column:
        return F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def like_a_neighbour(s: Column, *fields: str) -> Column:
        def equal(i: Column, j: Column) -> Column:
            found = F.lit(True)
            for name in fields:
                found = found & (F.get(s, j)[name] == F.get(s, i)[name])
            return found

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: equal(i, i - 1) | equal(i, i + 1)), lambda i: F.get(s, i)["i"])

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        by_hash = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        suspects = let(by_hash, lambda s: like_a_neighbour(s, "x"))
        by_words = F.array_sort(F.transform(suspects, lambda i: F.struct(F.get(w, i).alias("x"), F.slice(words, i + 1, WINDOW).alias("w"), i.alias("i"))))
        places = let(by_words, lambda s: F.sort_array(like_a_neighbour(s, "x", "w")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(places, covered))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def repeated_lines(text: Column) -> Column:
    """Number of lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts per row, without the text: base counts, character classes, common words of the row's language."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"))
    known = F.col("lang").isin(*COMMON_WORDS)
    rows = rows.withColumn("lang", F.when(known, F.col("lang")).otherwise(F.lit(OTHER_LANGUAGE))).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    common = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        common = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in words])).otherwise(common)
    hits = let(common, lambda c: F.filter(F.transform("words", lambda w: F.array_position(c, F.lower(F.rtrim(w, F.lit(".,"))))), lambda p: p > 0))
    bins = let(hits, lambda h: F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.size(F.filter(h, lambda p: p == k)).cast("long")))
    length = F.length("text").cast("long")
    gone = lambda characters: length - F.length(_without(F.col("text"), characters))
    upper = length - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))
    return rows.select(
        "id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        length.alias("n_chars"),
        upper.alias("upper"), gone("0123456789").alias("digit"), gone(".,;:!?'\"()-").alias("point"),
        bins.alias("bins"),
    )


def _shares(rows: DataFrame, prefix: str) -> DataFrame:
    """Histograms as shares: character classes over characters, common words over words (``word0`` is the others)."""
    chars, words = F.greatest(F.col("n_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    blank = F.col("n_chars") - F.col("word_chars")
    counts = {"upper": F.col("upper"), "digit": F.col("digit"), "blank": blank, "point": F.col("point"), "symbol": F.col("n_symbols")}
    counts["rest"] = F.col("n_chars") - sum(counts.values(), F.lit(0))
    found = {c: counts[c] / chars for c in CLASSES} | {f"word{i}": F.coalesce(F.get("bins", F.lit(i - 1)), F.lit(0)) / words for i in range(1, 13)}
    others = F.col("n_words") - F.aggregate(F.coalesce("bins", F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    found["word0"] = others / words
    return rows.select("*", *[v.alias(prefix + k) for k, v in found.items()])


def jensen_shannon(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance to base 2: the square root of the divergence, from 0 to 1."""

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    total = F.lit(0.0)
    for x, y in zip(p, q):
        total = total + term(x, y) + term(y, x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, base counts, base_failed, class_distance, word_distance, kept)`` per row.

    A text fails the base rules with under ten words, or if over 20% of its words stand in repeated windows. The
    others are held against the reference of their language: the pooled histograms of all its rows that pass the
    base rules, in this very corpus (at most five rows, broadcast). Languages without a word list, and null, share
    one reference and skip the word test. Short texts skip a test by its minimum length.

    Null and empty texts have no words and fail; repeated rows and null ids give a row each; an empty table gives an
    empty result; other columns are not read.
    """
    rows = materialize(features(docs, id_col, text_col, lang_col), "features")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    summed = ("n_words", "word_chars", "n_symbols", "n_chars", "upper", "digit", "point")
    pooled = rows.where("NOT base_failed").groupBy(F.col("lang").alias("r_lang")).agg(*[F.sum(c).alias(c) for c in summed], F.array(*[F.sum(F.coalesce(F.get("bins", F.lit(i)), F.lit(0))) for i in range(12)]).alias("bins"))
    reference = _shares(pooled, "r_").select("r_lang", *[f"r_{c}" for c in (*CLASSES, *BINS)])
    shares = _shares(rows, "d_").join(F.broadcast(reference), rows["lang"] == F.col("r_lang"), "left")
    distance = lambda names: jensen_shannon([F.col(f"d_{c}") for c in names], [F.col(f"r_{c}") for c in names])
    judged = shares.withColumn("class_distance", distance(CLASSES)).withColumn("word_distance", F.when(F.col("lang") != OTHER_LANGUAGE, distance(BINS)))
    odd_classes = (F.col("n_chars") >= MIN_CLASS_CHARS) & (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE)
    odd_words = (F.col("n_words") >= MIN_WORD_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return judged.select("id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~odd_classes & ~odd_words).alias("kept"))
