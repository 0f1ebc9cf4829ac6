"""Dictionaries in texts as joins: tokens meet phrases by their first words, the longest matches stay.

Texts and phrases are cut into word and punctuation tokens. A phrase is filed under its first tokens; a text asks at each
place with the tokens that stand there. What meets is held against the whole phrase, and of overlapping matches the longest
stays. Dictionary and texts are tables of any size; a text's own matches are the only thing that meets in one place.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, and any other character that is no blank as a token of its own: so the words of a match have blanks between them only.
WORD_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: Tokens that a phrase is filed under, at most. Letters of the shortest beginning that an inflected single word is found by.
KEY_TOKENS, LEAST_LETTERS = 3, 2
#: Vowels that are unstable before a final н in longer words, and all vowels; fixed values.
UNSTABLE, VOWELS = "аэо", "аэоөуүи"


def word_tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_TOKEN), F.lit(0))


def last_forms(word: Column) -> Column:
    """Beginnings that a phrase's last word may have in any case: itself, and without or with another unstable vowel."""
    stem = F.substring(word, F.lit(1), F.length(word) - 2)
    unstable = (F.length(word) > 5) & word.rlike(f"[^{VOWELS}][{UNSTABLE}]н$")
    return F.when(unstable, F.array(*[F.concat(stem, F.lit(v + "н")) for v in ("", *UNSTABLE)])).otherwise(F.array(word))


def filed(phrases: DataFrame, inflected: bool, *by: str) -> DataFrame:
    """``(by, name, words, last, n, k, key)`` of ``phrases(by, name, phrase)``: ``k`` first tokens are the key.

    ``inflected``: the last word may go on with other letters, so it is no part of the key; a phrase of one word is filed
    under its forms themselves with ``k`` 0. Phrases without a token are left out, repeated ones count once.
    """
    rows = phrases.select(*by, "name", word_tokens("phrase").alias("words")).where(F.size("words") > 0).distinct()
    rows = rows.withColumn("n", F.size("words")).withColumn("last", F.element_at("words", -1))
    if not inflected:
        rows = rows.withColumn("k", F.least("n", F.lit(KEY_TOKENS)))
        return rows.withColumn("key", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    rows = rows.withColumn("last", F.explode(last_forms(F.col("last")))).withColumn("k", F.least(F.col("n") - 1, F.lit(KEY_TOKENS)))
    return rows.withColumn("key", F.when(F.col("k") == 0, F.col("last")).otherwise(F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")))


def _asked(texts: DataFrame, inflected: bool, *by: str) -> DataFrame:
    """``(by, id, pos, k, key)``: the keys that each place of ``texts(by, id, words)`` asks for."""
    places = texts.where(F.size("words") > 0).select(*by, "id", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("pos"))
    keys = [F.struct(F.lit(k).alias("k"), F.when(F.col("pos") + k - 1 <= F.size("words"), F.array_join(F.slice("words", F.col("pos"), F.lit(k)), " ")).alias("key")) for k in range(1, KEY_TOKENS + 1)]
    keys = F.array(*keys)
    if inflected:
        word = F.element_at("words", F.col("pos"))
        begin = F.transform(F.sequence(F.least(F.lit(LEAST_LETTERS), F.length(word)), F.length(word)), lambda n: F.struct(F.lit(0).alias("k"), F.substring(word, F.lit(1), n).alias("key")))
        keys = F.concat(keys, begin)
    return places.select(*by, "id", "pos", F.inline(keys)).where("key IS NOT NULL")


def longest_first(spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Of ``(size, start, end, name)`` those that stay when the largest is taken first and nothing over what is taken; ties
    by place, then name. Names of one size at one place all stay."""
    starts: list[int] = []
    ends: list[int] = []
    names: dict[tuple[int, int, int], list[str]] = {}
    for size, start, end, name in sorted(set(spans), key=lambda s: (-s[0], s[1], s[2], s[3])):
        if (size, start, end) in names:
            names[size, start, end].append(name)
            continue
        at = bisect_right(starts, start)
        if (at and ends[at - 1] > start) or (at < len(starts) and starts[at] < end):
            continue
        starts.insert(at, start)
        ends.insert(at, end)
        names[size, start, end] = [name]
    return sorted((s, e, n) for (_, s, e), own in names.items() for n in own)


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for id_, hits in zip(batch.column("id").to_pylist(), batch.column("hits").to_pylist()):
            out += [(id_, start, end, name) for start, end, name in longest_first([(h["size"], h["start"], h["end"], h["name"]) for h in hits])]
        columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "end", "name"])


def phrase_matches(texts: DataFrame, phrases: DataFrame, inflected: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, id, start, end, name)``: which phrases stand in which texts, by token places from 1, the end not included.

    ``texts`` is ``(by, id, text)`` with ids that are unique within ``by``, ``phrases`` is ``(by, name, phrase)``; both meet
    within equal ``by``. Upper and lower case are one. The phrase of most tokens goes first, of inflected ones that of most
    letters. Null and empty texts and phrases match nothing.
    """
    words = texts.select(*by, F.col("id").cast("string").alias("id"), word_tokens("text").alias("words"))
    found = _asked(words, inflected, *by).join(filed(phrases, inflected, *by), [*by, "k", "key"])
    found = found.select(*by, "id", "pos", "n", "words", "last", "name").withColumnRenamed("words", "wanted")
    met = found.join(words, [*by, "id"])  # a candidate meets its text once more
    whole = F.slice("words", F.col("pos"), F.col("n"))
    fits = (F.slice(whole, F.lit(1), F.col("n") - 1) == F.slice("wanted", F.lit(1), F.col("n") - 1)) & F.startswith(F.element_at(whole, -1), F.col("last")) if inflected else whole == F.col("wanted")
    met = met.where((F.col("pos") + F.col("n") - 1 <= F.size("words"))).where(fits)
    size = F.length(F.array_join("wanted", " ")) if inflected else F.col("n")
    hit = F.struct(size.alias("size"), F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end"), "name")
    place = F.to_json(F.struct(*by, "id")) if by else F.col("id")
    grouped = met.groupBy(place.alias("id")).agg(F.collect_set(hit).alias("hits"))
    chosen = grouped.mapInArrow(_selected, "id string, start int, end int, name string")
    if not by:
        return chosen
    own = F.from_json("id", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.select(*by, "id").schema))
    return chosen.withColumn("own", own).select(*[F.col(f"own.{c}").alias(c) for c in by], F.col("own.id").alias("id"), "start", "end", "name")
