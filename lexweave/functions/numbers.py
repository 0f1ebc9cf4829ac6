"""Dotted hierarchical numbers and ids built from them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Superscript digits mark a provision that was inserted later: 9¹ stands between 9 and 10.
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
#: A missing number sorts behind every other.
LAST_KEY = 1_000_000_000
#: Latin spelling of the Cyrillic letters that need one; fixed values.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "ye", "ё": "yo", "ж": "j", "з": "z",
    "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "ө": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ү": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "sh", "ъ": "i", "ы": "y", "ь": "i", "э": "e", "ю": "yu", "я": "ya",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_key(number: Column | str) -> Column:
    """Sort key ``array<bigint>``: each part counts a hundred per unit of the digits it opens with plus its superscript;
    parts that open with no digit count zero, and a number that is null or empty sorts last."""

    def part(p: Column) -> Column:
        opening = rf"^([0-9]+)([{SUPERSCRIPTS}]*)"
        raised = F.translate(F.regexp_extract(p, opening, 2), SUPERSCRIPTS, DIGITS)
        return F.coalesce(F.regexp_extract(p, opening, 1).try_cast("bigint") * 100 + F.coalesce(raised.try_cast("bigint"), F.lit(0)), F.lit(0).cast("bigint"))

    number = F.nullif(_col(number), F.lit(""))
    return F.when(number.isNull(), F.array(F.lit(LAST_KEY).cast("bigint"))).otherwise(F.transform(F.split(number, r"\."), part))


def ancestors_and_self(number: Column | str) -> Column:
    """``80.1.2`` -> [``80.1.2``, ``80.1``, ``80``], from the text alone."""
    parts = F.split(_col(number), r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def ancestors(number: Column | str) -> Column:
    every = ancestors_and_self(number)
    return F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0)))


def parent_number(number: Column | str) -> Column:
    number = _col(number)
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.[^.]*$", ""))


def under(number: Column | str, prefix: Column | str) -> Column:
    """Equal to ``prefix`` or below it: ``80`` covers ``80.1`` but not ``801``."""
    number, prefix = _col(number), _col(prefix)
    return (number == prefix) | F.startswith(number, F.concat(prefix, F.lit(".")))


def article_id(law_id: Column | str, number: Column | str) -> Column:
    return F.concat(_col(law_id), F.lit(":"), _col(number))


def law_of(article: Column | str) -> Column:
    return F.substring_index(_col(article), ":", 1)


def number_of(article: Column | str) -> Column:
    article = _col(article)
    return F.when(F.contains(article, F.lit(":")), F.regexp_replace(article, "^[^:]*:", "")).otherwise(F.lit(""))


def slug(name: Column | str) -> Column:
    """ASCII id of a name: Latin letters, everything else one hyphen."""
    text = F.lower(F.trim(_col(name)))
    long = {k: v for k, v in LATIN.items() if len(v) > 1}
    short = {k: v for k, v in LATIN.items() if len(v) == 1}
    for letter, spelled in long.items():
        text = F.replace(text, F.lit(letter), F.lit(spelled))
    text = F.translate(text, "".join(short), "".join(short.values()))
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
