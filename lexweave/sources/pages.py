"""Web pages as rows of tags and texts: what is hidden, where the body is and which line a text is on follow from windows.

A page is cut into tokens, a row each. An element ends where its depth among elements of its name is left again, so nested
blocks are whole however often their name repeats inside; an end that is missing is the end of the page. Running counts of
starts and ends then say of each text whether anything hidden is open around it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.numbers import DIGITS, SUPERSCRIPTS
from lexweave.functions.text import clean

#: Elements of HTML that stand within a line; those that have no end; those whose end closes a line. From the HTML standard.
INLINE = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "o:p", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
CLOSES_LINE = ("p", "div", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "title")
#: Elements whose content is no text, and the attribute of an element that is not shown.
NO_TEXT, HIDDEN = ("script", "style"), r"(?i)\bstyle\s*=\s*[\"'][^\"']*display\s*:\s*none"
#: Attributes left over by a tag that ended early in a broken style.
BROKEN_STYLE = r"(?:[a-z-]+\s*:\s*[^;\"<>\n]*;?\s*)+\"\s*>"
#: Tasks that pages are dealt to, for each of a shuffle: tokens take many times the room of their page.
SPREAD = 4
#: One token: a whole script or style, a comment, a tag, or text up to the next of them.
TOKEN = r"(?is)<(?:script\b.*?</script\s*|style\b.*?</style\s*|!--.*?--|/?[a-z][^>]*|[!?][^>]*)>|<|[^<]+"


def page_tokens(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id, pos, token, name, opens, closes)``: a row per tag or text; a text has no name."""
    tasks = SPREAD * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("__html")).repartition(tasks, "id")  # pages cross as they are, not as tokens
    tokens = whole.select("id", F.posexplode(F.regexp_extract_all(F.coalesce("__html", F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    name = F.lower(F.nullif(F.regexp_extract("token", r"(?i)^</?([a-z][a-z0-9:]*)", 1), F.lit("")))
    rows = tokens.withColumn("name", F.when(F.startswith("token", F.lit("<!")) | F.startswith("token", F.lit("<?")), F.lit("!")).otherwise(name))
    paired = F.col("name").isNotNull() & ~F.col("name").isin(*VOID, *NO_TEXT, "!") & ~F.endswith("token", F.lit("/>"))
    closing = F.startswith("token", F.lit("</"))
    return rows.withColumn("opens", paired & ~closing).withColumn("closes", paired & closing)


def _covered(rows: DataFrame, start: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: whether an element for whose opening tag ``start`` holds is open at a row, its own tags included.

    All windows are within a page, so rows that are dealt by page stay where they are: an element covers what lies before the
    farthest end of those that have begun."""
    here = Window.partitionBy("id", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)).over(here)
    tags = rows.withColumn("__level", depth + F.when(F.col("closes"), 1).otherwise(0))  # of an opening and of its end alike
    after = Window.partitionBy("id", "name", "__level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.when(F.col("closes"), F.struct((-F.col("pos")).alias("n")))).over(after)["n"]  # of the ends behind a row the first
    tags = tags.withColumn("__end", F.when(F.col("opens") & start, F.coalesce(-ends, F.lit(2147483647))))
    page = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tags.withColumn(out, F.coalesce(F.max("__end").over(page) >= F.col("pos"), F.lit(False))).drop("__level", "__end")


#: A character reference that a semicolon ends.
CLOSED_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(text: str) -> str:
    """``text`` with the references decoded that a semicolon ends; one that is cut short stays as it is written."""
    return CLOSED_REFERENCE.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def _unescaped(closed_only: bool) -> Callable[..., Column]:
    """The function of a column that decodes references; rows stay with their page."""
    decoded = _closed if closed_only else html.unescape

    def run(said: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decoded(x) for x in said.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def page_lines(pages: DataFrame, id_col: str, html_col: str, body: str | None = None, dropped: str | None = None, closed_only: bool = False) -> DataFrame:
    """``(id, pos, line)``: the lines of each page that have something on them.

    Scripts, styles, comments and whatever is hidden are left out, nested blocks whole; inline tags join what they part,
    all others leave a blank or end the line; raised digits become superscripts. ``body`` is a pattern of the tags that a
    block of the body opens with: where a page has one, what stands before the first is dropped, and of each block what
    follows a script or style in it. ``dropped`` is a pattern of opening tags whose elements are left out too. What a tag
    that a broken style ended early leaves behind is taken out of its line. References such as ``&amp`` are decoded as
    browsers do, without their semicolon too; with ``closed_only`` those alone that have one. Null and empty pages have no lines.
    """
    rows = page_tokens(pages, id_col, html_col)
    hidden = F.col("token").rlike(HIDDEN)
    rows = _covered(rows, hidden | F.col("token").rlike(dropped) if dropped else hidden, "hidden")
    rows = _covered(rows, F.col("name") == "sup", "raised")
    page = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    if body is not None:
        opens = F.col("opens") & F.col("token").rlike(body)
        rows = rows.withColumn("block", F.count_if(opens).over(page)).withColumn("blocks", F.count_if(opens).over(Window.partitionBy("id")))
        in_block = Window.partitionBy("id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("cut", F.count_if(F.col("name").isin(*NO_TEXT)).over(in_block))
        rows = rows.where("blocks = 0 OR (block > 0 AND cut = 0)")
    name = F.col("name")
    digits = F.regexp_extract("token", r"^\s*([0-9]+)(?:\s|&nbsp;|\x{a0})*$", 1)
    text = F.when(F.col("raised") & (digits != ""), F.translate(digits, DIGITS, SUPERSCRIPTS)).otherwise(F.col("token"))
    ends = (F.col("closes") & name.isin(*CLOSES_LINE)) | (name == "br")
    if body is not None:
        ends = ends | (F.col("opens") & F.col("token").rlike(body))
    said = F.when(name.isNull(), text).when(ends, "\n").when(name.isin(*INLINE), "").otherwise(" ")
    shown = rows.where(~F.col("hidden") | ends).select("id", "pos", F.when(F.col("hidden"), F.lit("\n")).otherwise(said).alias("said"))
    shown = shown.withColumn("said", _unescaped(closed_only)("said"))
    pieces = shown.select("id", "pos", F.posexplode(F.split(F.replace("said", F.lit(" "), F.lit(" ")), "\n")).alias("k", "piece"))
    pieces = pieces.withColumn("line_no", F.count_if(F.col("k") > 0).over(Window.partitionBy("id").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, 0)))
    lines = pieces.groupBy("id", "line_no").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "piece"))).alias("s"))
    line = clean(F.regexp_replace(F.array_join(F.transform("s", lambda x: x["piece"]), ""), BROKEN_STYLE, " "))
    lines = lines.select("id", "line_no", line.alias("line")).where("line <> ''")
    return lines.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("line_no")) - 1).alias("pos"), "line")
