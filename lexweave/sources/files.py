"""Scans and sinks: JSON lines, JSON documents, law texts, web pages, bills; JSON, Parquet and CSV out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.numbers import slug
from lexweave.operators.store import GraphStore, flatten_articles
from lexweave.sources.pages import page_lines
from lexweave.sources.schemas import empty, schema

#: Columns of an exported row, in order; fixed values.
CSV_COLUMNS = ("law_name", "provision_number", "relationship", "type", "label", "confidence", "flags", "source_url", "anchor_number", "explanation", "model", "snippet")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_jsonl(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped; a missing file is an empty table."""
    if not path_exists(spark, path):
        return empty(spark, name)
    return spark.read.schema(schema(name)).json(path)


def read_json(spark: SparkSession, path: str, name: str, field: str | None = None) -> DataFrame:
    """Rows of a whole-file JSON array, or of the array in one of its fields; a missing file is an empty table."""
    if not path_exists(spark, path):
        return empty(spark, name)
    if field is None:
        return spark.read.schema(schema(name)).json(path, multiLine=True)
    wrapped = spark.read.schema(f"{field} {_array_of(name)}").json(path, multiLine=True)
    return wrapped.select(F.inline(field))


def _array_of(name: str) -> str:
    from lexweave.sources.schemas import SCHEMAS

    return f"ARRAY<STRUCT<{SCHEMAS[name]}>>"


def load_processed(spark: SparkSession, folder: str) -> GraphStore:
    """The tables of a processed dataset; provisions flattened, derived columns added, absent files empty.

    Drafts, sources and links are read as ``write_processed`` leaves them, else from whole-file JSON.
    """
    laws = read_jsonl(spark, f"{folder}/laws.jsonl", "laws").withColumn("text_available", F.coalesce("text_available", F.lit(True)))
    international = f"{folder}/international.json"

    def written(name: str, whole: str, field: str | None = None) -> DataFrame:
        lines = f"{folder}/{name}.jsonl"
        return read_jsonl(spark, lines, name) if path_exists(spark, lines) else read_json(spark, whole, name, field)

    return GraphStore(
        laws=laws.drop("articles"),
        articles=flatten_articles(laws),
        refs=read_jsonl(spark, f"{folder}/refs.jsonl", "refs"),
        similar=read_jsonl(spark, f"{folder}/similar.jsonl", "similar"),
        relations=read_jsonl(spark, f"{folder}/relations.jsonl", "relations"),
        amendments=read_jsonl(spark, f"{folder}/amendments.jsonl", "amendments"),
        drafts=written("drafts", f"{folder}/drafts.json"),
        intl_sources=written("intl_sources", international, "sources"),
        intl_links=written("intl_links", international, "links"),
    )


def write_processed(store: GraphStore, folder: str, mode: str = "overwrite") -> None:
    """One JSON-lines folder per table, a table that is not there as an empty one; provisions go back into their laws."""
    provision = F.struct("number_key", "article_id", "number", "parent_number", "title", "text")
    nested = store.articles.groupBy("law_id").agg(F.sort_array(F.collect_list(provision)).alias("a"))
    laws = store.laws.join(nested, "law_id", "left").withColumn("articles", F.transform(F.coalesce("a", F.array().cast(nested.schema["a"].dataType)), lambda x: x.dropFields("number_key"))).drop("a")
    laws.write.mode(mode).json(f"{folder}/laws.jsonl")
    for name in ("refs", "similar", "relations", "amendments", "drafts", "intl_sources", "intl_links"):
        frame = getattr(store, name)
        (empty(store.laws.sparkSession, name) if frame is None else frame).write.mode(mode).json(f"{folder}/{name}.jsonl")


def save_tables(store: GraphStore, folder: str) -> None:
    """Parquet tables, provisions and references clustered by law, so that a law's rows share few files."""
    for name, frame in store.tables().items():
        key = {"articles": "law_id", "refs": "to_law_id"}.get(name)
        (frame.repartitionByRange(key).sortWithinPartitions(key) if key else frame).write.mode("overwrite").parquet(f"{folder}/{name}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose key they lack; running it twice changes nothing."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``law_names`` rows from a list under ``laws`` or from a map of current name to former names."""
    raw = spark.read.text(path, wholetext=True)
    listed = raw.select(F.inline(F.from_json("value", f"laws {_array_of('law_names')}")["laws"]))
    legacy = raw.where(F.get_json_object("value", "$.laws").isNull()).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("current_name", "former_names"))
    legacy = legacy.where(~F.startswith("current_name", F.lit("_")))
    rows = listed.unionByName(legacy, allowMissingColumns=True)
    blank = F.array().cast("array<string>")
    return rows.select(F.coalesce("law_id", slug("current_name")).alias("law_id"), "current_name", *[F.coalesce(c, blank).alias(c) for c in ("former_names", "short_names", "aliases")], "source_url")


def read_law_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, meta map, body)`` per text file: ``key: value`` lines before a line ``---``, if there is one."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("raw"))
    cut = F.regexp_instr(F.concat(F.lit("\n"), "raw"), F.lit(r"\n[ \t]*---[ \t]*(?=\n|$)"))
    head = F.when(cut > 0, F.substring("raw", F.lit(1), F.greatest(cut - 1, F.lit(0)))).otherwise("")
    body = F.when(cut > 0, F.regexp_replace(F.substring("raw", cut, F.lit(1 << 30)), r"^[ \t]*---[ \t]*\n?", "")).otherwise(F.col("raw"))
    lines = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")) & ~x.rlike(r"^\s*#"))
    meta = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))
    return raw.select("path", meta.alias("meta"), body.alias("body"))


def html_lines(pages: DataFrame, id_col: str, html_col: str, closed_only: bool = False) -> DataFrame:
    """``(id, pos, line)``: non-empty lines of each page, whole; see ``pages.page_lines``."""
    return page_lines(pages, id_col, html_col, closed_only=closed_only)


def split_bills(documents: DataFrame) -> DataFrame:
    """``(doc_id, bill, title, text)`` from ``(doc_id, text)``: a heading line opens a bill, its capitals are the title,
    its body runs from the first article on."""
    line = F.trim("line")
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", line.alias("line")).where("line <> ''")
    lines = lines.withColumn("head", F.col("line").rlike("^(?:Төсөл|МОНГОЛ УЛСЫН ХУУЛЬ)$")).withColumn("first", F.col("line").rlike("^1 (?:дүгээр|дугаар) зүйл"))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # a heading counts as a new bill only if a body has begun since the last one
    lines = lines.withColumn("firsts", F.sum(F.col("first").cast("int")).over(order))
    opened = Window.partitionBy("doc_id", "firsts").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("bill", F.col("firsts") + F.max(F.col("head").cast("int")).over(opened))
    body_from = F.min(F.when(F.col("first"), F.col("pos"))).over(Window.partitionBy("doc_id", "bill"))
    lines = lines.where("NOT head").withColumn("in_body", F.col("pos") >= body_from)
    upper = (F.upper("line") == F.col("line")) & ~F.col("line").rlike(r"\d") & F.col("line").rlike(r"\p{L}")
    ordered = lambda c, cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("pos", F.col("line").alias("x"))))), lambda s: s["x"]), c)
    bills = lines.groupBy("doc_id", "bill").agg(ordered(" ", ~F.coalesce("in_body", F.lit(False)) & upper).alias("t"), ordered("\n", F.col("in_body") & ~F.startswith("line", F.lit("ГАРЫН"))).alias("text"))
    return bills.where("t <> '' AND text <> ''").select("doc_id", "bill", F.concat(F.substring("t", 1, 1), F.lower(F.expr("substring(t, 2)"))).alias("title"), "text")


def bill_page_lines(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id, text)`` of a bill's web page: from its first article to its attachment, widget words and bare numbers
    dropped, an article's heading joined with the line after it."""
    lines = html_lines(pages, id_col, html_col).where(~F.col("line").isin("comment", "thumb_up_alt", "thumb_down_alt") & ~F.col("line").rlike("^[0-9]+$"))
    whole = Window.partitionBy("id")
    start = F.min(F.when(F.col("line").rlike(r"^1 (?:дүгээр|дугаар) зүйл\."), F.col("pos"))).over(whole)
    end = F.min(F.when(F.contains("line", F.lit("download file")) | F.startswith("line", F.lit("insert_drive_file")), F.col("pos"))).over(whole)
    lines = lines.withColumn("start", start).withColumn("stop", end).where("pos >= start AND pos < coalesce(stop, 2147483647)")
    head = F.col("line").rlike(r"^[0-9]+[¹²³]? (?:дүгээр|дугаар) зүйл\.$")
    order = Window.partitionBy("id").orderBy("pos")
    lines = lines.withColumn("glue", F.coalesce(F.lag(head).over(order), F.lit(False)))
    piece = F.concat(F.when(F.col("glue"), "").otherwise("\n"), "line")
    return lines.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("x")))).alias("p")).select("id", F.regexp_replace(F.array_join(F.transform("p", lambda s: s["x"]), ""), "^\n", "").alias("text"))


def csv_text(rows: DataFrame) -> DataFrame:
    """``rows`` as data lines of a CSV file; ``write_csv`` adds byte order mark, header and CRLF."""
    plain = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS])

    def quoted(c: str) -> Column:
        return F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))

    return plain.select(F.concat_ws(",", *[quoted(c) for c in CSV_COLUMNS]).alias("value"))


#: Order of the rows of an export: by list, law and provision.
CSV_ORDER = ("relationship", "law_name", "provision_number", "anchor_number", "snippet")


def write_csv(rows: DataFrame, folder: str, order: Sequence[str] = CSV_ORDER) -> None:
    """One file in ``folder``, rows in order, with one header that opens with the byte order mark; lines end in CRLF.

    The rows are sorted by ranges over all tasks; one task then streams the ranges into the file one after the other.
    """
    plain = rows.select(*CSV_COLUMNS).orderBy(*order, *[c for c in CSV_COLUMNS if c not in order]).withColumnRenamed(CSV_COLUMNS[0], "\ufeff" + CSV_COLUMNS[0])
    plain.coalesce(1).write.mode("overwrite").csv(folder, header=True, lineSep="\r\n", emptyValue="", escape='"')
