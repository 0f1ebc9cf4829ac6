"""A citation graph derived from the star-schema tables, so that every operator runs on data of any size.

The same SQL defines the derived tables for Spark and for DuckDB. Laws are nations; provisions are customers
(``12``), their orders (``12.340``) and the order's lines (``12.340.1``); an order cites the next order with the same
part. A tenth of the citations misses its target, a tenth names the whole law, a tenth uses an old name. Every part is
a source, every order is linked to one and has a suggested amendment, a third of them on a source that is not there.

The derivation is the loading of a store, so it is done once per application, folder and table; queries read its tables.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.explore import Exploration
from lexweave.operators.services import provision_index
from lexweave.operators.store import GraphStore, with_keys
from lexweave.operators.textindex import TextIndex, build_index
from lexweave.plans.session import table
from lexweave.sources.scratch import folder as scratch_folder
from lexweave.sources.warehouse import BUCKET, Warehouse

SOURCES = ("nation", "customer", "orders", "lineitem", "part")
#: Buckets that the laws of the derived graph lie in.
LAW_BUCKETS = 16
#: Orders that a task joins at once, with their lines or citations; more tasks than the session's shuffle partitions where need be.
TASK_ORDERS = 100_000
LAWS = "SELECT 'law-' || CAST(n_nationkey AS STRING) AS law_id, n_name AS name, 'old ' || n_name AS former_name, 'https://laws.example/' || CAST(n_nationkey AS STRING) AS source_url, n_nationkey < 20 AS text_available FROM nation"
ORDER_IDS = """
SELECT o_orderkey AS ok, 'law-' || CAST(c_nationkey AS STRING) AS law_id, c_custkey AS ck, CAST(c_custkey AS STRING) || '.' || CAST(o_orderkey AS STRING) AS number,
       o_orderpriority, o_orderstatus, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey"""
ARTICLES = """
SELECT law_id, law_id || ':' || number AS article_id, number, parent_number, title, text FROM (
  SELECT 'law-' || CAST(c_nationkey AS STRING) AS law_id, CAST(c_custkey AS STRING) AS number, CAST(NULL AS STRING) AS parent_number, c_name AS title, c_mktsegment || ' account' AS text FROM customer
  UNION ALL
  SELECT law_id, number, CAST(ck AS STRING) AS parent_number, CAST(NULL AS STRING) AS title, o_orderpriority || ' status ' || o_orderstatus AS text FROM order_ids
  UNION ALL
  SELECT law_id, number || '.' || CAST(l_linenumber AS STRING) AS number, number AS parent_number, CAST(NULL AS STRING) AS title, l_returnflag || ' ' || l_linestatus || ' line' AS text FROM lineitem JOIN order_ids ON l_orderkey = ok
) provisions"""
EDGES = """
SELECT DISTINCT src, dst FROM (
  SELECT l_orderkey AS src, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS dst FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) parts
) chains WHERE dst IS NOT NULL"""
REFS = """
SELECT f.law_id || ':' || f.number AS from_article_id, t.law_id AS to_law_id,
       CASE (src + dst) % 10 WHEN 0 THEN CAST(t.ck AS STRING) || '.' || CAST(dst + 100000000 AS STRING) WHEN 1 THEN NULL ELSE t.number END AS to_number,
       CASE WHEN (src + dst) % 10 > 1 THEN t.law_id || ':' || t.number END AS to_article_id,
       'see ' || t.number AS raw_text, CASE WHEN (src + dst) % 10 = 2 THEN 'old ' || n_name ELSE n_name END AS matched_name,
       (src + dst) % 10 = 2 AS uses_old_name, (src + dst) % 10 = 0 AS target_missing, 'regex' AS method, 1.0 AS confidence,
       CASE WHEN (src + dst) % 20 = 0 THEN t.number END AS current_number
FROM edges JOIN order_ids f ON src = f.ok JOIN order_ids t ON dst = t.ok JOIN nation ON 'law-' || CAST(n_nationkey AS STRING) = t.law_id"""
_PAIRS = "FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 7 WHERE a.c_nationkey <> b.c_nationkey"
_IDS = "'law-' || CAST(a.c_nationkey AS STRING) || ':' || CAST(a.c_custkey AS STRING) AS a_id, 'law-' || CAST(b.c_nationkey AS STRING) || ':' || CAST(b.c_custkey AS STRING) AS b_id, a.c_custkey AS k"
SIMILAR = f"SELECT least(a_id, b_id) AS a_article_id, greatest(a_id, b_id) AS b_article_id, (60 + k % 40) / 100.0 AS score, 'demo-ngram-v1' AS model FROM (SELECT {_IDS} {_PAIRS}) pairs"
RELATIONS = f"SELECT least(a_id, b_id) AS a_article_id, greatest(a_id, b_id) AS b_article_id, CASE k % 3 WHEN 0 THEN 'conflict' WHEN 1 THEN 'overlap' ELSE 'consistent' END AS kind, (50 + k % 50) / 100.0 AS confidence, 'pair ' || CAST(k AS STRING) AS explanation, 'demo-heuristic' AS model FROM (SELECT {_IDS} {_PAIRS}) pairs"
INTL_SOURCES = "SELECT 'src-' || CAST(p_partkey AS STRING) AS source_id, CASE WHEN p_size % 2 = 0 THEN 'treaty' ELSE 'foreign_law' END AS kind, p_brand AS country_or_org, p_name AS title, 'https://sources.example/' || CAST(p_partkey AS STRING) AS url, p_type AS summary, CAST(NULL AS STRING) AS provision FROM part"
INTL_LINKS = "SELECT law_id || ':' || number AS article_id, 'src-' || CAST(ck + ok % 7 AS STRING) AS source_id, (ok % 97) / 97.0 AS relevance, 'link ' || CAST(ok AS STRING) AS explanation, 'demo' AS model FROM order_ids"
AMENDMENTS = "SELECT law_id || ':' || number AS article_id, 'reason ' || CAST(ok AS STRING) AS reason, 'text ' || CAST(ok AS STRING) AS suggested_text, 'src-' || CAST(CASE WHEN ok % 3 = 0 THEN ok + 100000000 ELSE ck END AS STRING) AS base_1, law_id || ':' || CAST(ck AS STRING) AS base_2, 'demo' AS model, CASE WHEN ok % 2 = 0 THEN 0.7 END AS confidence FROM order_ids"
#: Derived tables in order of dependence.
DERIVED = {
    "laws": LAWS, "order_ids": ORDER_IDS, "articles": ARTICLES, "edges": EDGES, "refs": REFS, "similar_edges": SIMILAR, "relations": RELATIONS,
    "intl_sources": INTL_SOURCES, "intl_links": INTL_LINKS, "amendments": AMENDMENTS,
}


def with_derived(sql: str, *names: str) -> str:
    """A DuckDB query over derived tables: only those that are named, and what they need, come before it."""
    need = {"articles": {"order_ids"}, "refs": {"order_ids", "edges"}, "intl_links": {"order_ids"}, "amendments": {"order_ids"}}
    wanted = set(names)
    for n in names:
        wanted |= need.get(n, set())
    parts = [f"{n} AS ({DERIVED[n]})" for n in DERIVED if n in wanted]
    head = "WITH RECURSIVE " + ", ".join(parts)
    body = sql.strip()
    return f"{head}, {body[5:]}" if body.startswith("WITH ") else f"{head} {body}"


def derive(spark: SparkSession, sf_dir: str, *names: str, known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Derived tables as plans; session-wide names are not used, so queries do not meet. ``known`` ones are taken as they are."""
    frames = {t: table(spark, sf_dir, t) for t in SOURCES}
    out: dict[str, DataFrame] = dict(known or {})
    # one exchange by part serves both what is distinct in a part and the order in it
    lines = frames["lineitem"].select("l_partkey", "l_orderkey")
    by_part = {"lineitem": _dealt(lines, "l_partkey", 4 * TASK_ORDERS) if "edges" in names else lines.repartition("l_partkey")}
    for name, sql in DERIVED.items():
        if name not in out:
            out[name] = spark.sql(_placed(sql), **(frames | by_part if name == "edges" else frames), **out)
    return {k: out[k] for k in (names or DERIVED)}


def _dealt(frame: DataFrame, key: str, rows: int) -> DataFrame:
    """A table dealt by a key to tasks of some ``rows`` rows, where the session's shuffle partitions would be larger."""
    tasks, session = frame.count() // rows, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(tasks, key) if tasks > session else frame.repartition(key)


def _placed(sql: str) -> str:
    """Table names as parameters of ``spark.sql``."""
    return re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", sql).replace("{provisions}", "provisions").replace("{chains}", "chains")


def derived_graph(spark: SparkSession, sf_dir: str, known: dict[str, DataFrame] | None = None) -> GraphStore:
    """The graph as plans over the star-schema tables."""
    d = derive(spark, sf_dir, known=known)
    blank = F.array().cast("array<string>")
    laws = d["laws"].select("law_id", "name", F.array("former_name").alias("former_names"), blank.alias("short_names"), F.lit(None).cast("string").alias("adopted_date"), "source_url", "text_available")
    double = lambda frame, *cs: frame.withColumns({c: F.col(c).cast("double") for c in cs})
    return GraphStore(
        laws=laws, articles=with_keys(d["articles"]), refs=double(d["refs"], "confidence"), similar=double(d["similar_edges"], "score"), relations=double(d["relations"], "confidence"),
        amendments=double(d["amendments"], "confidence").withColumn("based_on_source_ids", F.array("base_1", "base_2")).drop("base_1", "base_2"),
        intl_sources=d["intl_sources"], intl_links=double(d["intl_links"], "relevance"),
    )


#: Folders of what is loaded, by application, folder and kind.
_LOADED: dict[tuple[str, ...], str] = {}
#: Tables that others are derived from and that are worth writing first, and the loaded tables that need them.
_FIRST = {"order_ids": ("articles", "refs", "intl_links", "amendments"), "edges": ("refs",)}


def _first(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Tables that others are derived from, each written once per application."""
    out = {}
    for name in names:
        key = (spark.sparkContext.applicationId, sf_dir, "first", name)
        if key not in _LOADED:
            folder = scratch_folder(spark, "graph")
            derive(spark, sf_dir, name)[name].write.parquet(f"{folder}/{name}")
            _LOADED[key] = folder
        out[name] = spark.read.parquet(f"{_LOADED[key]}/{name}")
        if name == "order_ids" and out[name].count() // TASK_ORDERS > int(spark.conf.get("spark.sql.shuffle.partitions")):
            out[name] = _dealt(out[name], "ok", TASK_ORDERS)  # joins with it take its partitions
    return out


class LoadedStore(GraphStore):
    """The graph over the star-schema tables; a table is loaded into a warehouse when an application first reads it, so a query
    pays for the tables that it names and no others. Keys and ancestors of provisions follow from their numbers as they are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        for name, value in {"_spark": spark, "_sf_dir": sf_dir, "law_buckets": LAW_BUCKETS}.items():
            object.__setattr__(self, name, value)

    def _table(self, name: str) -> DataFrame:
        spark, sf_dir = self._spark, self._sf_dir
        place = (spark.sparkContext.applicationId, sf_dir, "graph")
        if place not in _LOADED:
            _LOADED[place] = scratch_folder(spark, "graph")
        warehouse = Warehouse(spark, _LOADED[place], LAW_BUCKETS)
        if (*place, name) not in _LOADED:
            known = _first(spark, sf_dir, *[f for f, needed in _FIRST.items() if name in needed])
            warehouse.load({name: getattr(derived_graph(spark, sf_dir, known), name).drop("number_key", "ancestor_ids")})
            _LOADED[(*place, name)] = _LOADED[place]
        if name != "articles":
            return warehouse.table(name)
        rows = with_keys(warehouse.table(name, with_bucket=True))
        return rows.select(*[c for c in rows.columns if c != BUCKET], BUCKET)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in LOADED_TABLES}


#: Tables of the derived graph: drafts it has none.
LOADED_TABLES = ("laws", "articles", "refs", "similar", "relations", "amendments", "intl_sources", "intl_links")
for _name in LOADED_TABLES:
    setattr(LoadedStore, _name, property(partial(LoadedStore._table, name=_name)))


def graph(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The graph as its tables are loaded into a warehouse, each at its first use by an application."""
    return LoadedStore(spark, sf_dir)


def document_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of all documents, built at the first call of an application."""
    key = (spark.sparkContext.applicationId, sf_dir, "documents")
    if key not in _LOADED:
        folder = scratch_folder(spark, "graph")
        build_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), folder)
        _LOADED[key] = folder
    return TextIndex(spark, _LOADED[key])


def graph_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of all provisions, built at the first call of an application."""
    key = (spark.sparkContext.applicationId, sf_dir, "provisions")
    if key not in _LOADED:
        folder = scratch_folder(spark, "graph")
        provision_index(graph(spark, sf_dir), folder)
        _LOADED[key] = folder
    return TextIndex(spark, _LOADED[key])


# ---- the exploration graph -----------------------------------------------------------------------------------------

#: Tables of the exploration graph, ids local to a law: chapters are the customers' segments, articles the customers,
#: provisions their orders and the orders' lines, actors the suppliers, terms the parts, topics the price bands.
EXPLORED = {
    "x_chapters": "SELECT DISTINCT 'law-' || CAST(c_nationkey AS STRING) AS law_id, 'ch-' || c_mktsegment AS id, length(c_mktsegment) AS number, c_mktsegment AS title FROM customer",
    "x_sections": "SELECT DISTINCT 'law-' || CAST(c_nationkey AS STRING) AS law_id, 'sec-' || CAST(c_custkey % 3 AS STRING) || '-' || c_mktsegment AS id, 'ch-' || c_mktsegment AS chapter FROM customer",
    "x_articles": "SELECT 'law-' || CAST(c_nationkey AS STRING) AS law_id, 'art' || CAST(c_custkey AS STRING) AS id, CAST(c_custkey AS STRING) AS number, c_name AS title, c_mktsegment || ' account' AS text, CASE WHEN c_custkey % 4 = 3 THEN 'ch-' || c_mktsegment ELSE 'sec-' || CAST(c_custkey % 3 AS STRING) || '-' || c_mktsegment END AS chapter FROM customer",
    "x_provisions": """SELECT law_id, number AS id, number, 'art' || CAST(ck AS STRING) AS article, CAST(NULL AS STRING) AS parent, o_orderpriority || ' status ' || o_orderstatus AS text, CASE o_orderstatus WHEN 'P' THEN 'хүчингүй' ELSE 'хүчинтэй' END AS status, CASE o_orderstatus WHEN 'F' THEN 'үүрэг' WHEN 'O' THEN 'эрх' END AS said FROM order_ids
UNION ALL SELECT law_id, number || '.' || CAST(l_linenumber AS STRING), number || '.' || CAST(l_linenumber AS STRING), 'art' || CAST(ck AS STRING), number, l_returnflag || ' ' || l_linestatus || ' line', 'хүчинтэй', CASE l_returnflag WHEN 'R' THEN 'хориглол' END FROM lineitem JOIN order_ids ON l_orderkey = ok""",
    "x_refs": "SELECT f.law_id, f.number AS from_id, CASE WHEN dst % 5 = 0 THEN 'art' || CAST(t.ck AS STRING) ELSE t.number END AS to_id, CASE src % 3 WHEN 0 THEN 'exception' WHEN 1 THEN 'basis' END AS role FROM edges JOIN order_ids f ON src = f.ok JOIN order_ids t ON dst = t.ok WHERE f.law_id = t.law_id",
    "x_external": "SELECT f.law_id, f.number AS from_id, t.law_id AS target FROM edges JOIN order_ids f ON src = f.ok JOIN order_ids t ON dst = t.ok WHERE f.law_id <> t.law_id",
    "x_amended": "SELECT law_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS type, number AS target FROM order_ids",
    "x_mentions": "SELECT law_id, number || '.' || CAST(l_linenumber AS STRING) AS from_id, 'actor-' || CAST(l_suppkey AS STRING) AS to_id FROM lineitem JOIN order_ids ON l_orderkey = ok UNION ALL SELECT law_id, number || '.' || CAST(l_linenumber AS STRING), 'term-' || CAST(l_partkey AS STRING) FROM lineitem JOIN order_ids ON l_orderkey = ok",
    "x_terms": "SELECT 'law-' || CAST(p_partkey % 25 AS STRING) AS law_id, 'term-' || CAST(p_partkey AS STRING) AS id, p_name || ' ' || CAST(p_partkey AS STRING) AS name, CAST(p_size AS STRING) AS defined_in, p_type AS definition FROM part",
    "x_actors": "SELECT 'actor-' || CAST(s_suppkey AS STRING) AS id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'state' ELSE 'person' END AS category FROM supplier",
    "x_norms": "SELECT law_id, number || '.' || CAST(l_linenumber AS STRING) AS id, CASE l_returnflag WHEN 'R' THEN 'prohibition' WHEN 'A' THEN 'duty' ELSE 'right' END AS kind, o_orderpriority AS bearer, CASE WHEN l_linenumber < 5 THEN 'actor ' || CAST(l_linenumber AS STRING) END AS towards, 'act ' || CAST(l_partkey AS STRING) AS action, l_linestatus AS condition FROM lineitem JOIN order_ids ON l_orderkey = ok",
    "x_topics": "SELECT 'law-' || CAST(c_nationkey AS STRING) AS law_id, 'art' || CAST(c_custkey AS STRING) AS article, c_mktsegment AS name, length(c_mktsegment) AS size FROM customer",
    "x_similar": "SELECT f.law_id, f.number AS a, t.number AS b, (src + dst) % 100 / 100.0 AS score FROM edges JOIN order_ids f ON src = f.ok JOIN order_ids t ON dst = t.ok WHERE f.law_id = t.law_id",
}
EXPLORED_SOURCES = ("customer", "lineitem", "part", "supplier")


def with_explored(sql: str, *names: str) -> str:
    """A DuckDB query over tables of the exploration graph."""
    return with_derived(", ".join(["WITH " + f"{names[0]} AS ({EXPLORED[names[0]]})", *[f"{n} AS ({EXPLORED[n]})" for n in names[1:]]]) + " " + sql.strip(), "order_ids", "edges")


#: Tables of the exploration graph by the list that they are.
EXPLORED_LISTS = {f: "x_" + f for f in ("chapters", "sections", "articles", "provisions", "refs", "external", "mentions", "terms", "actors", "norms", "topics", "similar")} | {"amendments": "x_amended"}


class LoadedExploration(Exploration):
    """The exploration graph over the star-schema tables; a table is loaded when an application first reads it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        for name, value in {"_spark": spark, "_sf_dir": sf_dir}.items():
            object.__setattr__(self, name, value)

    def _table(self, name: str) -> DataFrame:
        spark, sf_dir, derived = self._spark, self._sf_dir, EXPLORED_LISTS[name]
        key = (spark.sparkContext.applicationId, sf_dir, "explored", name)
        if key not in _LOADED:
            read = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", EXPLORED[derived]))
            known = _first(spark, sf_dir, *[f for f in _FIRST if f in read]) | {t: table(spark, sf_dir, t) for t in EXPLORED_SOURCES if t in read}
            frame, folder = spark.sql(_placed(EXPLORED[derived]), **known), scratch_folder(spark, "graph")
            if name == "provisions":
                said = F.when(F.col("said").isNull(), F.array().cast("array<string>")).otherwise(F.array("said"))
                frame = frame.withColumn("modality", said).drop("said")
            if name == "similar":
                frame = frame.withColumn("score", F.col("score").cast("double"))
            frame.write.parquet(f"{folder}/{derived}")
            _LOADED[key] = folder
        return spark.read.parquet(f"{_LOADED[key]}/{derived}")

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in EXPLORED_LISTS}


for _name in EXPLORED_LISTS:
    setattr(LoadedExploration, _name, property(partial(LoadedExploration._table, name=_name)))


def explored(spark: SparkSession, sf_dir: str) -> Exploration:
    """The exploration graph, each table loaded once like those of the store."""
    return LoadedExploration(spark, sf_dir)
