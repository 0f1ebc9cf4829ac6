"""The bulk loader: batches by key, buckets that stay as they are, the switch of manifests; and the stored text index."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import services, textindex
from lexweave.operators.store import GraphStore, with_keys
from lexweave.sources.schemas import schema
from lexweave.sources.warehouse import BUCKET, Warehouse, bucket_of, load_store

LAWS = "law_id string, name string, former_names array<string>, short_names array<string>, adopted_date string, source_url string, text_available boolean"
ARTICLES = "law_id string, article_id string, number string, parent_number string, title string, text string"


def graph(spark, laws, text="цагийн бичвэр"):
    rows = [(law, f"{law}:{n}", n, None, None, f"{text} {law} {n}") for law in laws for n in ("1", "1.1", "2")]
    refs = [{"from_article_id": f"{law}:1", "to_law_id": "a", "to_number": n, "to_article_id": None, "raw_text": "r", "matched_name": "m", "uses_old_name": False, "target_missing": False, "method": "regex", "confidence": 1.0, "current_number": None} for law in laws for n in ("1", None)]
    return GraphStore(spark.createDataFrame([(law, law, [], [], None, "https://x", True) for law in laws], LAWS), with_keys(spark.createDataFrame(rows, ARTICLES)), spark.createDataFrame(refs, schema("refs")))


def content(warehouse):
    return {n: Counter(map(str, warehouse.table(n).collect())) for n in ("laws", "articles", "refs", "vectors")}


def files(warehouse, name):
    return {f.rpartition("/")[0].partition(f"{BUCKET}=")[2]: f for f in warehouse.table(name).inputFiles()}


def test_loading_twice_changes_nothing_and_a_batch_only_its_buckets(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), 7)
    laws = [f"law-{k}" for k in range(12)]
    load_store(w, graph(spark, laws), vectors=True)
    first = content(w)
    assert len(first["articles"]) == 36 and len(first["vectors"]) == 36 and sum(first["refs"].values()) == 24
    load_store(w, graph(spark, laws), vectors=True)
    assert content(w) == first
    before = files(w, "articles")
    load_store(w, graph(spark, ["law-3", "new"], text="өөр"), vectors=True)
    after, touched = files(w, "articles"), {bucket_of(law, 7) for law in ("law-3", "new")}
    kept = [p for p in before if int(p.partition("/")[0]) not in touched]
    assert kept and all(after[p] == before[p] for p in kept)
    now = w.table("articles")
    assert now.count() == 39 and {r.text[:3] for r in now.where("law_id = 'law-3'").collect()} == {"өөр"} and now.where("law_id = 'law-4'").first().text.startswith("цаг")
    assert w.table("refs").count() == 26


def test_filters_on_a_law_reach_its_bucket_only(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), 5)
    load_store(w, graph(spark, [f"law-{k}" for k in range(12)]))
    assert len(w.table("articles", ["law-3"]).inputFiles()) == 1 and w.table("articles", ["law-3"]).count() == 3 and w.table("articles", ["none"]).count() == 0
    store = w.store()
    for rows in (store.articles_of("law-3"), store.article("law-3:1.1"), store.subtree("law-3:1")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(law_bucket" in plan, plan
        read = {r.f for r in rows.select(F.input_file_name().alias("f")).collect()}
        assert len(read) == 1
    assert [r.number for r in store.articles_of("law-3").collect()] == ["1", "1.1", "2"] and [r.number for r in store.subtree("law-3:1").collect()] == ["1", "1.1"]
    assert store.refs_from(store.subtree("law-3:1")).count() == 2


def test_two_loaders_do_not_overwrite_each_other(spark, tmp_path):
    one, two = Warehouse(spark, str(tmp_path), 3), Warehouse(spark, str(tmp_path), 3)
    one.load({"laws": graph(spark, ["a"]).laws})
    stale = two.manifest()
    one.load({"laws": graph(spark, ["b"]).laws})
    two.manifest = lambda: stale
    with pytest.raises(Exception, match="exist"):
        two.load({"laws": graph(spark, ["c"]).laws})
    assert sorted(r.law_id for r in Warehouse(spark, str(tmp_path), 3).table("laws").collect()) == ["a", "b"]


def test_reset_vacuum_null_keys_and_empty_batches(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), 3)
    with pytest.raises(KeyError):
        w.table("laws")
    w.load({"laws": graph(spark, []).laws})
    assert w.table("laws").count() == 0
    rows = graph(spark, ["a"]).refs
    nulls = rows.where("to_number IS NULL").withColumn("from_article_id", F.lit(None).cast("string"))
    for _ in range(2):
        w.load({"refs": rows.unionByName(nulls)})
    assert w.table("refs").count() == 3 and w.table("refs", [""]).count() == 1
    assert w.vacuum() > 0 and w.table("refs").count() == 3
    w.reset()
    with pytest.raises(KeyError):
        w.table("refs")
    assert w.vacuum() > 0


# ---- the text index ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeц") for _ in range(rng.randint(1, 11))) for _ in range(400)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 90])))) for i in range(120)] + [(500, None), (501, ""), (502, "12.3 Abc, abc")]
    frame = spark.createDataFrame(texts, "id long, text string")
    return textindex.build_index(frame, str(tmp_path_factory.mktemp("index")), shard_rows=300), texts


def terms(text):
    import re

    return re.findall(r"[0-9]+(?:\.[0-9]+)*|[а-яөүёa-z]+", (text or "").lower())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_terms_within_a_distance(spark, index, edits):
    ix, texts = index
    known = {t for _, x in texts for t in terms(x)}
    for word in sorted(known)[::60] + ["abcabcabcabc", "a", "zzz"]:
        assert {r.term for r in ix.like(word, edits).collect()} == {t for t in known if distance(t, word) <= edits}, word


def test_scores_equal_bm25_by_hand(index):
    ix, texts = index
    counts = {i: Counter(terms(x)) for i, x in texts}
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    word = max({t for c in counts.values() for t in c}, key=lambda t: (len(t), t))[:5]
    for words, edits in ((["abc", "12.3"], 0), ([word, "abc"], 2)):
        wanted = {}
        for w in words:
            tf = {i: n for i, c in counts.items() if (n := sum(k for t, k in c.items() if distance(t, w) <= edits))}
            for i, n in tf.items():
                idf = math.log(1 + (len(counts) - len(tf) + 0.5) / (len(tf) + 0.5))
                wanted[i] = wanted.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(counts[i].values()) / mean))
        found = ix.full_text(words, edits, None).collect()
        assert {r.id for r in found} == set(wanted) and all(abs(r.score - wanted[r.id]) < 1e-9 for r in found)
        assert [r.id for r in found] == sorted(wanted, key=lambda i: (-round(wanted[i], 12), i))
    assert ix.full_text([]).count() == 0 and ix.full_text(["nowhere"]).count() == 0


def test_only_the_shards_asked_for_are_read(spark, index):
    ix, texts = index
    shards = len(ix._ranges["postings"])
    assert shards > 5
    one = ix.postings_of(["abc"])
    assert "shard" in one._jdf.queryExecution().executedPlan().toString()
    assert len({r.f for r in one.select(F.input_file_name().alias("f")).collect()}) == 1
    lows = sorted(low for _, low, _ in ix._ranges["postings"])
    assert lows == sorted({low for low in lows}) and all(a[2] < b[1] for a, b in zip(sorted(ix._ranges["postings"], key=lambda r: r[1]), sorted(ix._ranges["postings"], key=lambda r: r[1])[1:]))
    opened = {t for _, x in texts for t in terms(x) if t.startswith("ab") or (len(t) >= 4 and "ab".startswith(t))}
    assert {r.term for r in ix.opening("ab").collect()} == opened


def test_search_over_the_index_is_the_search_over_texts(spark, tmp_path):
    store = graph(spark, ["ажил", "цаг", "c"], text="Ажилтны цагийн бичвэр")
    ix = services.provision_index(store, str(tmp_path))
    for query in ("цаг", "ажилтан 1", "1.1", "ажил цаг бичвэр", "c бичвэр", "юу ч биш", ""):
        plain, stored = (services.search(store, query, i).collect() for i in (None, ix))
        assert plain == stored, query
    assert services.search(store, "цаг", ix).count() == 9


def test_a_query_loads_the_tables_that_it_reads(spark, monkeypatch):
    from lexweave.plans import catalog, corpus

    monkeypatch.setattr(corpus, "_LOADED", {})
    sf_dir = "/root/testdata/sf0.001"
    loaded = lambda kind: {k[3] for k in corpus._LOADED if k[2] == kind and len(k) == 4}
    assert catalog.QUERIES["g_laws_count"](spark, sf_dir).count() == 25 and loaded("graph") == {"laws", "articles"} and loaded("first") == {"order_ids"}
    catalog.QUERIES["m_topk_either"](spark, sf_dir).count()
    assert loaded("graph") == {"laws", "articles", "similar"}
    catalog.QUERIES["c_repealed"](spark, sf_dir).count()
    assert loaded("explored") == {"provisions"} and loaded("first") == {"order_ids"}
    assert set(corpus.graph(spark, sf_dir).tables()) == loaded("graph") == set(corpus.LOADED_TABLES)
    assert set(corpus.explored(spark, sf_dir).tables()) == loaded("explored") == set(corpus.EXPLORED_LISTS)


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = with_keys(spark.range(400).selectExpr("'law-1' AS law_id", "'law-1:' || id AS article_id", "CAST(id AS STRING) AS number", "CAST(NULL AS STRING) AS parent_number", "CAST(NULL AS STRING) AS title", "'t' AS text"))
    w = Warehouse(spark, str(tmp_path), 1)  # one bucket, four shuffle partitions
    w.load({"articles": rows})
    assert 1 < len(w.table("articles", ["law-1"]).inputFiles()) <= 4 and w.table("articles", ["law-1"]).count() == 400


def test_the_postings_of_one_term_fill_several_shards(spark, tmp_path):
    texts = spark.range(0, 3000, 1, 3).selectExpr("id", "concat('common word', id % 7) AS text")
    index = textindex.build_index(texts, str(tmp_path), shard_rows=500)
    rows = spark.read.parquet(f"{tmp_path}/postings").groupBy("shard").count().collect()
    assert max(r["count"] for r in rows) < 1500  # before: 3000, all of the common term
    assert index.postings_of(["common"]).count() == 3000 and index.postings_from("word").count() == 3000
    assert [r.id for r in index.full_text(["3"], limit=None).select("id").orderBy("id").collect()] == list(range(3, 3000, 7))
    assert {r.term for r in index.like("comon", 1).collect()} == {"common"}


def test_a_first_load_is_written_where_its_rows_come_about(spark, tmp_path):
    rows = with_keys(spark.range(0, 400, 1, 3).selectExpr("'law-1' AS law_id", "'law-1:' || id AS article_id", "CAST(id AS STRING) AS number", "CAST(NULL AS STRING) AS parent_number", "CAST(NULL AS STRING) AS title", "'t' AS text"))
    w = Warehouse(spark, str(tmp_path), 1)
    w.load({"articles": rows})
    assert len(w.table("articles").inputFiles()) == 3  # before: four, by an exchange
    w.load({"articles": rows.where("length(number) = 1")})
    assert w.table("articles").count() == 400 and w.table("articles").select("article_id").distinct().count() == 400


def test_chains_of_a_part_take_one_exchange(spark):
    from lexweave.plans.corpus import derive

    plan = derive(spark, "/root/testdata/sf0.001", "edges")["edges"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # before: three


def test_a_large_table_is_dealt_to_more_tasks_than_the_session_has(spark, monkeypatch):
    from lexweave.plans import corpus

    frame = spark.range(90)
    assert corpus._dealt(frame, "id", 10).rdd.getNumPartitions() == 9
    assert ", 9)" not in corpus._dealt(frame, "id", 45)._jdf.queryExecution().executedPlan().toString()
    wanted = sorted(corpus.derive(spark, "/root/testdata/sf0.001", "edges")["edges"].collect())
    monkeypatch.setattr(corpus, "TASK_ORDERS", 100)
    assert sorted(corpus.derive(spark, "/root/testdata/sf0.001", "edges")["edges"].collect()) == wanted


@pytest.mark.parametrize("name", ["q_search_two_words", "q_search_law_name"])
def test_one_search_reads_the_texts_and_builds_no_index(spark, monkeypatch, name):
    from lexweave.plans import catalog, corpus

    monkeypatch.setattr(corpus, "_LOADED", {})
    found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {k[2:] for k in corpus._LOADED if k[2] != "first"} == {("graph",), ("graph", "laws"), ("graph", "articles")}  # before: the index of provisions too
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()  # no provision is dealt anew
    assert found.count() > 0


def test_first_letters_hide_no_match(spark):
    texts = ["Ажилтны цагийн бичвэр", "АЖИЛ", "ажи", "FURNITURE account", "accounting 12.3", "a ccounts", "acc", "о нь", "İstanbul", "x цаг", None, ""]
    words = ["ажилт", "ажил", "furn", "accounts", "acco", "нь", "цаг", "istan", "furnituresque", "on"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.stems(F.coalesce("text", F.lit(""))).alias("bag"))
    for w in words:
        met = rows.select(T.prefix_match(F.col("bag"), F.lit(w)).alias("is"), T.may_match(F.coalesce("text", F.lit("")), w).alias("may")).collect()
        assert all(r["may"] for r in met if r["is"]) and not all(r["may"] for r in met), w
    assert sum(rows.select(T.prefix_match(F.col("bag"), F.lit(w)).alias("is")).where("is").count() for w in words) > 8
