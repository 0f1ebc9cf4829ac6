"""The graph at rest: tables in buckets of laws, loaded in batches by key, switched all at once by a manifest.

A batch rewrites the buckets of the laws that it touches and no others. What has been written counts when a new manifest
names it; the manifest is put in place by one rename that fails if another loader was first, so readers see all of a batch
or nothing, and loading a batch twice changes nothing.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexweave.functions.numbers import law_of
from lexweave.operators.similarity import lexical_rows
from lexweave.operators.store import GraphStore

BUCKET, VERSION = "law_bucket", "version"
#: Buckets of a new warehouse: a batch for one law rewrites one of them.
BUCKETS = 64
#: Key of each table, the column that names the law it lies with, and whether that column is a provision's id.
KEYS: dict[str, tuple[list[str], str, bool]] = {
    "laws": (["law_id"], "law_id", False),
    "articles": (["article_id"], "law_id", False),
    "refs": (["from_article_id", "to_law_id", "to_number", "raw_text"], "from_article_id", True),
    "similar": (["a_article_id", "b_article_id", "model"], "a_article_id", True),
    "relations": (["a_article_id", "b_article_id", "model"], "a_article_id", True),
    "amendments": (["article_id", "suggested_text", "model"], "article_id", True),
    "drafts": (["draft_id"], "target_law_id", False),
    "intl_sources": (["source_id"], "source_id", False),
    "intl_links": (["article_id", "source_id"], "article_id", True),
    "vectors": (["id"], "id", True),
}


def law_column(name: str) -> Column:
    """The law that a row of a table lies with; empty where it has none."""
    _, column, is_id = KEYS[name]
    return F.coalesce(law_of(column) if is_id else F.col(column), F.lit(""))


def bucket_of(law: str | None, buckets: int) -> int:
    """Bucket of one law; that of a null law is that of an empty one."""
    return zlib.crc32((law or "").encode()) % buckets


@dataclass(frozen=True)
class Manifest:
    """Which version of which bucket counts: ``tables[name][bucket]``, with each table's schema."""

    number: int = 0
    buckets: int = BUCKETS
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)


class Warehouse:
    """Tables of a graph in a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # ---- manifest: Hadoop's file API, so that any store Spark writes to will do

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        """The last manifest, an empty one where nothing is loaded."""
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return Manifest(buckets=self.buckets)
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())
        if not numbers:
            return Manifest(buckets=self.buckets)
        stream = fs.open(self._path(f"manifests/{numbers[-1]:010}.json"))
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(raw))

    def _switch(self, new: Manifest) -> None:
        """Put a manifest in place, or fail where its number is taken."""
        jvm = self.spark.sparkContext._jvm
        fs, written = self._fs(), self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = fs.create(written, False)
        stream.write(bytearray(json.dumps(vars(new)).encode()))
        stream.close()
        names = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(names, 1)
        options[0] = names.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(written.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(written), fs.makeQualified(self._path(f"manifests/{new.number:010}.json")), options)

    # ---- loading

    def load(self, batch: dict[str, DataFrame]) -> Manifest:
        """Merge rows into tables: the batch's rows of a key take the place of all that the table has of it.

        Rows of one key in the batch itself all stay, for the checks of a dataset to name. Keys may be null. All tables of the
        batch are switched together.
        """
        now, version = self.manifest(), uuid.uuid4().hex
        tables, schemas = {n: dict(b) for n, b in now.tables.items()}, dict(now.schemas)
        for name, rows in batch.items():
            schemas.setdefault(name, rows.schema.json())
            touched = self._merge(name, rows.select(*StructType.fromJson(json.loads(schemas[name])).fieldNames()), now, version)
            tables[name] = tables.get(name, {}) | {str(b): version for b in touched}
        new = Manifest(now.number + 1, now.buckets, tables, schemas)
        self._switch(new)
        return new

    def _merge(self, name: str, rows: DataFrame, now: Manifest, version: str) -> list[int]:
        """Write the buckets that ``rows`` touches, old rows and new; which they are."""
        keys = KEYS[name][0]
        bucket = F.pmod(F.crc32(law_column(name)), F.lit(now.buckets)).cast("int")
        known = now.tables.get(name, {})
        placed = rows
        if known:
            touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())  # a number per bucket
            old = self._rows(name, now, [b for b in touched if str(b) in known])
            most = max(1, len(touched))
            if old is not None:
                fresh = rows.select(*[F.col(k).alias(f"new_{k}") for k in keys]).distinct()
                same = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys]
                placed = rows.unionByName(old.join(fresh, same, "left_anti"))
        order = [c for c in ("law_id", *keys) if c in rows.columns]
        placed = placed.withColumn(BUCKET, bucket).withColumn(VERSION, F.lit(version))
        if known:  # buckets are gathered as they are written anew
            parts = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // most)  # tasks of a bucket: few laws may have many rows
            placed = placed.repartition(most * parts, BUCKET, F.pmod(F.xxhash64(*keys), F.lit(parts)))
        placed = placed.sortWithinPartitions(BUCKET, *order)  # what is first loaded is written where it comes about, without an exchange
        placed.write.mode("append").partitionBy(BUCKET, VERSION).parquet(f"{self.folder}/{name}")
        return self._written(name, version)

    def _written(self, name: str, version: str) -> list[int]:
        """The buckets that have a version."""
        fs, found = self._fs(), []
        if fs.exists(self._path(name)):
            for bucket in fs.listStatus(self._path(name)):
                if bucket.isDirectory() and fs.exists(self._path(f"{name}/{bucket.getPath().getName()}/{VERSION}={version}")):
                    found.append(int(bucket.getPath().getName().removeprefix(f"{BUCKET}=")))
        return sorted(found)

    def _rows(self, name: str, now: Manifest, buckets: list[int], with_bucket: bool = False) -> DataFrame | None:
        known, folder = now.tables.get(name, {}), f"{self.folder}/{name}"
        paths = [f"{folder}/{BUCKET}={b}/{VERSION}={known[str(b)]}" for b in buckets]
        if not paths:
            return None
        schema = StructType.fromJson(json.loads(now.schemas[name]))
        full = StructType([*schema.fields, *StructType.fromDDL(f"{BUCKET} INT, {VERSION} STRING").fields])
        rows = self.spark.read.schema(full).option("basePath", folder).parquet(*paths)
        return rows.select(*schema.fieldNames(), *([BUCKET] if with_bucket else []))

    # ---- reading

    def table(self, name: str, laws: list[str] | None = None, with_bucket: bool = False) -> DataFrame:
        """Rows of a table; with ``laws`` only the files of their buckets are looked at."""
        now = self.manifest()
        if name not in now.schemas:
            raise KeyError(name)
        known = sorted(map(int, now.tables[name]))
        wanted = known if laws is None else sorted({bucket_of(law, now.buckets) for law in laws} & set(known))
        found = self._rows(name, now, wanted, with_bucket)
        if found is None:
            found = self.spark.createDataFrame([], StructType.fromJson(json.loads(now.schemas[name])))
            return found.withColumn(BUCKET, F.lit(0)) if with_bucket else found
        return found if laws is None else found.where(law_column(name).isin([law or "" for law in laws]))

    def store(self) -> GraphStore:
        """The graph over the loaded tables; filters on one law reach the files of its bucket alone."""
        now = self.manifest()
        names = [n for n in KEYS if n in now.schemas and n != "vectors"]
        return GraphStore(**{n: self.table(n, with_bucket=n == "articles") for n in names}, law_buckets=now.buckets)

    def reset(self) -> Manifest:
        """Forget all tables in one switch; ``vacuum`` frees what they took."""
        new = Manifest(self.manifest().number + 1, self.buckets)
        self._switch(new)
        return new

    def vacuum(self) -> int:
        """Delete versions that the last manifest does not name; how many. Not while others load or read older ones."""
        now, fs, gone = self.manifest(), self._fs(), 0
        for name in KEYS:
            if not fs.exists(self._path(name)):
                continue
            for bucket in fs.listStatus(self._path(name)):
                number = bucket.getPath().getName().removeprefix(f"{BUCKET}=")
                for version in fs.listStatus(bucket.getPath()) if bucket.isDirectory() else []:
                    if now.tables.get(name, {}).get(number) != version.getPath().getName().removeprefix(f"{VERSION}="):
                        gone += fs.delete(version.getPath(), True)
        return gone


def load_store(warehouse: Warehouse, store: GraphStore, vectors: bool = False) -> Manifest:
    """A graph, or a part of one, as one batch; with ``vectors`` those of the batch's provisions too."""
    batch = {n: (f.drop(BUCKET) if BUCKET in f.columns else f) for n, f in store.tables().items()}
    if vectors:
        texts = store.articles.where("text <> ''").select(F.col("article_id").alias("id"), F.col("law_id").alias("group"), "text")
        batch["vectors"] = lexical_rows(texts)
    return warehouse.load(batch)
