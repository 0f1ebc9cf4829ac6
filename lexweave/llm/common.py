"""Shared helpers of the training-text operators: durable intermediate tables, Arrow access, connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word as every contract here reads it: a run of characters other than blanks and the five ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handed to Python in record batches of about this many bytes at most (a single longer text makes its own batch).
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset a local session, whose only executor is the driver, takes a temporary folder; a cluster is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexweave-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system API, so that it works on any store Spark can write to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run_dir(spark: SparkSession) -> str:
    """Folder of this driver process inside the shared one; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/lexweave-{app}"
    if path not in _CREATED:
        _CREATED[path] = spark
    return path


_CREATED: dict[str, SparkSession] = {}


@atexit.register
def cleanup() -> None:
    """Best-effort removal of every intermediate table of this driver."""
    for path, spark in list(_CREATED.items()):
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                delete_path(spark, path)
        except Exception:  # the JVM may be gone already at interpreter exit
            pass
        _CREATED.pop(path, None)


class scratch:
    """Frees the tables that ``materialize`` writes inside a ``with`` block when the block ends, but for those told to stay.

    Blocks may nest: a table that stays belongs to the block outside. An operator's result is written inside by ``keep``, so
    that no plan reads a freed table.
    """

    _open: list[scratch] = []

    def __enter__(self) -> scratch:
        self.tables: list[tuple[SparkSession, str]] = []
        scratch._open.append(self)
        return self

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written as a table that outlives this block."""
        scratch._open.remove(self)
        try:
            return materialize(df, label)
        finally:
            scratch._open.append(self)

    def __exit__(self, *_) -> None:
        scratch._open.remove(self)
        for spark, path in self.tables:
            delete_path(spark, path)


def materialize(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of what came before, and gives the planner true
    sizes (a join side is broadcast only if its files are small). ``free`` also lets Spark's cleaner drop the shuffle
    files of the write now: it follows the driver's garbage collection, which otherwise comes by chance.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if scratch._open:
        scratch._open[-1].tables.append((spark, path))
    _PATHS[id(out)] = (weakref.ref(out), path)
    if free:
        for _ in range(2):  # the first collection may come before Spark's listeners have let go of the plan
            time.sleep(0.5)
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    return out


_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def release(df: DataFrame) -> None:
    """Delete the table behind a materialized frame. Only for a frame that no later plan reads."""
    ref, path = _PATHS.pop(id(df), (None, None))
    if path is not None and ref() is df:
        delete_path(df.sparkSession, path)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch whose ``column`` (string or binary) holds about ``limit`` bytes each."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        base = int(ends[stop - 1])
        start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def quoted(name: str) -> str:
    """A column name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, df: DataFrame) -> str:
    """``name``, lengthened until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_digest(text: Column) -> Column:
    """SHA-256 of a text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose id and text digest stand in the written table ``gone(id, sha)``; columns unchanged.

    A null id is a value like any other. By shuffle at every size, as the dropped rows grow with the input.
    """
    id_name, sha_name = free_name("gone_id", docs), free_name("gone_sha", docs)
    gone = gone.select(F.col("id").alias(id_name), F.col("sha").alias(sha_name))
    same = docs[quoted(id_col)].cast("long").eqNullSafe(gone[id_name]) & (text_digest(docs[quoted(text_col)]) == gone[sha_name])
    return docs.join(gone.hint("merge"), same, "left_anti")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every endpoint of ``edges(a long, b long)``; label is the smallest node reachable.

    Minimum labels travel along edges and over pointer jumps until nothing changes. Every round is written out,
    so nothing is gathered on the driver but the count of changed labels. The edge side of a join may be split by
    the adaptive skew handling; minima are combined before their shuffle.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    with scratch() as tables:
        both = materialize(both.distinct(), "edges")
        labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
        for _ in range(rounds):
            heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
            nearer = labels.join(heard, labels["node"] == heard["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
            nearer = materialize(nearer, "nearer")
            up = nearer.select(F.col("node").alias("p"), F.col("label").alias("up"))
            jumped = nearer.join(up, nearer["label"] == up["p"], "left").select("node", "old", F.least("label", "up").alias("label"))
            jumped = materialize(jumped, "labels")
            labels = jumped.select("node", "label")
            if jumped.where("label <> old").isEmpty():
                return tables.keep(labels, "components")
    raise RuntimeError(f"labels still changed after {rounds} rounds")
