"""Resampling towards a target: importance weights of hashed n-grams by a ring of running checksums, Gumbel top-k."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import as_bytes, materialize, partitions_for, scratch, text_slices

#: Features are runs of 1 to ``GRAM_WORDS`` words, counted in so many buckets.
GRAM_WORDS, BUCKETS = 2, 10_000
#: Documents of fewer words are not drawn; of the others this share in percent is; the seed of the draw.
LEAST_WORDS, DRAWN_PERCENT, SEED = 20, 25, 7
#: Words over UTF-8 bytes: letters, lower-cased in A-Z only, digits and everything beyond ASCII; all else separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """All words of one text in UTF-8, in order."""
    return text.translate(_WORD_BYTES).split()


def ring_buckets(words: list[bytes], longest: int = GRAM_WORDS, buckets: int = BUCKETS) -> Iterator[int]:
    """Buckets of all runs of 1 to ``longest`` words, in one pass.

    The ring holds the running checksum of each of the last ``longest`` starts. A word opens one and extends the others by a
    space and itself, so no run is ever put together; every checksum in the ring after a word is that of a run which ends there.
    """
    ring: deque[int] = deque(maxlen=longest)
    for word in words:
        tail = b" " + word
        ring.append(0)  # a start that drops out of the ring has had its longest run
        for at in range(len(ring) - 1):
            ring[at] = crc32(tail, ring[at])
        ring[-1] = crc32(word)
        for state in ring:
            yield state % buckets


def text_buckets(text: bytes, longest: int = GRAM_WORDS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words and buckets of all features of one text, repeats included."""
    words = words_of(text)
    runs = len(words) * longest - longest * (longest - 1) // 2 if len(words) >= longest else len(words) * (len(words) + 1) // 2
    return len(words), np.fromiter(ring_buckets(words, longest, buckets), np.int64, runs)


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = GRAM_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of all features of all texts: each task hands on one count a bucket, whatever it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for text in as_bytes(part.column("text")):
                    n += np.bincount(text_buckets(text, longest, buckets)[1], minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down: the logarithm of its smoothed share of the target over that of the raw text.

    ``raw`` and ``target`` are ``(bucket, n)``. One number a bucket comes to the driver, whatever the corpus.
    """
    every = raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    rows = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    sums = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    rows = rows.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))  # one row of sums
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in rows.collect():
        gains[bucket] = gain
    return gains


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = GRAM_WORDS) -> DataFrame:
    """``(id, n_words, n_features, weight)`` per row: the mean gain of its features, rounded down; zero without features."""
    buckets = len(gains)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                for text in as_bytes(part.column("text")):
                    n, own = text_buckets(text, longest, buckets)
                    rows.append((n, len(own), int(gain[own].sum()) // len(own) if len(own) else 0))
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def with_scores(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``score``: the weight and Gumbel noise in thousandths, drawn from the id alone, so that reruns agree."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise.cast("long"))


def ranked(rows: DataFrame, percent: int = DRAWN_PERCENT) -> DataFrame:
    """``rows(id, n_words, n_features, weight, score)``, written before, with ``rank``: 1, 2, 3 ... of the highest scores, null beyond ``percent``.

    The rows are dealt to ranges of score and id; sizes of the ranges (a row each) give how many rows stand before each, and a
    window numbers the rows within one. No task sees more than a range, and equal scores are split by id.
    """
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("n_words")]
    dealt = materialize(rows.repartitionByRange(partitions_for(spark), *order).withColumn("range", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"), F.call_function("div", F.sum("n").over(Window.partitionBy()) * percent, F.lit(100)).alias("drawn"))
    placed = dealt.join(before, "range").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    return placed.select(*rows.columns, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))


def target_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = GRAM_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, seed: int = SEED
) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` per row of ``docs``: ``rank`` is set for those drawn towards ``target``.

    Texts are scanned twice: for the counts of all features, then for the weights, as features are cheaper to form than to
    keep. Null and empty texts have no features, weight 0 and no rank; a null id is drawn by the noise of an empty id and
    comes last among equal scores; repeated rows are drawn one by one; an empty ``docs`` gives an empty result, and an
    empty ``target`` the weights of the smoothed uniform model. A text of any length is read whole, one at a time. Other
    columns are not read.
    """
    with scratch() as tables:
        gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets), buckets)
        scored = materialize(with_scores(weights(docs, gains, id_col, text_col, longest), seed), "scored")
        columns = ["id", "n_features", "weight", "score", "rank"]
        short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
        drawn = ranked(scored.where(F.col("n_words") >= least_words), percent)
        return tables.keep(drawn.select(*columns).union(short.select(*columns)), "drawn")


def keep_drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with their own columns; rows without id stay out."""
    drawn = target_resample(docs, target, id_col, text_col, **options).where("rank IS NOT NULL").select(F.col("id").alias("drawn_id")).distinct()
    rows, picked = docs.alias("rows"), drawn.alias("picked")
    return rows.join(picked, F.col(f"rows.`{id_col}`").cast("long") == F.col("picked.drawn_id"), "left_semi")
