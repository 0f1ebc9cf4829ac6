"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import as_bytes, materialize, quoted, text_digest, text_slices, without_rows

#: Buckets that words and word pairs are hashed into; both models hold a count for each, whatever the corpus.
BUCKETS = 1 << 15
#: Labelled rows that the target model and the rejection level are fitted on, at most; chosen by hash of their id.
MAX_LABELLED = 50_000
SMOOTHING = 1.0
#: Counts per bucket that the raw model lends the target model, so that a small target is not taken at its word.
PRIOR_COUNTS = 4.0
SEED = 29
#: Bins of one round of the search for the cut, and rows of a bin that are sorted on the driver at most.
CUT_BINS, CUT_ROWS = 4096, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbouring words, text after text, and how many each text has."""
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    total = int(counts.sum())
    hashes = np.fromiter((crc32(w) for ws in words for w in ws), dtype=np.uint64, count=total)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    single = (hashes + np.uint64(1)) * _MIX >> shift
    pair = np.empty(total, np.uint64)
    if total:
        pair[:-1] = ((hashes[:-1] << np.uint64(32) | hashes[1:]) ^ np.uint64(0xA5A5)) * _MIX >> shift
    last = np.zeros(total, bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    grams = np.stack([single, pair], 1).reshape(-1).astype(np.int64)
    keep = np.ones(2 * total, bool)
    keep[1::2] = ~last
    return grams[keep], np.where(counts > 0, 2 * counts - 1, 0)


def gram_counts(docs: DataFrame, target_ids: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all texts, and over the target's; summed within tasks first, then by bucket.

    ``docs`` has columns id and text. What reaches the driver is one row per bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(target_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                grams, sizes = gram_buckets(as_bytes(part.column("text")), buckets)
                raw += np.bincount(grams, minlength=buckets)
                ids = part.column("id").fill_null(np.iinfo(np.int64).min).to_numpy()
                chosen = np.isin(ids, shared.value)
                if chosen.any():
                    target += np.bincount(grams[np.repeat(chosen, sizes)], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    rows = docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target over raw probability by bucket; the raw model stands in where the target has few counts."""
    prior = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    mass = PRIOR_COUNTS * len(raw)
    p = (target + mass * prior) / (target.sum() + mass)
    return np.log(p) - np.log(prior)


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``(id, grams, log_weight)`` and any further columns of ``docs``: the sum of the ratios of a text's n-grams; zero for a
    text without words. The sum is that of the log ratio of two models of the whole text, so it is not divided by length."""
    more = [f for f in docs.schema.fields if f.name not in ("id", "text")]
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                grams, sizes = gram_buckets(as_bytes(part.column("text")), len(shared.value))
                sums = np.concatenate([[0.0], np.cumsum(shared.value[grams])])
                ends = np.cumsum(sizes)
                weights = np.round(sums[ends] - sums[ends - sizes], 6)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.array(weights), *(part.column(f.name) for f in more)], names=["id", "grams", "log_weight", *(f.name for f in more)])

    return docs.mapInArrow(run, "id long, grams long, log_weight double" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more))


def gumbel(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise that is a function of the id, so reruns draw the same sample."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce(id_col, F.lit(0)), F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def rejection_level(weights: np.ndarray, good: np.ndarray, least_recall: float = 0.99, slack: float = 0.01) -> float:
    """The lowest log weight that parts labelled texts within ``slack`` of the best (by the sum of both recalls)
    while it keeps most good ones: in doubt a text stays."""
    if not good.any():
        return -np.inf
    floor = np.quantile(weights[good], 1 - least_recall)
    if good.all():
        return float(floor)
    levels = np.unique(weights[weights <= floor])
    levels = np.append(levels, floor)
    good_below = np.searchsorted(np.sort(weights[good]), levels) / good.sum()
    bad_below = np.searchsorted(np.sort(weights[~good]), levels) / (~good).sum()
    gain = bad_below - good_below
    best = gain.max()
    return float(levels[np.flatnonzero(gain >= best - slack)[0]])


def top_k_cut(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of ``key``: histograms of an ever narrower range, then one small bin in order."""
    low, high, total = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= total or low is None:
        return -np.inf
    if k <= 0:
        return np.inf
    left = k  # rank of the cut within [low, high], from the top
    while low < high:
        width = (high - low) / CUT_BINS
        inside = rows.where(F.col(key).between(low, high))
        if width <= 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(CUT_BINS - 1))
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if left <= b.n:
                low, high, n = b.lo, b.hi, b.n
                break
            left -= b.n
        if n <= CUT_ROWS:
            return rows.where(F.col(key).between(low, high)).select(key).orderBy(F.desc(key)).limit(left).collect()[-1][0]
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, k: int | None = None, seed: int = SEED) -> DataFrame:
    """``(id, grams, log_weight, gumbel_key, selected)`` per row of ``docs``.

    The raw model counts the n-grams of every text; the target model those of rows labelled 1 in one half of
    ``max_labelled`` labelled ids. The other half, which the models have not seen, sets the rejection level. A text's log
    weight is the sum over its n-grams of the log ratio of the two models. The k rows with the largest log weight plus
    Gumbel noise are selected; by default k is the number of texts at or above the level that parts the labelled rows best
    while it keeps 99% of the good ones.

    Null and empty texts weigh zero. A label counts once per id (the larger of several), null labels do not count; of an
    id that stands on several rows the least weight sets the level; without any label all rows are selected. Rows tied
    with the k-th are all selected, so repeated rows share a fate; an empty table gives an empty result; other columns are
    not read. Texts are read whole, whatever their length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _resampled(rows, labels, id_col, label_col, max_labelled, k, seed)


def _resampled(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_labelled: int, k: int | None, seed: int) -> DataFrame:
    """``importance_resample`` on ``rows(id, text, ...)``; further columns are carried."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("good"))
    fits = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 0
    sample = {r.id: (r.good == 1, r.fits) for r in marks.withColumn("fits", fits).orderBy(F.xxhash64("id"), "id").limit(max_labelled).collect()}
    targets = np.array(sorted(i for i, (good, fitted) in sample.items() if good and fitted), dtype=np.int64)
    raw, target = gram_counts(rows.select("id", "text"), targets)
    scored = materialize(log_weights(rows, log_ratios(raw, target)), "weights")
    if k is None:
        wanted = scored.sparkSession.createDataFrame([(i,) for i, (_, fitted) in sample.items() if not fitted], "l_id long")
        seen = scored.join(F.broadcast(wanted), scored["id"] == wanted["l_id"], "left_semi").groupBy("id").agg(F.min("log_weight").alias("log_weight")).collect()  # at most max_labelled
        level = rejection_level(np.array([r.log_weight for r in seen]), np.array([sample[r.id][0] for r in seen], dtype=bool)) if seen else -np.inf
        k = scored.where(F.col("log_weight") >= F.lit(float(level))).count()
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("id"), seed))
    cut = top_k_cut(keyed, "gumbel_key", k)
    return keyed.withColumn("selected", F.col("gumbel_key") >= F.lit(float(cut)))


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, k: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` without the rows that the resampling rejects; columns unchanged.

    Rows go by id and text digest, so an id on several texts loses only those that are rejected. Null texts count as
    empty, a null id is a value like any other, repeated rows share a fate, an empty table stays empty.
    """
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"), text_digest(F.col(quoted(text_col))).alias("sha"))
    chosen = _resampled(rows, labels, id_col, label_col, max_labelled, k, seed)
    gone = materialize(chosen.where("NOT selected").select("id", "sha").distinct(), "gone")
    return without_rows(docs, gone, id_col, text_col)
