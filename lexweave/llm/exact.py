"""Exact duplicates by a tree of merges over sorted runs of digests; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.chat import let
from lexweave.llm.common import materialize, quoted, release, text_digest, without_rows

#: Runs that one merge takes, as a power of two, and keys of a range.
FAN_IN_BITS, RUN_KEYS = 3, 8192
KEY = ("sha", "bytes", "check")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, sha, bytes, check)``: SHA-256, length and a second hash of the UTF-8 text; null counts as empty.

    ``row`` numbers the rows as they are written out, so it is fixed from there on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("check"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def _range_bits(rows: int) -> int:
    """Bits of a digest that name its range, so that a whole merged run of a range has about ``RUN_KEYS`` keys."""
    return min(24, max(0, (rows // RUN_KEYS).bit_length()))


def merge_runs(rows: DataFrame, keep: str = "smallest", fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """One row per text: key, the row that stays, and the size of the group.

    A run is what one partition holds of one range of digests, sorted once by digest and combined in itself: an array with
    one entry per text. In each round the runs whose numbers agree but for the lowest ``fan_in_bits`` bits are exchanged
    and merged; sorting their concatenation is a merge, for the sort takes up the sorted runs it finds. Entries agree only
    if SHA-256, length and second hash do, and equal neighbours become one with the smallest (or largest) id, the first row
    between equal ids. A group of copies enters a round with one entry per run, so no task ever sees the group; digests are
    uniform, so ranges are even whatever the texts.
    """
    best, put = (F.min, F.struct(F.col("id").isNull().alias("none"), "id", "row")) if keep == "smallest" else (F.max, F.struct(F.col("id").isNotNull().alias("none"), "id", (-F.col("row")).alias("row")))
    bits = _range_bits(rows.count())
    leading = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
    entries = rows.select(F.shiftright("row", 33).alias("run"), F.shiftright(leading, 32 - bits).alias("range"), *KEY, put.alias("best"), F.lit(1).cast("long").alias("size"))
    level = entries.groupBy("run", "range", *KEY).agg(best("best").alias("best"), F.sum("size").alias("size"))
    level = level.groupBy("run", "range").agg(F.sort_array(F.collect_list(F.struct(*KEY, "best", "size"))).alias("sorted"))
    left = int(rows.agg(F.max(F.shiftright("row", 33))).first()[0] or 0).bit_length()
    while left > 0:
        left -= fan_in_bits
        met = level.groupBy(F.shiftright("run", fan_in_bits).alias("run"), "range").agg(F.sort_array(F.flatten(F.collect_list("sorted"))).alias("sorted"))
        level = met.select("run", "range", _combined(F.col("sorted"), keep).alias("sorted"))
    return level.select(F.inline("sorted")).select(*KEY, F.col("best.id").alias("keep_id"), F.abs("best.row").alias("keep_row"), F.col("size").alias("group_size"))


def _combined(run: Column, keep: str) -> Column:
    """A sorted run with neighbours of one key made one; of equal keys the entry that stays is the first, or the last."""

    def key(e: Column) -> Column:
        return F.struct(*[e[c] for c in KEY])

    def join(r: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (key(F.get(r, i)) != key(F.get(r, i - 1))))

        def one(s: Column):
            def entry(i: Column, k: Column) -> Column:
                end = F.coalesce(F.get(s, k + 1), F.size(r))
                stays = F.get(r, i if keep == "smallest" else end - 1)
                total = F.aggregate(F.slice(r, i + 1, end - i), F.lit(0).cast("long"), lambda a, e: a + e["size"])
                return F.when(end - i == 1, F.get(r, i)).otherwise(stays.withField("size", total))

            return F.transform(s, entry)

        return let(starts, one)

    return let(run, join)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``(id, keep_id, group_size, kept, sha)`` per row of ``docs``, dropped rows too.

    Null and empty texts are one group. Of rows that repeat both id and text one is kept. A null id never stays
    where the group has another. An empty table gives an empty result; other columns are not read. Texts of any length
    are read whole; what is exchanged are digests.
    """
    rows = digests(docs, id_col, text_col)
    groups = materialize(merge_runs(rows, keep), "groups").select(*[F.col(c).alias(f"g_{c}") for c in KEY], "keep_id", "keep_row", "group_size")
    on = [rows[c] == groups[f"g_{c}"] for c in KEY]
    return rows.join(groups, on).select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("sha"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns unchanged.

    Rows are taken out by id and text digest. Where an id stands on several rows with one text, a second pass over these
    few rows keeps one of them, that of least hash over all columns, so reruns agree; copies are combined before they are
    exchanged. Null texts count as empty; a null id stays only where its group has no other; an empty table stays empty.
    """
    marked = materialize(exact_duplicates(docs, id_col, text_col, keep), "marked")
    fates = marked.groupBy("id", F.unhex("sha").alias("sha")).agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    fates = materialize(fates.where("NOT stays OR rows > 1"), "fates")
    release(marked)
    out = without_rows(docs, fates, id_col, text_col)
    again = fates.where("stays").select("id", "sha")
    if again.isEmpty():
        return out
    own = [docs[quoted(c)] for c in docs.columns]
    rows = docs.select(docs[quoted(id_col)].cast("long").alias("row_id"), text_digest(docs[quoted(text_col)]).alias("row_sha"), F.struct(*own).alias("row"), F.xxhash64(*own).alias("hash"))
    repeated = rows.join(again, rows["row_id"].eqNullSafe(again["id"]) & (rows["row_sha"] == again["sha"])).groupBy("id", "sha").agg(F.min_by("row", "hash").alias("row"))
    return out.unionByName(repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
