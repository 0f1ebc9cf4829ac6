"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe, chat, divergence, exact, minhash, mixing, quality_rules, resampling, simhash, substrings, target_resampling, toxicity, warc
from lexweave.plans.session import ship, table

#: Rank file of the registered encoding query.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def multilingual_vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.load_vocabulary(public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicate_groups(table(ship(spark), sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), carry=False)
    return rows.select("doc_id", *[F.col(f"__mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


#: A conversation whose texts hold control strings, formatted beside those of the table.
CONTROL_STRINGS = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-7, 0, "user", CONTROL_STRINGS), (-7, 1, "assistant", CONTROL_STRINGS)]
    extra = spark.range(2).select(*[F.when(F.col("id") == 0, F.lit(a)).otherwise(F.lit(b)).cast(turns.schema[c].dataType).alias(c) for c, a, b in zip(turns.columns, *rows)])
    done = chat.format_conversations(turns.unionByName(extra))
    done = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.toxicity(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(ship(spark), sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.importance_resample(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumnRenamed("id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(ship(spark), sf_dir, "documents"), multilingual_vocabulary())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(table(ship(spark), sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = target_resampling.target_resample(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.withColumnRenamed("id", "doc_id")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_groups(table(ship(spark), sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(ship(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_bpe": op6_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_target_resampling": op11_target_resampling,
    "op12_minhash": op12_minhash,
    "op13_source_divergence": op13_source_divergence,
}
