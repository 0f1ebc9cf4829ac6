"""From raw documents to token ids: five stages, each an operator applied to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import bpe, exact, mixing, resampling, simhash
from lexweave.llm.common import materialize, release
from lexweave.llm.queries import multilingual_vocabulary
from lexweave.plans.session import ship, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go.

    Null texts count as empty; a null id is a value like any other; repeated rows and ties at the cut share a fate; without
    labels nothing goes; texts are read whole; columns of any name stay as they are; an empty table stays empty.
    """
    return resampling.keep_selected(docs, table(ship(spark), sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, that of the smallest id.

    Null and empty texts are equal; a null id stays only where its group has no other; of rows equal in id and text one
    stays; texts of any length are compared by digests; columns of any name stay; an empty table stays empty.
    """
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with five-word shingle similarity 0.8 or more the document with the smallest id stays.

    Null and blank texts are one group; a null id stays only where its group has no other; rows equal in id and text share a
    fate; texts are read whole; columns of any name stay; an empty table stays empty.
    """
    ship(spark)
    return simhash.keep_one_per_group(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a row per epoch of a document, the one at the cut shortened.

    Texts that are null or without words are never taken; null sources are one source, the last; a null id is ordered as an
    empty one; repeated rows count one by one; columns of any name stay; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; digests of ids and bytes.

    A null text is empty; null ids and repeated rows stay; texts are read whole; an empty table gives an empty result.
    """
    ship(spark)
    return bpe.round_trip(docs, multilingual_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", token_ids),
]

#: Learnt models, fingerprints and byte-pair merges are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name)
        release(docs)  # what a stage has read goes when its result is written
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
