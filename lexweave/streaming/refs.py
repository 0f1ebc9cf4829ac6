"""Reference records that keep arriving: the same operators over a stream, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.schemas import schema


def read_refs(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines files of references as they arrive, with their time of arrival."""
    return spark.readStream.schema(schema("refs")).json(folder).withColumn("seen_at", F.current_timestamp())


def first_refs(refs: DataFrame, late: str = "1 day") -> DataFrame:
    """Each citation once within the time that late records are waited for."""
    keys = ["from_article_id", "to_law_id", "to_number"]
    return refs.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(keys)


def counts_by_law(refs: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Citations per cited law and window of arrival."""
    return refs.withWatermark("seen_at", late).groupBy(F.window("seen_at", window), "to_law_id").agg(F.count("*").alias("n"))


def merge_into(folder: str):
    """For ``foreachBatch``: append a batch's references to a Parquet table, once per batch however often it is retried."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return run
