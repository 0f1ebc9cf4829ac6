"""Grouping operators of the engine: keep-first, latest version, best per key, top words, histograms, closures of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_version(rows: DataFrame, keys: list[str], repealed: Column, order: list[Column]) -> DataFrame:
    """The last row of each key, unless it is repealed and an earlier one is not."""
    return first_wins(rows, keys, [F.coalesce(repealed, F.lit(False)).cast("int"), *order])


def best_per_key(rows: DataFrame, keys: list[str], score: Column, tie: list[Column]) -> DataFrame:
    return first_wins(rows, keys, [score.desc(), *tie])


def top_n(rows: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """``(keys, value, n, rank)``: the n most frequent values of each key; ties by value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))).where(F.col("rank") <= n)


def collected(rows: DataFrame, keys: list[str], value: str, order: list[str], limit: int | None = None) -> DataFrame:
    """``(keys, n, values)``: the values of each key in a stated order, the first ``limit`` of them."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v")))).alias("s"))
    values = F.transform("s", lambda x: x["__v"])
    return found.select(*keys, "n", (F.slice(values, 1, limit) if limit else values).alias("values"))


def histogram(parts: dict[str, DataFrame]) -> DataFrame:
    """``(label, n)``: rows per named table."""
    out = None
    for label, frame in parts.items():
        one = frame.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def having_all(rows: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Keys that have every wanted value: one aggregate instead of a join per value."""
    return rows.where(F.col(value).isin(*wanted)).groupBy(key).agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(wanted)).select(key)


def resolve_names(names: DataFrame, registry: DataFrame, name_key: Column, registry_key: Column) -> DataFrame:
    """``names`` with the law of each: a current name beats an alias, else the last registration wins."""
    order = Window.partitionBy("r_key").orderBy((F.col("kind") == "current").desc(), F.desc("position"))
    best = registry.withColumn("r_key", registry_key).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return names.withColumn("n_key", name_key).join(best, F.col("n_key") == F.col("r_key"), "left").drop("n_key", "r_key")
