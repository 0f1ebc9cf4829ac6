"""Schemas of the citation graph at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PROVISION = "article_id STRING, number STRING, parent_number STRING, title STRING, text STRING"
OPERATION = "op STRING, law_id STRING, number STRING, article_id STRING, old_text STRING, new_text STRING, raw_text STRING, uses_old_name BOOLEAN, target_missing BOOLEAN"
#: Record types by table, as Spark DDL. ``laws`` holds its provisions until it is flattened.
SCHEMAS = {
    "laws": f"law_id STRING, name STRING, former_names ARRAY<STRING>, short_names ARRAY<STRING>, adopted_date STRING, source_url STRING, text_available BOOLEAN, articles ARRAY<STRUCT<{PROVISION}>>",
    "refs": "from_article_id STRING, to_law_id STRING, to_number STRING, to_article_id STRING, raw_text STRING, matched_name STRING, uses_old_name BOOLEAN, target_missing BOOLEAN, method STRING, confidence DOUBLE, current_number STRING",
    "similar": "a_article_id STRING, b_article_id STRING, score DOUBLE, model STRING",
    "relations": "a_article_id STRING, b_article_id STRING, kind STRING, confidence DOUBLE, explanation STRING, model STRING",
    "amendments": "article_id STRING, reason STRING, suggested_text STRING, based_on_source_ids ARRAY<STRING>, model STRING, confidence DOUBLE",
    "drafts": f"draft_id STRING, lawforum_id STRING, title STRING, target_law_id STRING, new_name STRING, amended_article_ids ARRAY<STRING>, cosubmitted_law_ids ARRAY<STRING>, source_url STRING, operations ARRAY<STRUCT<{OPERATION}>>, cosubmitted_titles ARRAY<STRING>",
    "intl_sources": "source_id STRING, kind STRING, country_or_org STRING, title STRING, url STRING, summary STRING, provision STRING",
    "intl_links": "article_id STRING, source_id STRING, relevance DOUBLE, explanation STRING, model STRING",
    "law_names": "law_id STRING, current_name STRING, former_names ARRAY<STRING>, short_names ARRAY<STRING>, aliases ARRAY<STRING>, source_url STRING",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))
