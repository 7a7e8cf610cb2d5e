"""JSON files: the tag cache, golden questions, and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CACHE_SCHEMA = "chunk_id string, text_md5 string, theme string, summary string, entities array<string>, hyde_question string, chunk_type string, tag_source string"
GOLDEN_SCHEMA = "question string, relevant_chunk_ids array<string>, relevant_papers array<string>, answer string, difficulty string"


def read_tag_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached tags; empty where there is no cache, without records that don't parse."""
    try:
        return spark.read.schema(CACHE_SCHEMA).option("mode", "PERMISSIVE").json(path).where("chunk_id IS NOT NULL")
    except AnalysisException:
        return spark.createDataFrame([], CACHE_SCHEMA)


def write_tag_cache(tagged: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tags of the chunks that have a theme."""
    rows = tagged.where(F.coalesce("theme", F.lit("")) != "")
    if "text_md5" not in rows.columns:
        rows = rows.withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))
    if "tag_source" not in rows.columns:
        rows = rows.withColumn("tag_source", F.lit("model"))
    rows.select("chunk_id", "text_md5", "theme", "summary", "entities", "hyde_question", "chunk_type", "tag_source").write.mode(mode).json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN_SCHEMA).option("multiLine", True).json(path)


def write_golden(questions: DataFrame, path: str) -> None:
    questions.select("question", "relevant_chunk_ids", "relevant_papers", "answer", "difficulty").write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file; written with and without an ablation."""
    report.coalesce(1).write.mode("overwrite").json(path)


def metric_lines(report: DataFrame) -> DataFrame:
    """(line): metrics (metric, value) as text for a console."""
    return report.select(F.concat(F.rpad("metric", 32, "."), F.lit(" "), F.format_number("value", 4)).alias("line"))


def read_summary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
