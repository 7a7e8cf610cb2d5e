"""Conversations: the last messages of each, without a group growing beyond them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_messages(messages: DataFrame, most: int = 6) -> DataFrame:
    """messages (conv_id, turn, role, text): each conversation's last ones, system
    messages left out; Spark limits the groups before the shuffle."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.where("role <> 'system'").withColumn("back", F.row_number().over(w)).where(F.col("back") <= most).drop("back")


def context_prompt(results: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """(query, context): retrieved texts with their headers, in order. results are (query,
    rank, paper_title, section, norm_score, text), the few kept ones of each query."""
    line = F.format_string("[%d] %s - %s (%.2f)\n%s", "rank", "paper_title", "section", "norm_score", "text")
    rows = results.select("query", F.struct("rank", line.alias("line")).alias("r")).groupBy("query").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return rows.select("query", F.array_join(F.transform("rows", lambda r: r["line"]), separator).alias("context"))
