"""Tags of chunks: offline rules, parsing of a model's answers, and the tag cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T

TAG_SCHEMA = "theme string, summary string, entities array<string>, hyde_question string, chunk_type string"
TAG_COLUMNS = ["theme", "summary", "entities", "hyde_question", "chunk_type"]


def fallback(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text_md5, tags..., tag_source): tags by rule, for chunks no model tagged."""
    section, text, title = (F.coalesce(c, F.lit("")) for c in ("section", "text", "paper_title"))
    return chunks.select(
        "chunk_id",
        F.md5(text).alias("text_md5"),
        section.alias("theme"),
        F.concat(F.substring(text, 1, 150), F.lit("...")).alias("summary"),
        F.slice(T.text_entities(text), 1, 8).alias("entities"),
        F.concat(F.lit("What does "), F.substring(title, 1, 40), F.lit(" report about "), section, F.lit("?")).alias("hyde_question"),
        T.chunk_type(section).alias("chunk_type"),
        F.lit("fallback").alias("tag_source"),
    )


def parse(answers: DataFrame) -> DataFrame:
    """(chunk_id, text_md5, tags..., tag_source) of a model's raw answers (chunk_id, text_md5,
    raw): fences and words around the JSON are passed over, missing fields get defaults."""
    t = T.lenient_json(F.col("raw"), TAG_SCHEMA)
    return answers.select("chunk_id", "text_md5", t.alias("t")).select(
        "chunk_id",
        "text_md5",
        F.coalesce("t.theme", F.lit("")).alias("theme"),
        F.coalesce("t.summary", F.lit("")).alias("summary"),
        F.coalesce("t.entities", F.array().cast("array<string>")).alias("entities"),
        F.coalesce("t.hyde_question", F.lit("")).alias("hyde_question"),
        F.coalesce("t.chunk_type", F.lit("other")).alias("chunk_type"),
        F.lit("model").alias("tag_source"),
    )


def split_cached(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): chunks whose id and text the cache knows, with its tags, and the rest."""
    keyed = chunks.drop(*[c for c in TAG_COLUMNS if c in chunks.columns]).withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))
    known = cache.dropDuplicates(["chunk_id", "text_md5"])
    return keyed.join(known, ["chunk_id", "text_md5"]), keyed.join(known.select("chunk_id", "text_md5"), ["chunk_id", "text_md5"], "left_anti")


def tag(chunks: DataFrame, cache: DataFrame, provider: Callable[[DataFrame], DataFrame] = fallback) -> DataFrame:
    """chunks with tags: from the cache where it has them, from the provider otherwise. A
    provider takes chunks and returns rows as :func:`fallback` does."""
    hits, misses = split_cached(chunks, cache)
    made = provider(misses)
    fresh = misses.join(made, ["chunk_id", "text_md5"])
    return hits.select(*fresh.columns).unionByName(fresh)
