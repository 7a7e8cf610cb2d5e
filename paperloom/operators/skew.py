"""Per-key results where a few keys hold most records (problem 7), and a skew-safe join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.columns import consistent_entities, key_form

#: A key is hot when it holds more than this share of the rows: at most 1/HOT_SHARE
#: keys are hot, whatever the data, so the table of hot keys has a proven bound.
HOT_SHARE = 0.001


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """The keys that hold more than ``share`` of df's rows; at most ``1/share`` rows.

    Counts are combined before the shuffle, so a hot key costs one row a task.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") > F.col("_total") * share).select(key)


def skew_safe_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` left-joined with ``right``, whose rows are unique by ``key``.

    Rows of hot keys meet their one right row by a broadcast of at most ``1/HOT_SHARE``
    rows and never shuffle; all others join by shuffle. Null keys match nothing.
    """
    hot = hot_keys(left, key)
    right_hot = right.join(F.broadcast(hot), key, "left_semi")
    cold = left.join(F.broadcast(hot), key, "left_anti")
    warm = left.join(F.broadcast(hot), key, "left_semi")
    columns = [*left.columns, *(c for c in right.columns if c != key)]
    return cold.join(right, key, "left").select(columns).unionByName(warm.join(F.broadcast(right_hot), key, "left").select(columns))


def eager_join_aggregate(tags: DataFrame, measures: DataFrame, on: str, keys: list[str], value: str, distinct_tags: bool = True) -> DataFrame:
    """Counts and sums of ``value`` by ``keys`` over ``tags`` joined with ``measures``.

    Eager aggregation: both inputs are pre-aggregated by the join key, so the join has
    one compact state a side for each key value and no key can make it grow: ``tags``
    becomes a map of (keys -> number of rows), ``measures`` (rows, non-null values, sum).
    A joined pair stands for ``tag rows x measure rows`` rows of the plain join, so
    counts multiply and sums scale. The roll-up by ``keys`` combines before its shuffle,
    so a key in most records costs one row a task.

    ``distinct_tags``: a repeated (on, keys) row counts once. Nulls of ``on`` join
    nothing; null values count as rows, not as values. Empty inputs give no rows.
    Returns keys, n, n_values, total, mean (null without values).
    """
    tag_state = (
        tags.where(F.col(on).isNotNull())
        .groupBy(on, *keys)
        .agg((F.lit(1) if distinct_tags else F.count(F.lit(1))).cast("long").alias("_m"))
    )
    measure_state = (
        measures.where(F.col(on).isNotNull())
        .groupBy(on)
        .agg(F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_values"), F.sum(F.col(value).cast("double")).alias("_sum"))
    )
    return (
        tag_state.join(measure_state, on)
        .groupBy(*keys)
        .agg(
            F.sum(F.col("_m") * F.col("_rows")).alias("n"),
            F.sum(F.col("_m") * F.col("_values")).alias("n_values"),
            F.sum(F.col("_m") * F.col("_sum")).alias("total"),
        )
        .withColumn("mean", F.when(F.col("n_values") > 0, F.col("total") / F.col("n_values")))
    )


def chunk_tags(chunks: DataFrame) -> DataFrame:
    """(chunk_key, field, key_value): each theme and entity of each chunk, repeats kept.

    Keys are trimmed, lower-cased and, entities, in the consistent form; null and blank
    ones are none.
    """
    plain = consistent_entities(chunks.select("chunk_key", "theme", "entities"))
    pair = lambda field, key: F.struct(F.lit(field).alias("field"), key.alias("key_value"))
    tags = F.concat(
        F.array(pair("theme", key_form(F.col("theme")))),
        F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: pair("entity", key_form(e))),
    )
    tags = F.array_distinct(F.filter(tags, lambda t: t["key_value"].isNotNull()))
    return plain.select("chunk_key", F.explode(tags).alias("t")).select("chunk_key", "t.field", "t.key_value")


def key_statistics(chunks: DataFrame) -> DataFrame:
    """Number of chunks and mean confidence of every theme and entity.

    A chunk_key counts once however often it was delivered (repeats have the same
    content); one with null confidence counts as a chunk, not in the mean. Rows with
    null chunk_key are dropped. An empty table gives no rows; other columns don't matter.
    """
    measures = chunks.groupBy("chunk_key").agg(F.max("confidence").alias("confidence"))
    stats = eager_join_aggregate(chunk_tags(chunks), measures, "chunk_key", ["field", "key_value"], "confidence")
    return stats.select("field", "key_value", F.col("n").alias("n_chunks"), F.col("mean").alias("mean_confidence"))


def frequent_keys(chunks: DataFrame, share: float = 0.04) -> DataFrame:
    """(field, key_value) of the keys in at least ``share`` of all distinct chunk_keys."""
    total = chunks.where(F.col("chunk_key").isNotNull()).select("chunk_key").distinct().agg(F.count(F.lit(1)).alias("_total"))
    stats = key_statistics(chunks).crossJoin(F.broadcast(total))
    return stats.where(F.col("n_chunks") >= F.col("_total") * share).select("field", "key_value")

