"""Incremental tagging: each micro-batch tags what the cache doesn't know yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.tagging import fallback, split_cached
from paperloom.sources.files import read_tag_cache


def tag_stream(chunks: DataFrame, cache_path: str, checkpoint: str, provider: Callable[[DataFrame], DataFrame] = fallback, every: str | None = None) -> StreamingQuery:
    """Append tags of new chunks to the cache. Keyed by chunk id and text, so a batch that
    runs again, or a chunk that comes late or twice, adds nothing new. ``every`` is the time
    between batches; without it the stream takes what is there and ends."""

    def write(batch: DataFrame, number: int) -> None:
        _, misses = split_cached(batch.dropDuplicates(["chunk_id", "text"]), read_tag_cache(batch.sparkSession, cache_path))
        provider(misses).write.mode("append").json(cache_path)

    query = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=every) if every else query.trigger(availableNow=True)).start()
