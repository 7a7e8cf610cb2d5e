"""Tokens used in the last 60 seconds: over a table, and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a block: a window's group is a key's block with 60 seconds before it, so
#: its size follows the rate of events, not the length of the table.
BLOCK_SECONDS = 3600


def trailing_sum(events: DataFrame, key: str, ts: str, value: str, seconds: int = 60) -> DataFrame:
    """events with ``trailing``, the sum of value over the key's events after ts - seconds,
    up to and with ts. Rows with null ts drop out."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    block = F.floor(micros / (BLOCK_SECONDS * 1_000_000)).cast("long")
    rows = events.where(F.col(ts).isNotNull()).withColumn("_at", micros).withColumn("_own", block)
    # each event also stands in the next block if that block's first events still see it
    near_end = F.floor((F.col("_at") + seconds * 1_000_000) / (BLOCK_SECONDS * 1_000_000)).cast("long")
    spread = rows.withColumn("_block", F.explode(F.array_distinct(F.array("_own", near_end))))
    w = Window.partitionBy(key, "_block").orderBy("_at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return spread.withColumn("trailing", F.sum(value).over(w)).where("_block = _own").drop("_at", "_own", "_block")


def waits(events: DataFrame, key: str, ts: str, value: str, limit: float, seconds: int = 60) -> DataFrame:
    """events with ``over``: whether the trailing sum is above the limit. One event above the
    whole limit could never be let through, so it fails at once instead of waiting."""
    rows = trailing_sum(events, key, ts, value, seconds)
    return rows.withColumn("over", F.col("trailing") > limit).withColumn("impossible", F.col(value) > limit)


def windowed_usage(stream: DataFrame, key: str, ts: str, value: str, late: str = "10 minutes", length: str = "60 seconds") -> DataFrame:
    """(window_start, key, n, total) of a stream: tumbling windows, events later than
    ``late`` behind the latest one dropped by the watermark."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), key)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def run_once(result: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run a stream over what is there and return the last state of each key. Micro-batches
    are written with their number, so a batch that is repeated changes nothing."""
    spark = result.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(path).drop("batch")
    rest = [c for c in written.columns if c not in (*keys, "_batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
