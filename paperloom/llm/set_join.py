"""All similar pairs between set-valued records (problem 5).

Minwise signatures of BANDS bands of ROWS values; sets that share any band's bucket are
candidates, those whose sizes or parity bitmaps rule the similarity out are dropped in
the bucket's own task, and the rest are deduplicated and compared exactly. Buckets are
counted first, and a hot one is cut into slices, each pair of which is a task. A pair at the
least similarity, 0.6, shares a bucket with probability 1 - (1 - 0.6**ROWS)**BANDS, that
is 0.99976; equal sets, and nearly all pairs above it, surely. Equal sets are one set
throughout, however many records have it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.columns import consistent_entities, key_form
from paperloom.llm import _vec as V
from paperloom.llm.near_duplicates import BLOCK_POSTINGS, BLOCK_SCHEMA, COUNTER_SLICES, DENOMINATOR, HOT_BUCKET, NUMERATOR, PAIR_SCHEMA, _bitmaps, _bucket, block_product, buckets_for, log_counts, pack_blocks, slices_for
from paperloom.operators.counters import SCHEMA, packed
from paperloom.session import materialize

ROWS, BANDS = 4, 60
LEAST = 3
_SEEDS = V.mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_buckets(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket hashes, (sets, BANDS), of the sets values[offsets[i]:offsets[i+1]], none empty."""
    n = len(offsets) - 1
    buckets = np.empty((n, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            h = np.full(n, _SEEDS[band], np.uint64)
            for row in range(ROWS):
                least = np.minimum.reduceat(V.mix(values ^ _SEEDS[band * ROWS + row]), offsets[:-1])
                h = V.mix(h * np.uint64(0xD6E8FEB86659FD93) + least)
            buckets[:, band] = h
    return buckets


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, values and offsets of a batch (sig, hashes)."""
    column = batch.column(1)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    return batch.column(0).to_numpy(zero_copy_only=False), values, offsets - offsets[0]


def _counted(sets: DataFrame, buckets: int) -> DataFrame:
    """(part, task, blob): each task's counts of the buckets of its sets (sig, hashes)."""

    def run(batches):
        counts = np.zeros(buckets, np.uint32)
        for batch in batches:
            if batch.num_rows:
                _, values, offsets = _hashes(batch)
                counts += np.bincount(_bucket(band_buckets(values, offsets).reshape(-1), buckets), minlength=buckets).astype(np.uint32)
        yield packed(counts, COUNTER_SLICES)

    return sets.mapInArrow(run, SCHEMA)


def _postings(sets: DataFrame, blocks: int, order) -> DataFrame:
    """(sig, hashes) -> the blocks' shares of the set by bucket incidence, packed."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs, values, offsets = _hashes(batch)
            n = np.diff(offsets)
            maps = _bitmaps(np.repeat(np.arange(len(n)), n), values, len(n))
            bucket = band_buckets(values, offsets).reshape(-1)
            block = (V.mix(bucket) % np.uint64(blocks)).astype(np.int64)
            yield pack_blocks(np.repeat(np.arange(len(n)), BANDS), bucket, block, slices_for(order.value[_bucket(bucket, len(order.value))], HOT_BUCKET), n, maps, sigs)

    return sets.mapInArrow(run, BLOCK_SCHEMA)


def tagged_sets(chunks: DataFrame) -> DataFrame:
    """(key, title, values, sig): each chunk's set of entities and its title in one form.

    Chunks with null or blank title or fewer than LEAST distinct entities are left out.
    """
    plain = consistent_entities(chunks.select(F.col("chunk_key").alias("key"), "entities", "paper_title").where("key IS NOT NULL AND paper_title IS NOT NULL"))
    values = F.array_sort(F.array_distinct(F.filter(F.transform("entities", key_form), lambda e: e.isNotNull())))
    title = key_form(F.regexp_replace("paper_title", r"[\s\p{Z}]+", " "))
    return (
        plain.select("key", title.alias("title"), values.alias("values"))
        .where((F.size("values") >= LEAST) & F.col("title").isNotNull())
        .withColumn("sig", F.xxhash64("values"))
        .distinct()
    )


def similar_set_pairs(members: DataFrame) -> DataFrame:
    """(a_sig, b_sig, overlap, total): all pairs of different sets of members (sig, values)
    of similarity 0.6 or more, each compared exactly."""
    sets = members.groupBy("sig").agg(F.first("values").alias("values"))
    n = sets.count()
    blocks = max(1, math.ceil(n * BANDS / BLOCK_POSTINGS))
    hashed = sets.select("sig", F.transform("values", lambda v: F.xxhash64(v)).alias("hashes"))
    buckets = buckets_for(n)
    order = members.sparkSession.sparkContext.broadcast(log_counts(materialize(_counted(hashed, buckets), "p5-counts"), buckets))
    candidates = _postings(hashed, blocks, order).groupBy("block").applyInArrow(block_product, PAIR_SCHEMA).select("a_sig", "b_sig").distinct()
    candidates = materialize(candidates, "p5-candidates")
    side = lambda s: sets.select(F.col("sig").alias(f"{s}_sig"), F.col("values").alias(f"{s}_values"))
    return (
        candidates.join(side("a"), "a_sig")
        .join(side("b"), "b_sig")
        .select("a_sig", "b_sig", F.size(F.array_intersect("a_values", "b_values")).alias("overlap"), (F.size("a_values") + F.size("b_values")).alias("total"))
        .where((DENOMINATOR + NUMERATOR) * F.col("overlap") >= NUMERATOR * F.col("total"))
    )


def similar_tag_pairs(chunks: DataFrame) -> DataFrame:
    """(a_key, b_key): pairs of chunks, a_key < b_key, with at least three distinct
    entities each, entity sets of similarity 0.6 or more, and different titles.

    Entities are compared in the consistent form, without blanks around and ignoring
    case; titles ignoring case and repeated or surrounding blanks. Null and blank
    entities drop out; a repeated row counts once; an empty table gives no rows.
    """
    members = materialize(tagged_sets(chunks), "p5-members")
    pairs = similar_set_pairs(members)
    slim = members.select("key", "title", "sig")
    side = lambda s: slim.select(F.col("key").alias(s), F.col("title").alias(f"{s}_title"), F.col("sig").alias(f"{s}_sig"))
    across = pairs.join(side("a"), "a_sig").join(side("b"), "b_sig").where("a_title <> b_title").select("a", "b")
    a, b = side("a"), side("b")
    same = a.join(b, a.a_sig == b.b_sig).where("a < b AND a_title <> b_title").select("a", "b")
    return across.union(same).select(F.least("a", "b").alias("a_key"), F.greatest("a", "b").alias("b_key"))


def similar_tag_classes(chunks: DataFrame) -> DataFrame:
    """(chunk_key, class_key, links): the compact form of :func:`similar_tag_pairs`. Chunks of
    one title with the same entities are a class, named by its least key; links is the
    number of classes of other titles whose entities are similar or the same. Chunks
    without a class, as there, give no row."""
    members = materialize(tagged_sets(chunks), "p5-members")
    pairs = materialize(similar_set_pairs(members).select("a_sig", "b_sig"), "p5-pairs")
    classes = members.groupBy("sig", "title").agg(F.min("key").alias("class_key"))
    titles = classes.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.col("a_sig").alias("sig"), F.col("b_sig").alias("other")).union(pairs.select("b_sig", "a_sig"))
    around = both.join(titles.select(F.col("sig").alias("other"), "n"), "other").groupBy("sig").agg(F.sum("n").alias("around"))
    # classes of similar sets that have the same title don't count
    own = both.join(classes.select(F.col("sig").alias("other"), "title"), "other").groupBy("sig", "title").agg(F.count(F.lit(1)).alias("own"))
    linked = classes.join(titles, "sig").join(around, "sig", "left").join(own, ["sig", "title"], "left")
    linked = linked.select("sig", "title", "class_key", (F.col("n") - 1 + F.coalesce("around", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("links"))
    return members.select("key", "sig", "title").join(linked, ["sig", "title"]).select(F.col("key").alias("chunk_key"), "class_key", "links")
