"""Near-duplicate records with small edits (problem 3).

Exact join of all pairs of texts whose sets of word shingles have a Jaccard similarity
of at least 0.6, as a blocked sparse matrix product of the document by shingle incidence.

Each document's set is cut by shingle hash into CLASSES parts. For two similar sets at
least one pair of parts is as similar as the whole (the mediant of the parts' ratios), so
the product runs on parts, and each part needs only its prefix: of n shingles in a fixed
global order, the first ``n - ceil(0.6 n) + 1``, one of which a similar part must share.
The order puts rare shingles first, by counts of shingle hashes over the whole corpus.

The product is computed in blocks of shingles. A block discards pairs of parts that their
sizes rule out, by ratio and by a parity bitmap (its Hamming distance never exceeds the
symmetric difference), and counts the shingles that the others share. These overlap
counts are summed over the blocks by pair and class. What two parts share at most is
their count and the rest behind the prefix that ends first, so with sizes n and m a class adds
at most ``8 min(n, m, count + rest) - 3 (n + m)`` to the pair's balance; a class without
a count adds nothing. A pair whose balance is below zero can't be similar and is
discarded. The few left are compared exactly. Nothing is approximate, nothing capped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import _vec as V
from paperloom.llm.normalize import consistent_texts
from paperloom.operators.counters import packed, tree_sum
from paperloom.session import materialize

#: similarity 0.6 = 3/5: |a & b| >= 3/8 (|a| + |b|), and |a ^ b| <= 1/4 (|a| + |b|)
NUMERATOR, DENOMINATOR = 3, 5
SHINGLE = 3
CLASSES = 4
#: Postings in a block of the product: what one task holds, about 100 MB with its pairs.
BLOCK_POSTINGS = 2_000_000
#: A shingle bucket with more occurrences than this is spread over several tasks.
HOT_BUCKET = 400_000
COUNTER_SLICES = 16
PAIR_STEP = 1_000_000
#: Up to so many keys, 8 bytes each, are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def _normal(texts: list[str | None]) -> list[str]:
    return ["" if t is None else t.lower() for t in consistent_texts(texts)]


def _signatures(doc: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """A hash of each document's shingle set."""
    sig = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sig, doc, V.mix(gram ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return V.mix(sig).view(np.int64)


def buckets_for(rows: int) -> int:
    """Counters of the shingle order: two for each row, between 2^18 and 2^25; as one
    byte each they are broadcast, so at most 32 MB at any size of the data."""
    return 1 << min(25, max(18, (2 * rows).bit_length() - 1))


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return (gram >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def _profile(df: DataFrame, buckets: int) -> DataFrame:
    """One pass over the texts: each row's set signature and size, and each task's counts."""

    def run(batches):
        counts = np.zeros(buckets, np.uint32)
        names = ["key", "sig", "n", "part", "task", "blob"]
        for batch in batches:
            keys, texts = (batch.column(i).to_pylist() for i in range(2))
            doc, gram = V.shingles(_normal(texts), SHINGLE)
            if not len(doc):
                continue
            counts += np.bincount(_bucket(gram, buckets), minlength=buckets).astype(np.uint32)
            sizes = np.bincount(doc, minlength=len(keys))
            have = np.flatnonzero(sizes)
            sigs = _signatures(doc, gram, len(keys))[have]
            none = [pa.nulls(len(have), t) for t in (pa.int32(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(keys, np.int64)[have]), pa.array(sigs), pa.array(sizes[have].astype(np.int32)), *none], names)
        rows = packed(counts, COUNTER_SLICES)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(rows.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int32())), *rows.columns], names)

    return df.mapInArrow(run, "key long, sig long, n int, part int, task long, blob binary")


def log_counts(counted: DataFrame, buckets: int) -> np.ndarray:
    """The summed counters of counted (part, task, blob) on a log scale, one byte each."""
    tasks = (counted.agg(F.max("task")).first()[0] or 0) + 1
    total = tree_sum(counted, tasks, buckets, COUNTER_SLICES)
    return np.minimum(255, np.round(8 * np.log2(1 + total.astype(np.float64)))).astype(np.uint8)


def slices_for(logs: np.ndarray, hot: int) -> np.ndarray:
    """Into how many slices a bucket of so many occurrences is cut."""
    return np.clip(np.ceil((np.exp2(logs.astype(float) / 8) - 1) / hot), 1, 65535).astype(np.int64)


def _bitmaps(doc_part: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """128-bit parity bitmaps of the parts' shingles: shape (n, 2)."""
    maps = np.zeros((n, 2), np.uint64)
    bit = V.mix(gram ^ np.uint64(0x0123456789ABCDEF))
    word = ((bit >> np.uint64(6)) & np.uint64(1)).astype(np.int64)
    np.bitwise_xor.at(maps.reshape(-1), doc_part * 2 + word, np.uint64(1) << (bit & np.uint64(63)))
    return maps


def _prefix_postings(texts: list[str], order: np.ndarray, blocks: int) -> tuple | None:
    """The prefixes of the parts of one batch of texts, equal sets once."""
    doc, gram = V.shingles(texts, SHINGLE)
    if not len(doc):
        return None
    sigs = _signatures(doc, gram, len(texts))
    _, first = np.unique(sigs, return_index=True)
    keep = np.zeros(len(texts), bool)
    keep[first] = True
    inside = keep[doc]
    doc, gram = doc[inside], gram[inside]
    part = doc * CLASSES + (gram & np.uint64(CLASSES - 1)).astype(np.int64)
    n = np.bincount(part, minlength=len(texts) * CLASSES)
    maps = _bitmaps(part, gram, len(n))
    rank = order[_bucket(gram, len(order))]
    at = np.lexsort((gram, rank, part))
    part, gram, rank = part[at], gram[at], rank[at]
    place = np.arange(len(part)) - np.searchsorted(part, np.arange(len(n)))[part]
    in_prefix = place < n[part] - (n[part] * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR + 1
    part, gram, rank = part[in_prefix], gram[in_prefix], rank[in_prefix]
    block = (V.mix(gram) % np.uint64(max(1, blocks // CLASSES))).astype(np.int64) * CLASSES + (gram & np.uint64(CLASSES - 1)).astype(np.int64)
    return part, gram, rank, block, n, maps, sigs


def pack_blocks(owner: np.ndarray, gram: np.ndarray, block: np.ndarray, slices: np.ndarray, n: np.ndarray, maps: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch | None:
    """A batch's postings as rows of the blocks' shares of the incidence, packed.

    A hot bucket's occurrences are cut into slices by their set's hash. They go to the
    tasks of all pairs of slices their own is in, and a pair of sets counts in the task
    of its two slices alone."""
    mine = (V.mix(sigs.view(np.uint64)[owner]) % slices.astype(np.uint64)).astype(np.int64)
    idx = np.repeat(np.arange(len(owner)), slices)
    other = np.arange(len(idx)) - np.repeat(np.cumsum(slices) - slices, slices)
    lo, hi = np.minimum(mine[idx], other), np.maximum(mine[idx], other)
    key = (block[idx] << 32) | (lo << 16) | hi
    at = np.lexsort((owner[idx], key))
    idx, key = idx[at], key[at]
    edges = np.flatnonzero(np.diff(key, prepend=-1))
    out: list[list] = [[] for _ in range(7)]
    for a, b in zip(edges, [*edges[1:], len(key)]):
        rows = idx[a:b]
        own, local = np.unique(owner[rows], return_inverse=True)
        sliced = mine[rows].astype("<u2").tobytes() if int(key[a]) & 0xFFFFFFFF or slices[rows].max() > 1 else b""
        values = (int(key[a]), sigs[own].tobytes(), n[own].astype("<u4").tobytes(), maps[own].tobytes(), gram[rows].tobytes(), local.astype("<u2" if len(own) < 65536 else "<u4").tobytes(), sliced)
        for column, value in zip(out, values):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], BLOCK_COLUMNS)


BLOCK_COLUMNS = ["block", "sigs", "sizes", "maps", "grams", "local", "mine"]
BLOCK_SCHEMA = "block long, sigs binary, sizes binary, maps binary, grams binary, local binary, mine binary"
PAIR_SCHEMA = "a_sig long, b_sig long, class int, common int, a_n int, b_n int"


def _postings(df: DataFrame, order, blocks: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = _prefix_postings(_normal(batch.column(1).to_pylist()), order.value, blocks)
            if found is not None:
                part, gram, rank, block, n, maps, sigs = found
                parts, owner = np.unique(part, return_inverse=True)
                yield pack_blocks(owner, gram, block, slices_for(rank, HOT_BUCKET), n[parts], maps[parts], sigs[parts // CLASSES])

    return df.mapInArrow(run, BLOCK_SCHEMA)


def _unique_sums(code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    at = np.flatnonzero(np.diff(code[order], prepend=-1))
    return code[order][at], np.add.reduceat(counts[order], at) if len(at) else counts


def block_product(table: pa.Table) -> pa.Table:
    """(a_sig, b_sig, class, common, a_n, b_n): the pairs of one block that their sizes
    allow, and how many of the block's shingles they share."""
    sigs, sizes, maps, grams, docs, mine = [], [], [], [], [], []
    base, sliced = 0, False
    key = table.column("block")[0].as_py()
    for r in table.select(BLOCK_COLUMNS[1:]).to_pylist():
        s, g = np.frombuffer(r["sigs"], np.int64), np.frombuffer(r["grams"], np.uint64)
        local = np.frombuffer(r["local"], "<u2" if len(r["local"]) == 2 * len(g) else "<u4").astype(np.int64)
        sigs.append(s), sizes.append(np.frombuffer(r["sizes"], "<u4")), maps.append(np.frombuffer(r["maps"], np.uint64).reshape(-1, 2))
        grams.append(g), docs.append(local + base)
        mine.append(np.frombuffer(r["mine"], "<u2") if r["mine"] else np.zeros(len(g), np.uint16))
        sliced |= bool(r["mine"])
        base += len(s)
    sig, first, inverse = np.unique(np.concatenate(sigs), return_index=True, return_inverse=True)
    size, bits = np.concatenate(sizes).astype(np.int64)[first], np.concatenate(maps)[first]
    gram, doc, mine = np.concatenate(grams), inverse[np.concatenate(docs)], np.concatenate(mine)
    at = np.lexsort((doc, gram))
    gram, doc, mine = gram[at], doc[at], mine[at]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc, mine = gram[new], doc[new], mine[new]
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    left = np.repeat(np.concatenate([starts[1:], [len(gram)]]), np.diff(np.concatenate([starts, [len(gram)]]))) - np.arange(len(gram)) - 1
    lo, hi = (key >> 16) & 0xFFFF, key & 0xFFFF
    code, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    fresh: list[np.ndarray] = []
    alive, offset = np.flatnonzero(left > 0), 1
    while len(alive):
        for a in range(0, len(alive), PAIR_STEP):
            i, j = alive[a : a + PAIR_STEP], alive[a : a + PAIR_STEP] + offset
            if sliced:
                ours = (np.minimum(mine[i], mine[j]) == lo) & (np.maximum(mine[i], mine[j]) == hi)
                i, j = i[ours], j[ours]
            i, j = doc[i], doc[j]
            total = size[i] + size[j]
            apart = np.bitwise_count(bits[i, 0] ^ bits[j, 0]).astype(np.int64) + np.bitwise_count(bits[i, 1] ^ bits[j, 1])
            # |a ^ b| <= (5-3)/(5+3) of the sizes' sum, and the size ratio
            ok = (apart * (DENOMINATOR + NUMERATOR) <= total * (DENOMINATOR - NUMERATOR)) & (np.minimum(size[i], size[j]) * DENOMINATOR >= np.maximum(size[i], size[j]) * NUMERATOR)
            if ok.any():
                fresh.append(i[ok] * len(sig) + j[ok])
        if sum(map(len, fresh)) > 4 * PAIR_STEP:
            flat = np.concatenate(fresh)
            code, counts = _unique_sums(np.concatenate([code, flat]), np.concatenate([counts, np.ones(len(flat), np.int64)]))
            fresh = []
        offset += 1
        alive = alive[left[alive] >= offset]
    if fresh:
        flat = np.concatenate(fresh)
        code, counts = _unique_sums(np.concatenate([code, flat]), np.concatenate([counts, np.ones(len(flat), np.int64)]))
    i, j = code // len(sig), code % len(sig)  # sig is sorted, so a_sig < b_sig
    n = lambda x: pa.array(size[x].astype(np.int32))
    return pa.table({"a_sig": pa.array(sig[i]), "b_sig": pa.array(sig[j]), "class": pa.array(np.full(len(code), (key >> 32) % CLASSES, np.int32)), "common": pa.array(counts.astype(np.int32)), "a_n": n(i), "b_n": n(j)})


def accumulated(products: DataFrame) -> DataFrame:
    """(a_sig, b_sig): the pairs whose overlap counts, summed over all blocks, leave their
    balance at zero or more."""
    parts = products.groupBy("a_sig", "b_sig", "class").agg(F.sum("common").alias("common"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
    rest = F.ceil(F.greatest("a_n", "b_n") * NUMERATOR / DENOMINATOR) - 1
    most = F.least(F.col("a_n"), F.col("b_n"), F.col("common") + rest)
    balance = (DENOMINATOR + NUMERATOR) * most - NUMERATOR * (F.col("a_n") + F.col("b_n"))
    return parts.groupBy("a_sig", "b_sig").agg(F.sum(balance).alias("balance")).where("balance >= 0").select("a_sig", "b_sig")


def _gram_sets(df: DataFrame) -> DataFrame:
    """(sig, grams): the sets of the given rows."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            doc, gram = V.shingles(_normal(texts), SHINGLE)
            if len(doc):
                have = np.unique(doc)
                offsets = np.concatenate([np.searchsorted(doc, have), [len(doc)]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_signatures(doc, gram, len(texts))[have]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(gram.view(np.int64)))], ["sig", "grams"])

    return df.mapInArrow(run, "sig long, grams array<long>")


def similar_sets(records: DataFrame, key: str = "chunk_key", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members (key, sig), pairs (a_sig, b_sig, overlap, total)): the rows' shingle sets
    and all pairs of different sets of similarity 0.6 or more, ``total`` the sizes' sum.

    Null texts and texts of fewer than three words have no set and are in neither. A
    repeated row counts once. An empty table gives empty results.
    """
    spark = records.sparkSession
    rows = records.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    buckets = buckets_for(records.count())
    profile = materialize(_profile(rows, buckets), "p3-profile")
    members = profile.where("key IS NOT NULL").select("key", "sig", "n").distinct()
    order = spark.sparkContext.broadcast(log_counts(profile.where("part IS NOT NULL"), buckets))
    postings = profile.where("key IS NOT NULL").agg(F.coalesce(F.sum(F.col("n") * (DENOMINATOR - NUMERATOR) / DENOMINATOR + CLASSES), F.lit(0))).first()[0]
    blocks = CLASSES * max(1, math.ceil(float(postings) / BLOCK_POSTINGS / CLASSES))
    products = _postings(rows, order, blocks).groupBy("block").applyInArrow(block_product, PAIR_SCHEMA)
    candidates = materialize(accumulated(products), "p3-candidates")
    one = members.groupBy("sig").agg(F.min("key").alias("key"))
    wanted = materialize(one.join(candidates.select(F.col("a_sig").alias("sig")).union(candidates.select("b_sig")).distinct(), "sig", "left_semi").select("key"), "p3-wanted")
    # the few texts to compare exactly: by broadcast of their keys up to a checked size
    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    sets = _gram_sets(rows.join(keys, "key", "left_semi")).groupBy("sig").agg(F.first("grams").alias("grams"))
    side = lambda s: sets.select(F.col("sig").alias(f"{s}_sig"), F.col("grams").alias(f"{s}_grams"))
    pairs = (
        candidates.join(side("a"), "a_sig")
        .join(side("b"), "b_sig")
        .select("a_sig", "b_sig", F.size(F.array_intersect("a_grams", "b_grams")).alias("overlap"), (F.size("a_grams") + F.size("b_grams")).alias("total"))
        .where((DENOMINATOR + NUMERATOR) * F.col("overlap") >= NUMERATOR * F.col("total"))
    )
    return members.select("key", "sig"), pairs


def near_duplicate_pairs(records: DataFrame, key: str = "chunk_key", text: str = "text") -> DataFrame:
    """(a_key, b_key): all pairs of keys, a_key < b_key, of similarity 0.6 or more."""
    members, pairs = similar_sets(records, key, text)
    a, b = members.select(F.col("key").alias("a"), F.col("sig").alias("a_sig")), members.select(F.col("key").alias("b"), F.col("sig").alias("b_sig"))
    across = pairs.join(a, "a_sig").join(b, "b_sig").select("a", "b")
    same = a.join(b, a.a_sig == b.b_sig).where("a < b").select("a", "b")
    return across.union(same).select(F.least("a", "b").alias("a_key"), F.greatest("a", "b").alias("b_key"))


def near_duplicate_classes(records: DataFrame, key: str = "chunk_key", text: str = "text") -> DataFrame:
    """(key, class_key, links): each row's class, named by its least key, and the number
    of different texts it is linked to. Rows without a set are classes of their own."""
    members, pairs = similar_sets(records, key, text)
    members, pairs = materialize(members, "p3-members"), materialize(pairs, "p3-pairs")
    labels = components(pairs.select(F.col("a_sig").alias("src"), F.col("b_sig").alias("dst")))
    links = pairs.select(F.col("a_sig").alias("sig")).union(pairs.select("b_sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("links"))
    known = members.join(labels.withColumnRenamed("node", "sig"), "sig", "left").join(links, "sig", "left").select("key", F.coalesce("label", "sig").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    least = known.groupBy("label").agg(F.min("key").alias("class_key"))
    known = known.join(least, "label").select(F.col("key").alias(key), "class_key", "links")
    alone = records.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
    return known.unionByName(alone.select(key, F.col(key).alias("class_key"), F.lit(0).cast("long").alias("links")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): connected components, labelled by their least node.

    Large-star and small-star rounds in turn; each round shuffles by node, its state is
    a written table, and hubs shrink round by round since every node keeps one link
    to the least node it knows.
    """
    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    while True:
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = Window.partitionBy("src")
        large = both.withColumn("m", F.least("src", F.min("dst").over(near))).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        small = large.withColumn("m", F.min("dst").over(near))
        small = small.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(small.select("src", F.col("m").alias("dst"))).distinct()
        after = materialize(small, "cc")
        if after.count() == now.count() and after.exceptAll(now).isEmpty():
            break
        now = after
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(now.select("dst", "dst")).distinct()


