"""Filling fixed-capacity containers with items (problem 9).

Sizes are whole numbers up to the capacity, so an instance of any number of items is its
histogram: at most CAPACITY counts, whatever the corpus holds. The plan is made on it:
Martello and Toth's reduction fixes sets of one or two sizes that provably dominate every
other set with the larger one, best-fit decreasing packs the remainder; both work on
counts, not items, and give patterns with multiplicities. Items find their container by
their rank among those of their size, which is computed without gathering a size.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.tokens import VOCABULARY, encode
from paperloom.session import materialize

CAPACITY = 2048
#: Rows of one size are ranked in slices of about so many.
SLICE = 500_000


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fixes dominating sets; takes their items out of ``counts`` (index is the size).

    For an item j with r = capacity - j and k the largest other item within r, the set
    {j} dominates if nothing fits; {j, k} dominates all sets with j if k fills r, if no
    two others fit together, or if k is at least as large as any two that do while no
    three fit: in each case what stood beside j fits into k's former place.
    """
    fixed = []
    for j in range(capacity, 0, -1):
        while counts[j]:
            r = capacity - j
            counts[j] -= 1  # partners are other items
            have = np.flatnonzero(counts[: r + 1]) if r else np.empty(0, np.int64)
            counts[j] += 1
            if not len(have):
                fixed.append((int(counts[j]), [(j, 1)]))
                counts[j] = 0
                break
            k = int(have[-1])
            least = _smallest(counts, j, 3)
            dominates = k == r or sum(least[:2]) > r or len(least) < 2
            if not dominates and (len(least) < 3 or sum(least) > r):
                dominates = k >= _best_pair(counts, j, r, have)
            if not dominates:
                break
            if k == j:
                m = int(counts[j]) // 2
                fixed.append((m, [(j, 2)]))
                counts[j] -= 2 * m
            else:
                m = int(min(counts[j], counts[k]))
                fixed.append((m, [(j, 1), (k, 1)]))
                counts[j] -= m
                counts[k] -= m
    return fixed


def _smallest(counts: np.ndarray, without: int, n: int) -> list[int]:
    """The n smallest items, one of size ``without`` left out."""
    out: list[int] = []
    for s in np.flatnonzero(counts):
        out += [int(s)] * min(n, int(counts[s]) - (s == without))
        if len(out) >= n:
            break
    return out[:n]


def _best_pair(counts: np.ndarray, j: int, r: int, have: np.ndarray) -> int:
    """The largest sum within r of two items other than one of size j."""
    at = np.searchsorted(have, r - have, "right") - 1
    best = 0
    for a, i in zip(have, at):
        while i >= 0:
            b = have[i]
            if a != b or counts[a] - (a == j) >= 2:
                best = max(best, int(a + b))
                break
            i -= 1
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on counts. Bins of one content are one class."""
    classes: dict[int, list[tuple[int, tuple]]] = {}
    residuals: list[int] = []

    def put(rest: int, m: int, content: tuple) -> None:
        if m:
            if rest not in classes:
                classes[rest] = []
                bisect.insort(residuals, rest)
            classes[rest].append((m, content))

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            at = bisect.bisect_left(residuals, s)
            if at < len(residuals):
                rest = residuals[at]
                m, content = classes[rest].pop()
                if not classes[rest]:
                    del classes[rest], residuals[at]
            else:
                rest, content = capacity, ()
                m = -(-n // (capacity // s))
            q = rest // s
            whole = min(m, n // q)
            n -= whole * q
            put(rest - q * s, whole, content + ((s, q),))
            if n and whole < m:
                put(rest - n * s, 1, content + ((s, n),))
                n, whole = 0, whole + 1
            if rest < capacity or content:
                put(rest, m - whole, content)
    return [(m, list(content)) for rows in classes.values() for m, content in rows]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how often, [(size, items a container)]) that use up a histogram."""
    counts = counts.astype(np.int64).copy()
    return reduce_dominated(counts, capacity) + best_fit(counts, capacity)


def lookup(patterns: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By (size, first rank): the first rank's container and the items of this size there."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for m, content in patterns:
        for size, k in content:
            rows.append(((size << 44) + used.get(size, 0), base, k))
            used[size] = used.get(size, 0) + m * k
        base += m
    rows.sort()
    starts, first, per = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
    return starts, first, per


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, size, container): items (key, size) packed into containers.

    Items without a size or of none are in no container. One above the capacity is cut
    into pieces of the capacity and a rest, others have piece 0. Every piece is in one
    container, none overflows; containers are numbered from 0. Keys must be unique. An
    empty table gives no rows.
    """
    whole = items.where("key IS NOT NULL AND size > 0")
    pieces = whole.select("key", F.posexplode(F.expr(f"transform(sequence(1, ceil(size / {capacity})), i -> cast(least({capacity}, size - (i - 1) * {capacity}) as int))")).alias("piece", "size"))
    sizes = pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["size"]] = r["n"]
    starts, first, per = lookup(plan(counts, capacity))
    slices = max(1, math.ceil(int(counts.sum()) / SLICE)) * 8
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("key", "piece"), F.lit(slices)))
    before = sliced.groupBy("size", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.row_number().over(Window.partitionBy("size", "slice").orderBy("key", "piece"))
    ranked = sliced.withColumn("local", local).join(before.select("size", "slice", "before"), ["size", "slice"])
    ranked = ranked.select("key", "piece", "size", (F.coalesce("before", F.lit(0)) + F.col("local") - 1).cast("long").alias("rank"))

    def find(batches):
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            at = np.searchsorted(starts, (size << 44) + rank, "right") - 1
            container = first[at] + ((size << 44) + rank - starts[at]) // np.maximum(1, per[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(container)], ["key", "piece", "size", "container"])

    return ranked.mapInArrow(find, "key long, piece int, size int, container long")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, n_tokens, container): documents in containers of ``capacity`` tokens."""
    sizes = materialize(encode(documents, vocabulary, counts_only=True), "p9-sizes")
    packed = pack(sizes.select(F.col("doc_id").alias("key"), F.col("n_tokens").alias("size")).distinct(), capacity)
    return packed.select(F.col("key").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused places, and the least number possible."""
    return packed.agg(
        F.countDistinct("container").alias("n_containers"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        (F.countDistinct("container") * capacity - F.coalesce(F.sum("n_tokens"), F.lit(0))).alias("unused"),
        F.ceil(F.coalesce(F.sum("n_tokens"), F.lit(0)) / capacity).alias("lower_bound"),
    )
