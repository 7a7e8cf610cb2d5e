"""Latent semantic vectors of texts: the trained offline embedder.

TF-IDF of the most frequent one- and two-word terms with sublinear term counts, reduced by
a randomised singular value decomposition. Its sums over the corpus are matrices of fixed
size, FEATURES x (dims + EXTRA), added up on the executors in two passes over all texts, one
matrix a core at most.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.counters import SCHEMA, packed, tree_sum
from paperloom.operators.search import STOP_WORDS

FEATURES, DIMS, EXTRA, SEED = 30_000, 256, 10, 42
SLICES, TASK = 32, 25_000  # pieces of a matrix; texts a task has at least
BLOCK = 250  # texts: a term of theirs takes a row as wide as the basis
_WORD = re.compile(r"[^\W]{2,}")
_STOP = frozenset(STOP_WORDS)


def _terms(text: str | None) -> list[str]:
    words = [w for w in _WORD.findall((text or "").lower()) if w not in _STOP]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def vocabulary(texts: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """The FEATURES most frequent terms of all texts (ties in their order) with their
    places, and in how many texts each occurs."""

    def count(batches):
        for batch in batches:
            total, within = Counter(), Counter()
            for t in batch.column(0).to_pylist():
                terms = _terms(t)
                total.update(terms)
                within.update(set(terms))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([within[x] for x in total], pa.int64())], ["term", "n", "df"])

    rows = texts.mapInArrow(count, "term string, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).orderBy(F.desc("n"), "term").limit(FEATURES).collect()
    return {r["term"]: i for i, r in enumerate(rows)}, np.array([r["df"] for r in rows] or [0], np.float64)


def term_counts(texts: list[str | None], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of all texts' known terms."""
    row, feature = [], []
    for i, t in enumerate(texts):
        got = [known[x] for x in _terms(t) if x in known]
        row += [i] * len(got)
        feature += got
    if not row:
        return (np.empty(0, np.int64),) * 3
    key, counts = np.unique(np.array(row, np.int64) * FEATURES + np.array(feature, np.int64), return_counts=True)
    return key // FEATURES, key % FEATURES, counts


def _grouped(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct index values and the sums of their rows of values."""
    order = np.argsort(index, kind="stable")
    at, first = np.unique(index[order], return_index=True)
    return at, np.add.reduceat(values[order], first, axis=0) if len(at) else values


def weighted(texts: list[str | None], known: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with L2-normalised sublinear TF-IDF weights."""
    row, feature, counts = term_counts(texts, known)
    w = (1 + np.log(counts)) * idf[feature]
    norm = np.sqrt(np.bincount(row, w * w, len(texts)))
    return row, feature, (w / np.maximum(1e-30, norm[row])).astype(np.float32)


class Model:
    def __init__(self, known: dict[str, int], idf: np.ndarray, basis: np.ndarray):
        self.known, self.idf, self.basis = known, idf, basis

    def projected(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, features and weights of the texts' terms, and the texts in the basis."""
        row, feature, w = weighted(texts, self.known, self.idf)
        out = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        at, sums = _grouped(row, w[:, None] * self.basis[feature])
        out[at] = sums
        return row, feature, w, out

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        out = np.concatenate([self.projected(texts[a : a + BLOCK])[3] for a in range(0, max(1, len(texts)), BLOCK)])
        return out / np.maximum(1e-30, np.linalg.norm(out, axis=1, keepdims=True))


def fit(documents: DataFrame, dims: int = DIMS) -> Model:
    """The model of all documents (key, text); dims is at most the number of documents less
    one, and that of terms."""
    spark = documents.sparkSession
    texts = documents.select("text").where("text IS NOT NULL")
    n = texts.count()
    dims = max(1, min(dims, n - 1, FEATURES))
    known, df = vocabulary(texts)
    idf = np.log((1 + n) / (1 + df)) + 1
    basis = np.random.default_rng(SEED).standard_normal((len(df), min(len(df), dims + EXTRA)), np.float32)
    tasks = max(1, min(n // TASK, spark.sparkContext.defaultParallelism))
    few = texts.coalesce(tasks)  # every task sends a matrix
    for _ in range(2):  # power iteration: basis <- A'A basis, orthonormal
        model = spark.sparkContext.broadcast(Model(known, idf, np.linalg.qr(basis)[0]))

        def project(batches, model=model):
            total = np.zeros(model.value.basis.shape)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for a in range(0, len(texts), BLOCK):
                    row, feature, w, y = model.value.projected(texts[a : a + BLOCK])
                    at, sums = _grouped(feature, w[:, None] * y[row])
                    total[at] += sums
            yield packed(total, SLICES, "f4")

        basis = tree_sum(few.mapInArrow(project, SCHEMA), tasks, basis.size, SLICES, "f4").reshape(basis.shape)
        model.destroy()
    u, _, _ = np.linalg.svd(basis, full_matrices=False)
    return Model(known, idf, np.ascontiguousarray(u[:, :dims]))


def embed(documents: DataFrame, model: Model) -> DataFrame:
    """(key, vector) of documents (key, text); blank texts get a zero vector."""
    known = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = known.value.vectors(batch.column(1).to_pylist()).astype(np.float32)
            offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))], ["key", "vector"])

    return documents.select(F.col("key").cast("long").alias("key"), "text").mapInArrow(run, "key long, vector array<float>")
