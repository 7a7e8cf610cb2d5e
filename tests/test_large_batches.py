"""Searches and near-duplicates of large batches of questions, in parts."""

import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.operators import pipeline as L
from paperloom.operators import scan, search
from tests.conftest import rows

WORDS = "zinc copper cells wound gate pore iron flux acid salt heat bond".split()


def test_a_large_batch_is_asked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(scan, "SENT_BLOCKS", 1)
    monkeypatch.setattr(scan, "TASKS", 1)
    monkeypatch.setattr(scan, "BLOCK_ROWS", 16)
    r = random.Random(4)
    made = lambda n: [(i, " ".join(r.choices(WORDS, k=r.randint(0, 9)))) for i in range(n)]
    docs = spark.createDataFrame(made(300), "key long, text string").repartition(6)
    asked = spark.createDataFrame(made(40), "query long, text string")
    for kind in ("bm25", "tfidf"):
        known = rows(search.find(search.make_index(docs, kind), asked, 7).select("query", "key", "rank", F.round("score", 7)))
        assert rows(scan.find(scan.count(docs, kind), asked, 7).select("query", "key", "rank", F.round("score", 7))) == known


def test_the_whole_sums_bound_a_query_of_frequent_terms():
    r = np.random.default_rng(2)
    n, k = 20_000, 5
    asked = scan.Asked(np.array([1]), np.arange(2), [np.arange(2)], [np.array([2.0, 1.0])])
    doc, term = np.r_[np.sort(r.permutation(n)[:9000]), np.arange(n)], np.repeat([0, 1], [9000, n])
    weights = r.random(len(doc)) + 0.5
    sums = np.zeros(n)
    np.add.at(sums, doc, asked.weights[0][term] * weights)
    near, got = scan.Postings(asked, n, doc, term, weights).candidates(asked.places[0], asked.weights[0], -np.inf, True, k)
    assert set(np.argsort(-sums)[:k]) <= set(near) and len(near) < 100 and np.allclose(got, sums[near])


def test_near_duplicates_in_groups_equal_those_of_each_question(spark, monkeypatch):
    r = random.Random(8)
    texts = [" ".join(r.choices(WORDS, k=12)) for _ in range(30)]
    texts += [t + " lead" for t in texts[:12]] + ["", None]
    c = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_key long, text string")
    near = [(q, key) for q in range(9) for key in r.sample(range(len(texts) + 1), 25)]  # one key has no chunk
    known = set()
    for q in range(9):
        terms = {key: {w: texts[key].split().count(w) for w in texts[key].split()} if texts[key] else {} for p, key in near if p == q and key < len(texts)}
        df = lambda w: sum(w in t for t in terms.values())
        vectors = {key: {w: tf * (np.log((1 + len(terms)) / (1 + df(w))) + 1) for w, tf in t.items()} for key, t in terms.items()}
        norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
        for a, v in vectors.items():
            for b, u in vectors.items():
                if a != b and v and u and round(sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u), 9) > 0.85:
                    known.add((q, a, b))
    assert len(known) > 5
    asked = spark.createDataFrame(near, "query long, key long")
    for size in (1 << 18, 40):
        monkeypatch.setattr(L, "SIMILAR_ROWS", size)
        assert {tuple(x) for x in L.similar_candidates(asked, c).collect()} == known
