"""Searches and walks of a batch by one pass over the documents."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions.spans import term_hashes
from paperloom.operators import graph, scan, search
from paperloom.plans import registry, text_scoring
from paperloom.plans import search as plans
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def _texts(n, seed=5):
    r = random.Random(seed)
    return [(i, " ".join(r.choice("zinc copper cells The of wound gate pore Iron flux".split()) for _ in range(r.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("kind", ["bm25", "tfidf"])
def test_scan_equals_the_index(spark, monkeypatch, kind):
    monkeypatch.setattr(scan, "BLOCK_ROWS", 16)  # several blocks a task: bounds of one prune the next
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    docs = spark.createDataFrame(_texts(200), "key long, text string").repartition(2)
    asked = spark.createDataFrame([(100 + i, t) for i, t in _texts(12, 6)] + [(1, "unknown"), (2, None), (3, "zinc zinc")], "query long, text string")
    known = rows(search.find(search.make_index(docs, kind), asked, 7).select("query", "key", "rank", F.round("score", 7)))
    counted = scan.count(docs, kind)
    assert rows(scan.find(counted, asked, 7).select("query", "key", "rank", F.round("score", 7))) == known
    monkeypatch.setattr(scan, "DICTIONARY", 2)  # norms by a shuffle
    assert rows(scan.find(counted, asked, 7).select("query", "key", "rank", F.round("score", 7))) == known


def test_terms_are_those_of_the_index(spark):
    texts = ["", " ", None, "a b  c\tÄbc d e", "The naïve 東京 cell_1 ½ 😀x y2 of", "x\u00a0y\u2003zz\x0bq\x1cr", "ΟΔΟΣ ΟΔΟΣ", "zinc—zinc ᾀβγ Ⅷ2 a1", "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string").coalesce(1)
    for words, terms in ((False, search.blank_terms), (True, search.word_terms)):
        known = [r[0] for r in df.orderBy("key").select(terms(F.col("text"))).collect()]
        low = pa.array([r[0] for r in df.orderBy("key").select(scan._lowered(F.col("text"))).collect()])
        got, lengths = term_hashes(low, words, tuple(search.STOP_WORDS) if words else ())
        assert lengths.tolist() == [len(k) for k in known]
        flat = [t for k in known for t in k]
        assert len(set(zip(flat, got.tolist()))) == len(set(flat)) == len(set(got.tolist()))
        part = low.slice(3, 4)
        assert term_hashes(part, words)[0].tolist() == term_hashes(pa.array(part.to_pylist()), words)[0].tolist()


def test_a_query_has_a_bound_within_its_first_block():
    r = np.random.default_rng(2)
    n, k = 2_000, 5
    asked = scan.Asked(np.array([1]), np.arange(3), [np.arange(3)], [np.array([9.0, 5.0, 0.1])])
    doc, term = np.r_[r.permutation(n)[:60], r.permutation(n)[:300], np.arange(n)], np.repeat([0, 1, 2], [60, 300, n])
    weights = r.random(len(doc)) + 0.5
    sums = np.zeros(n)
    np.add.at(sums, doc, asked.weights[0][term] * weights)
    near, got = scan.Postings(asked, n, doc, term, weights).candidates(asked.places[0], asked.weights[0], -np.inf, True, k)
    assert set(np.argsort(-sums)[:k]) <= set(near) and len(near) < 100 and np.allclose(got, sums[near])


def test_best_neighbours_equal_the_edges(spark):
    r = random.Random(3)
    c = spark.createDataFrame([(i, r.choice("PQ"), r.sample(["AAA", "BBB", "CCC", "DDD", "EEE"], r.randint(0, 4)), None) for i in range(80)], "chunk_key long, paper_title string, entities array<string>, theme string")
    sources = c.where("chunk_key < 30").select(F.col("chunk_key").alias("key"))
    edges = graph.entity_edges(graph.incidence(c), sources)
    first = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), F.desc("dst")))
    known = rows(edges.withColumn("r", first).where("r <= 6").select("src", "dst", "weight"))
    assert rows(scan.neighbours(graph.nodes(c), sources, 6, graph.CROSS_ENTITY, graph.WITHIN_ENTITY)) == known


@pytest.mark.parametrize("name", ["retrieve_hybrid", "ablation_gains", "ablation_grid", "redundancy", "dedup_greedy", "rrf_fusion", "rescored", "compress_context", "bm25_topk", "eval_means", "eval_at_k", "eval_mrr", "eval_cross_paper", "dynamic_cutoff"])
def test_no_index_is_made_for_one_batch(spark, monkeypatch, name):
    """Sorting all postings, and all edges of the walk, cost more than the whole answer."""

    def fail(*_):
        raise AssertionError("all postings or edges")

    monkeypatch.setattr(search, "make_index", fail)
    monkeypatch.setattr(graph, "entity_edges", fail)
    assert registry.queries()[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["eval_at_k", "eval_mrr", "eval_means", "eval_cross_paper"])
def test_metrics_make_chunks_ready_once_and_no_rows_in_python(spark, monkeypatch, name):
    made = []
    once = plans.chunks_once
    monkeypatch.setattr(plans, "chunks_once", lambda *a: made.append(a) or once(*a))
    monkeypatch.setattr(plans, "_made", {})
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: made.append(a))
    assert registry.queries()[name](spark, FOLDER).count() > 0 and len(made) == 1


def test_terms_are_lowered_as_the_index_does(spark):
    texts = ["ÄBC Zinc", "İstanbul \u212aelvin", "ΟΔΟΣ", "Σα ΣΑΣ", "ΣΑΣ", "ABC", "", "ǅ Ⅷ2 ẞa"]
    for part in (texts, texts[2:5], texts[:1] + texts[5:], texts[5:7]):
        df = spark.createDataFrame(list(enumerate(part)), "key long, text string").coalesce(1)
        low = pa.array([r[0] for r in df.orderBy("key").select(F.lower("text")).collect()])
        for words in (False, True):
            assert [x.tolist() for x in term_hashes(pa.array(part), words)] == [x.tolist() for x in term_hashes(low, words)]


def test_repeated_chunks_are_found_in_one_pass(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i % 50, f"t{i % 50}") for i in range(60)] + [(None, "x")], "chunk_key long, text string").repartition(4).write.parquet(f"{tmp_path}/chunks.parquet")
    made = []
    monkeypatch.setattr(text_scoring, "materialize", lambda df, name: made.append(name) or df)
    c = text_scoring.chunks_once(spark, str(tmp_path), "text")
    assert sorted(rows(c)) == [(i, f"t{i}") for i in range(50)] and len(made) == 1
