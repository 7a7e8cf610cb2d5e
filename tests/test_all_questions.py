"""The queries of the whole path answer every question of their table."""

from pyspark.sql import functions as F

from paperloom.operators import evaluation as E
from paperloom.operators import pipeline as L
from paperloom.plans import search
from tests.compare import connect
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def _whole(spark, monkeypatch, query):
    """The answers hold every question, and to some of them what they are when asked alone."""
    got = rows(query(spark, FOLDER))
    known = connect(FOLDER).execute("SELECT DISTINCT question_id FROM eval_questions WHERE question_id IS NOT NULL").fetchall()
    assert {r[0] for r in got} == {k for k, in known} and len(known) > 1
    every = search.all_questions
    monkeypatch.setattr(search, "all_questions", lambda *a: every(*a).where("query % 20 = 3"))
    assert rows(query(spark, FOLDER)) == [r for r in got if r[0] % 20 == 3]


def test_retrieve_hybrid_answers_all_questions(spark, monkeypatch):
    _whole(spark, monkeypatch, search.retrieve_hybrid)


def test_dedup_greedy_answers_all_questions(spark, monkeypatch):
    _whole(spark, monkeypatch, search.dedup_greedy)


def test_compress_context_answers_all_questions(spark, monkeypatch):
    _whole(spark, monkeypatch, search.compress_context)


def _means(spark, row):
    """The metrics (k, recall, ndcg) of one configuration, over all questions of the table."""
    _, weights, graph, reranked = row
    q = spark.read.parquet(f"{FOLDER}/eval_questions.parquet").dropDuplicates(["question_id"]).selectExpr("question_id AS query", "question AS text", "relevant_chunk_ids")
    c = search.chunks_once(spark, FOLDER)
    found = L.retrieved(c, q, search.channels(spark, FOLDER, q, c), weights, graph, reranked)
    results = found.join(c.select(F.col("chunk_key").alias("key"), F.col("chunk_id").alias("id")), "key").select("query", "id", "rank")
    at = E.at_k(results, E.relevant(q, "relevant_chunk_ids", "id"), q, (1, 5))
    return {r[0]: r[1:] for r in at.groupBy("k").agg(F.avg("recall"), F.avg("ndcg")).collect()}


def test_ablation_grid_is_over_all_questions(spark):
    known, got = _means(spark, search.ABLATION[0]), search.ablation_grid(spark, FOLDER).collect()
    assert len(got) == 10
    for r in got:
        if r["config"] == "bm25_only":
            assert abs(r["recall"] - known[r["k"]][0]) < 1e-6 and abs(r["ndcg"] - known[r["k"]][1]) < 1e-6


def test_ablation_gains_are_over_all_questions(spark):
    low, high = _means(spark, search.ABLATION[0]), _means(spark, search.ABLATION[4])
    got = {r["k"]: r for r in search.ablation_gains(spark, FOLDER).where("config = 'full'").collect()}
    assert set(got) == {1, 5}
    for k, r in got.items():
        assert abs(r["recall_gain"] - (high[k][0] - low[k][0])) < 3e-6 and abs(r["ndcg_gain"] - (high[k][1] - low[k][1])) < 3e-6
