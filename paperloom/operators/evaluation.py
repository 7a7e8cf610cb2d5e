"""Ranked-retrieval metrics of batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5, 10)


def relevant(questions: DataFrame, column: str, into: str) -> DataFrame:
    """(query, into): the distinct, trimmed, non-blank ids of an array column."""
    return questions.select("query", F.explode(column).alias("raw")).select("query", F.trim("raw").alias(into)).where(f"{into} <> ''").distinct()


def at_k(results: DataFrame, judged: DataFrame, queries: DataFrame, k_values=K_VALUES) -> DataFrame:
    """(query, k, recall, precision, ndcg_retrieved, ndcg): results (query, id, rank)
    against judged (query, id). ndcg_retrieved takes its ideal order from the first k
    retrieved, ndcg from all relevant ids. Queries without results or relevant ids get 0."""
    n_rel = judged.groupBy("query").agg(F.count(F.lit(1)).alias("n_rel"))
    marked = results.join(judged.select("query", "id", F.lit(1).alias("rel")), ["query", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    ks = queries.select("query", F.explode(F.array(*map(F.lit, k_values))).alias("k"))
    gain = F.sum(F.when(F.col("rank") <= F.col("k"), F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    per = ks.join(marked, "query", "left").groupBy("query", "k").agg(F.coalesce(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("rel"))), F.lit(0)).alias("hits"), gain.alias("dcg"))
    per = per.join(n_rel, "query", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    first = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int"))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    return per.select(
        "query",
        "k",
        F.round(F.col("hits") / F.greatest("n_rel", F.lit(1)), 6).alias("recall"),
        F.round(F.col("hits") / F.col("k"), 6).alias("precision"),
        F.round(F.when(F.col("hits") > 0, F.col("dcg") / first(F.col("hits"))).otherwise(0.0), 6).alias("ndcg_retrieved"),
        F.round(F.when(F.col("n_rel") > 0, F.col("dcg") / first(F.least("n_rel", "k"))).otherwise(0.0), 6).alias("ndcg"),
    )


def first_hits(results: DataFrame, judged: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, first_hit_rank, reciprocal_rank): -1 and 0 without a hit."""
    hits = results.join(judged, ["query", "id"], "left_semi").groupBy("query").agg(F.min("rank").alias("first"))
    return queries.select("query").join(hits, "query", "left").select("query", F.coalesce("first", F.lit(-1)).alias("first_hit_rank"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def cross_recall(papers: DataFrame, judged: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, cross_paper_recall): the share of the relevant papers among the retrieved;
    0 without relevant papers."""
    found = judged.join(papers.distinct().withColumn("hit", F.lit(1)), ["query", "paper"], "left").groupBy("query").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return queries.select("query").join(found, "query", "left").select("query", F.round(F.coalesce("r", F.lit(0.0)), 6).alias("cross_paper_recall"))


def means(per_question: DataFrame, hits: DataFrame, results: DataFrame, queries: DataFrame) -> DataFrame:
    """(difficulty, k, n_questions, mean_returned, recall, precision, ndcg, mrr): means of the
    questions' metrics (at_k, first_hits) and of the number of their results, over all
    questions ('all') and by difficulty, trimmed and lower-cased, '' for null."""
    kind = F.lower(F.trim(F.coalesce("difficulty", F.lit(""))))
    kinds = queries.select("query", F.explode(F.array(F.lit("all"), kind)).alias("difficulty"))
    returned = results.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    rows = per_question.join(hits.select("query", "reciprocal_rank"), "query").join(returned, "query", "left").join(kinds, "query")
    mean = lambda c: F.round(F.avg(c) + 1e-9, 5)
    return rows.groupBy("difficulty", "k").agg(
        F.count(F.lit(1)).alias("n_questions"),
        mean(F.coalesce("n", F.lit(0))).alias("mean_returned"),
        *[mean(F.col(m)).alias(m) for m in ("recall", "precision", "ndcg")],
        mean(F.col("reciprocal_rank")).alias("mrr"),
    )
