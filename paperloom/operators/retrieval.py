"""Fusion, rescoring, near-duplicate removal, cutoff and reranking of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

# The effective configuration.
RRF_K = 60
WEIGHTS = {"dense": 0.45 * 0.6, "hyde": 0.45 * 0.4, "bm25": 0.35}
GRAPH_SCORE = 0.5 * 0.20
MAX_K, MIN_K, THRESHOLD, MIN_DIP = 15, 3, 0.50, 0.15
DEDUP = 0.85
THEME_BOOST, ENTITY_BOOST, FIGURE_BOOST, CONSENSUS_BOOST, CONFLICT, CONFIDENCE_BOOST = 1.25, 0.15, 1.3, 0.05, 0.85, 0.1
CE_WEIGHT = 0.70


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query, key, score, norm_score, sources): weighted reciprocal-rank fusion of
    rankings (query, key, rank); one union and one aggregation instead of outer joins."""
    parts = [df.select("query", "key", F.lit(name).alias("source"), (F.lit(float(weights[name])) / (RRF_K + F.col("rank"))).alias("part")) for name, df in channels.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fused = rows.groupBy("query", "key").agg(F.round(F.sum("part"), 12).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    best = F.max("score").over(Window.partitionBy("query"))
    return fused.withColumn("norm_score", F.when(best > 0, F.col("score") / best).otherwise(0.0))


def rescore(fused: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, key, norm_score, final, sources): fused scores times the metadata boosts;
    candidates without a chunk are dropped. Questions are (query, text), chunks have
    chunk_key; what hangs on one of them alone is made once for it, not for each candidate."""
    array = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    asked = questions.select("query", T.query_tokens(F.col("text")).alias("asked"), T.is_figure_query(F.col("text")).alias("figure_query"))
    names = array(F.filter("entities", lambda e: e.isNotNull()))
    made = chunks.select(
        F.col("chunk_key").alias("key"),
        T.query_tokens(F.coalesce("theme", F.lit(""))).alias("theme_terms"),
        F.array_distinct(F.flatten(F.transform(names, lambda e: T.query_tokens(e)))).alias("entity_terms"),
        F.coalesce("is_figure_chunk", F.lit(False)).alias("is_figure"),
        (1 + CONSENSUS_BOOST * F.least(F.lit(4), F.size(array(F.col("consensus_papers"))))).alias("consensus"),
        F.when(F.size(array(F.col("conflict_chunk_ids"))) > 0, CONFLICT).otherwise(1.0).alias("conflict"),
        (1 + CONFIDENCE_BOOST * F.coalesce("confidence", F.lit(0.5))).alias("confident"),
    )
    found = fused.join(asked, "query").join(made, "key")
    overlap = lambda terms: F.size(F.array_intersect("asked", terms))
    share = F.least(F.lit(1.0), 3.0 * overlap("theme_terms") / F.greatest(F.size("asked"), F.lit(1)))
    figure = F.when(F.col("figure_query") & F.col("is_figure"), FIGURE_BOOST).otherwise(1.0)
    factor = (1 + (THEME_BOOST - 1) * share) * (1 + ENTITY_BOOST * overlap("entity_terms")) * figure * F.col("consensus") * F.col("conflict") * F.col("confident")
    return found.select("query", "key", "norm_score", F.round(F.col("norm_score") * factor, 9).alias("final"), "sources")


def dynamic_cutoff(ranked: DataFrame, score: str = "final", max_k: int = MAX_K, min_k: int = MIN_K, threshold: float = THRESHOLD, min_dip: float = MIN_DIP) -> DataFrame:
    """(query, n_keep): how many of each query's results (query, rank, score) to keep.

    The largest relative dip between neighbours among the scores of at least threshold x
    the best decides if it reaches min_dip; the number is within min_k and max_k."""
    by = Window.partitionBy("query").orderBy("rank")
    everything = Window.partitionBy("query")
    rows = ranked.select("query", "rank", F.col(score).alias("s"))
    rows = rows.withColumn("top", F.max("s").over(everything)).withColumn("before", F.lag("s").over(by)).withColumn("n", F.count(F.lit(1)).over(everything))
    above = F.greatest(F.count_if(F.col("s") >= threshold * F.col("top")).over(everything), F.lit(min_k))
    rows = rows.withColumn("above", F.least(above, F.col("n")))
    dip = F.when((F.col("before") > 0) & (F.col("rank") <= F.col("above")), (F.col("before") - F.col("s")) / F.col("before"))
    per = rows.withColumn("dip", F.round(dip, 9)).groupBy("query").agg(F.max("top").alias("top"), F.max("above").alias("above"), F.max(F.struct("dip", -F.col("rank"))).alias("best"))
    keep = F.when(F.coalesce("top", F.lit(0.0)) == 0, F.lit(min_k)).when(F.col("above") <= 1, F.greatest(F.lit(min_k), F.lit(1))).when(F.col("best.dip") >= min_dip, -F.col("best.col2") - 1).otherwise(F.col("above"))
    return per.select("query", F.least(F.lit(max_k), F.greatest(F.lit(min_k), keep)).cast("int").alias("n_keep"))


def greedy_dedup(ranked: DataFrame, similar: DataFrame) -> DataFrame:
    """ranked (query, key, rank) without rows too similar to a kept row of better rank.

    similar (query, a, b) are each query's similar pairs, in both directions. A dropped
    row drops no other, so the fold runs in order over each query's candidates, which
    the channels' limits bound."""
    near = similar.groupBy("query", F.col("a").alias("key")).agg(F.collect_set("b").alias("near"))
    rows = ranked.join(near, ["query", "key"], "left").select("query", F.struct("rank", "key", F.coalesce("near", F.array().cast("array<bigint>")).alias("near")).alias("row"))
    ordered = rows.groupBy("query").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    kept = F.aggregate("rows", F.array().cast("array<bigint>"), lambda acc, r: F.when(F.arrays_overlap(acc, r["near"]), acc).otherwise(F.concat(acc, F.array(r["key"]))))
    return ordered.select("query", F.posexplode(kept).alias("pos", "key")).select("query", "key", (F.col("pos") + 1).alias("rank"))


def rerank(results: DataFrame, scores: DataFrame) -> DataFrame:
    """results (query, key, rank, norm_score, sources) reordered by 0.70 x the min-max scaled
    pair score + 0.30 x norm_score; scores (query, key, pair_score) come from any scorer.
    Equal pair scores scale to 0.5; results without one keep theirs at 0."""
    w = Window.partitionBy("query")
    rows = results.join(scores, ["query", "key"], "left").withColumn("pair_score", F.coalesce("pair_score", F.lit(0.0)))
    low, high = F.min("pair_score").over(w), F.max("pair_score").over(w)
    scaled = F.when(high > low, (F.col("pair_score") - low) / (high - low)).otherwise(0.5)
    rows = rows.withColumn("mixed", F.round(CE_WEIGHT * scaled + (1 - CE_WEIGHT) * F.col("norm_score"), 9))
    rows = rows.withColumn("new_rank", F.row_number().over(w.orderBy(F.desc("mixed"), "rank")))
    top = F.max("mixed").over(w)
    return rows.select("query", "key", F.col("new_rank").alias("rank"), F.round(F.when(top > 0, F.col("mixed") / top).otherwise(0.0), 9).alias("norm_score"), F.concat_ws(",", "sources", F.lit("reranked")).alias("sources"))


def lexical_pair_scores(results: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The offline pair scorer: the share of the question's words in `[title - section]
    text`, whole texts. Any model with the same columns can take its place."""
    rows = results.select("query", "key").join(questions.select("query", F.col("text").alias("question")), "query").join(chunks.select(F.col("chunk_key").alias("key"), "paper_title", "section", "text"), "key")
    seen = T.query_tokens(F.concat_ws(" ", F.substring("paper_title", 1, 40), "section", "text"))
    asked = T.query_tokens(F.col("question"))
    return rows.select("query", "key", F.round(F.size(F.array_intersect(asked, seen)) / F.greatest(F.size(asked), F.lit(1)), 9).alias("pair_score"))


def budget_fill(sentences: DataFrame, budget: int = 400) -> DataFrame:
    """sentences (query, pos, score, n_tokens) that fit a budget: in order of score each
    one that still fits is taken, misfits are passed over; output keeps the order of pos.
    A query's sentences are those of its few kept results, a bounded group."""
    row = F.struct((-F.col("score")).alias("s"), "pos", "n_tokens")
    ordered = sentences.groupBy("query").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<int>").alias("kept"))
    step = lambda acc, r: F.when((acc["left"] > 0) & (r["n_tokens"] <= acc["left"]), F.struct((acc["left"] - r["n_tokens"]).alias("left"), F.concat(acc["kept"], F.array(r["pos"])).alias("kept"))).otherwise(acc)
    return ordered.select("query", F.explode(F.array_sort(F.aggregate("rows", start, step)["kept"])).alias("pos"))
