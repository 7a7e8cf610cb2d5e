"""The query path for a batch of questions: one plan from searches to compressed context.

chunks are (chunk_key, text, section, paper_title, theme, summary, entities, hyde_question,
is_figure_chunk, confidence, consensus_papers, conflict_chunk_ids, ...), one row a chunk;
questions are (query, text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import graph as G
from paperloom.operators import retrieval as R
from paperloom.operators import scan as P
from paperloom.operators import search as S
from paperloom.session import materialize


def rich_documents(c: DataFrame) -> DataFrame:
    return c.select(F.col("chunk_key").alias("key"), T.rich_text(F.col("theme"), F.col("summary"), F.col("entities"), F.col("section")).alias("text"))


def text_documents(c: DataFrame) -> DataFrame:
    return c.select(F.col("chunk_key").alias("key"), "text")


def question_documents(c: DataFrame) -> DataFrame:
    return c.select(F.col("chunk_key").alias("key"), F.coalesce(F.nullif(F.trim("hyde_question"), F.lit("")), F.col("text")).alias("text"))


#: The three searches: their documents, and the kind of their index.
CHANNELS = {"dense": (text_documents, "tfidf"), "hyde": (question_documents, "tfidf"), "bm25": (rich_documents, "bm25")}


def indexes(c: DataFrame) -> dict[str, S.Index]:
    """The indexes of texts, questions and keywords."""
    return {name: S.make_index(documents(c), kind) for name, (documents, kind) in CHANNELS.items()}


def channels(c: DataFrame | None, q: DataFrame, made: dict[str, S.Index] | None = None) -> dict[str, DataFrame]:
    """The three searches' rankings (query, key, rank): texts, questions, keywords; by
    indexes made before, or of c."""
    return gathered({name: S.find(index, q) for name, index in (made or indexes(c)).items()})


def gathered(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rankings (query, key, rank), written together."""
    rows = None
    for name, df in found.items():
        part = df.select(F.lit(name).alias("channel"), "query", "key", "rank")
        rows = part if rows is None else rows.unionByName(part)
    rows = materialize(rows, "channels")  # computed once, read by every step after it
    return {name: rows.where(F.col("channel") == name) for name in found}


def only(c: DataFrame, *rows: DataFrame) -> DataFrame:
    """The chunks with a key in one of rows (key, ...)."""
    keys = rows[0].select("key")
    for r in rows[1:]:
        keys = keys.unionByName(r.select("key"))
    keys = materialize(keys.distinct().withColumnRenamed("key", "chunk_key"), "keys")
    return c.join(S.bounded_broadcast(keys), "chunk_key", "left_semi")


def walked(c: DataFrame, fused: DataFrame) -> DataFrame:
    """(query, key, hop) that the graph reaches from each query's best fused chunks."""
    seeds = S.top_k(fused, R.MAX_K, F.desc("norm_score"), "key")
    return G.walk(G.nodes(c), seeds, themes=G.theme_places(c))


def expanded(fused: DataFrame, reached: DataFrame) -> DataFrame:
    """(query, key, norm_score, sources): fused candidates and those only the walk reached."""
    new = reached.join(fused, ["query", "key"], "left_anti").select("query", "key", F.lit(R.GRAPH_SCORE).alias("norm_score"), F.lit("graph").alias("sources"))
    return fused.select("query", "key", "norm_score", "sources").unionByName(new)


def candidates(c: DataFrame, q: DataFrame, found=None, weights=R.WEIGHTS, graph=True) -> DataFrame:
    """(query, key, norm_score, final, sources): fused, expanded by the graph, rescored."""
    found = found or channels(c, q)
    fused = R.fuse(found, weights)
    if graph:
        fused = materialize(fused, "fused")
        fused = expanded(fused, walked(c, fused))
    fused = materialize(fused, "candidates")
    return R.rescore(fused, q, only(c, fused))


#: Candidates of a group of queries, about: their chunks' terms go to its task once.
SIMILAR_ROWS = 1 << 18


def _similar(near: pa.Table, texts: pa.Table) -> pa.Table:
    """The similar pairs of each query's candidates (query, key), by their chunks' terms
    (key, terms, tf). A term of one candidate only counts in its norm."""
    known = texts.column("key").to_numpy()
    order = np.argsort(known)
    known = known[order]
    lists = texts.column("terms").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    coded = lists.flatten().dictionary_encode()
    ids, tf = coded.indices.to_numpy(zero_copy_only=False), texts.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    count, column = np.zeros(len(coded.dictionary), np.int32), np.zeros(len(coded.dictionary), np.int64)
    query, key = near.column("query").to_numpy(), near.column("key").to_numpy()
    order = np.argsort(query, kind="stable")
    query, key = query[order], key[order]
    found = [np.empty((3, 0), np.int64)]
    for some in np.split(np.arange(len(query)), np.flatnonzero(query[1:] != query[:-1]) + 1) if len(known) else []:
        keys = key[some]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        keys, at = keys[known[at] == keys], at[known[at] == keys]
        n, length = len(keys), lengths[at]
        row, place = np.repeat(np.arange(n), length), np.repeat(starts[at] - np.cumsum(length) + length, length) + np.arange(length.sum())
        term = ids[place]
        np.add.at(count, term, 1)
        df = count[term]
        count[term] = 0
        w = tf[place] * (np.log((1 + n) / (1 + np.arange(n + 1))) + 1)[df]
        w /= np.maximum(1e-30, np.sqrt(np.bincount(row, w * w, n)))[row]
        row, term, w = row[df > 1], term[df > 1], w[df > 1]
        column[term] = np.arange(len(term))
        first = np.zeros(len(term), np.int64)
        first[column[term]] = 1
        vectors = np.zeros((n, int(first.sum())))
        vectors[row, (np.cumsum(first) - 1)[column[term]]] = w
        product = vectors @ vectors.T
        a, b = np.nonzero(product > R.DEDUP - 1e-8)
        near_enough = (a != b) & (np.round(product[a, b], 9) > R.DEDUP)
        a, b = keys[a[near_enough]], keys[b[near_enough]]
        found.append(np.stack([np.full(len(a), query[some[0]]), a, b]))
    return pa.table(dict(zip(("query", "a", "b"), np.concatenate(found, axis=1))))


def similar_candidates(rows: DataFrame, c: DataFrame) -> DataFrame:
    """Each query's candidate pairs of TF-IDF cosine above the limit, both directions;
    the vectors are fitted on that query's candidates alone, a bounded group, in one
    product of matrices. Queries meet their chunks in groups of about SIMILAR_ROWS
    candidates, each chunk once a group."""
    rows = rows.select(F.col("query").cast("long").alias("query"), F.col("key").cast("long").alias("key"))
    groups = -(-rows.count() // SIMILAR_ROWS) or 1
    rows = rows.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)))
    terms = c.select(F.col("chunk_key").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(P.tfidf_terms, P.TERMS)
    texts = rows.select(F.col("group").alias("of"), F.col("key").alias("wanted")).distinct().join(terms, F.col("wanted") == F.col("key")).select("of", "key", "terms", "tf")
    return rows.groupBy("group").cogroup(texts.groupBy("of")).applyInArrow(_similar, "query long, a long, b long")


def ranked_candidates(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("final"), F.desc("key"))))


def cut(c: DataFrame, rescored: DataFrame, cutoff: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, key, rank, norm_score, sources) of rescored candidates: without
    near-duplicates, as many as the dips of the scores leave; and the candidates' chunks."""
    ranked = materialize(ranked_candidates(rescored), "ranked")
    c = materialize(only(c, ranked), "ranked-chunks")
    kept = R.greedy_dedup(ranked.select("query", "key", "rank"), similar_candidates(ranked, c))
    kept = materialize(kept.join(ranked.select("query", "key", "final", "sources"), ["query", "key"]), "kept")
    n = R.dynamic_cutoff(kept, **(cutoff or {}))
    top = F.max("final").over(Window.partitionBy("query"))
    return kept.withColumn("norm_score", F.when(top > 0, F.col("final") / top).otherwise(0.0)).join(n, "query").where("rank <= n_keep").select("query", "key", "rank", "norm_score", "sources"), c


def retrieved(c: DataFrame, q: DataFrame, found=None, weights=R.WEIGHTS, graph=True, reranked=True, cutoff: dict | None = None) -> DataFrame:
    """(query, key, rank, norm_score, sources): the whole pipeline's results."""
    results, c = cut(c, candidates(c, q, found, weights, graph), cutoff)
    return R.rerank(results, R.lexical_pair_scores(results, q, c)) if reranked else results


#: Terms of one question's sentences that are weighed, the most frequent first.
SENTENCE_TERMS = 2_000


def _sentence_scores(table: pa.Table) -> pa.Table:
    """(query, pos, score) of one question's sentences (query, pos, terms), the question at 0."""
    query, pos = table.column("query")[0].as_py(), table.column("pos").to_numpy()
    lists = table.column("terms").combine_chunks()
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    terms, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(pos)), lengths)
    total = np.bincount(at, minlength=len(terms))
    first = np.ones(len(terms), bool)
    if len(terms) > SENTENCE_TERMS:
        first[sorted(range(len(terms)), key=lambda t: (-total[t], terms[t]))[SENTENCE_TERMS:]] = False
    cell, tf = np.unique(row * max(1, len(terms)) + at, return_counts=True)
    row, at = np.divmod(cell, max(1, len(terms)))
    df = np.bincount(at, minlength=len(terms))
    w = tf * (np.log((1 + len(pos)) / (1 + df)) + 1)[at] * first[at]
    w = w / np.maximum(1e-30, np.sqrt(np.bincount(row, w * w, len(pos))))[row]
    asked = np.zeros(len(terms))
    mine = pos[row] == 0
    asked[at[mine]] = w[mine]
    score = np.bincount(row, w * asked[at], len(pos))
    keep = (pos > 0) & (score > 0)
    return pa.table({"query": pa.array([query] * int(keep.sum()), pa.int64()), "pos": pa.array(pos[keep], pa.int32()), "score": pa.array(np.round(score[keep], 9))})


def sentence_scores(each: DataFrame, q: DataFrame) -> DataFrame:
    """(query, pos, score): TF-IDF cosine of each sentence (query, pos, sentence) with its
    question (query, text), where they have terms in common; fitted on that question and its
    sentences alone, those of its few kept results."""
    texts = each.select("query", "pos", F.col("sentence").alias("text")).unionByName(q.select("query", F.lit(0).alias("pos"), "text").join(each.select("query").distinct(), "query", "left_semi"))
    # Written, since groups above a union of two shuffles can't be joined by tasks of another number.
    texts = materialize(texts.select(F.col("query").cast("long").alias("query"), F.col("pos").cast("int").alias("pos"), S.word_terms(F.col("text")).alias("terms")), "sentence-terms")
    return texts.groupBy("query").applyInArrow(_sentence_scores, "query long, pos int, score double")


def compress(results: DataFrame, c: DataFrame, q: DataFrame, budget: int = 400) -> DataFrame:
    """(query, pos, n_tokens, sentence): the sentences of the results that fit the budget, best
    first by their TF-IDF cosine with the question, in their order; a context within it
    stays whole."""
    results = materialize(results, "results")
    texts = results.join(only(c, results).select(F.col("chunk_key").alias("key"), "text"), "key")
    each = texts.select("query", "rank", F.posexplode(T.split_sentences(F.col("text"))).alias("no", "sentence"))
    each = each.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("rank", "no"))).withColumn("n_tokens", T.token_estimate(F.col("sentence")))
    each = materialize(each.select("query", "pos", "n_tokens", "sentence"), "sentences")
    rows = each.join(each.groupBy("query").agg(F.sum("n_tokens").alias("total")), "query")
    long = rows.where(F.col("total") > budget)
    scored = long.join(sentence_scores(long, q), ["query", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    filled = R.budget_fill(scored.select("query", "pos", "score", "n_tokens"), budget)
    kept = materialize(rows.where(F.col("total") <= budget).select("query", "pos").unionByName(filled), "kept-sentences")
    return kept.join(each, ["query", "pos"]).select("query", "pos", "n_tokens", "sentence")
