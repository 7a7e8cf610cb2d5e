"""Command line: build an index from text files, ask it, evaluate it.

    python -m paperloom.cli build --documents DIR --output DIR
    python -m paperloom.cli query --output DIR [--query TEXT]
    python -m paperloom.cli evaluate --output DIR --golden FILE [--no-ablation]
    python -m paperloom.cli golden --output DIR --to FILE [--n 30]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.config import Settings, load
from paperloom.functions import text as T
from paperloom.operators import chunking, evaluation, graph, history, pipeline, sections, tagging
from paperloom.operators.search import Index
from paperloom.session import build_session, ship_package
from paperloom.sources import documents, files
from paperloom.sources.store import Store

ABLATION = {"bm25_only": {"dense": 0.0, "hyde": 0.0, "bm25": 1.0}, "dense_only": {"dense": 0.27, "hyde": 0.18, "bm25": 0.0}, "full": {"dense": 0.27, "hyde": 0.18, "bm25": 0.35}}


def build(spark: SparkSession, folder: str, output: str, pattern: str = "*.txt", extractor=documents.plain_text_lines, settings: Settings = Settings()) -> DataFrame:
    """Files -> lines -> sections -> chunks -> tags -> confidence -> agreement -> store."""
    ship_package(spark)
    store = Store(spark, output)
    lines = documents.extract_lines(documents.scan(spark, folder, pattern, content=True), extractor).withColumn("doc_id", F.xxhash64("path"))
    lines = sections.reading_order(sections.with_headers(sections.usable_lines(lines)))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    titles = lines.select("doc_id", stem.alias("stem")).distinct().join(sections.title_of(lines), "doc_id", "left").select("doc_id", F.coalesce("title", "stem").alias("paper_title"))
    found = sections.line_sections(lines, references=settings.chunking.include_references, captions=settings.chunking.include_captions).join(titles, "doc_id").withColumn("section_id", F.xxhash64("doc_id", "section_no")).withColumnRenamed("doc_id", "paper_id")
    rules = settings.chunking
    made = chunking.chunk_sections(found, rules.include_references, rules.include_captions, rules.min_tokens, rules.max_tokens, rules.overlap_tokens, rules.semantic_split_threshold).join(titles.withColumnRenamed("doc_id", "paper_id"), "paper_id").withColumn("chunk_key", F.xxhash64("chunk_id"))
    tagged = tagging.tag(made, files.read_tag_cache(spark, f"{output}/tag_cache"))
    scored = tagged.withColumn("confidence", T.confidence(F.col("text"), F.col("section"), F.col("token_count"), F.col("entities")))
    store.write("scored", scored)
    scored = store.read("scored")
    store.write("edges", graph.all_edges(scored))
    relations = graph.agreements(store.read("edges"), scored.select(F.col("chunk_key").alias("key"), T.direction(F.col("text")).alias("direction")))
    other = scored.select(F.col("chunk_key").alias("dst"), "chunk_id", "paper_title")
    linked = relations.join(other, "dst").groupBy(F.col("src").alias("chunk_key")).agg(
        F.array_sort(F.collect_set(F.when(F.col("relation") == "consensus", F.col("paper_title")))).alias("consensus_papers"),
        F.array_sort(F.collect_set(F.when(F.col("relation") == "contradiction", F.col("chunk_id")))).alias("conflict_chunk_ids"),
    )
    none = F.array().cast("array<string>")
    store.write("chunks", scored.join(linked, "chunk_key", "left").withColumn("consensus_papers", F.coalesce("consensus_papers", none)).withColumn("conflict_chunk_ids", F.coalesce("conflict_chunk_ids", none)))
    files.write_tag_cache(scored, f"{output}/tag_cache")
    store.write_model("tfidf", "own", 0)
    chunks = store.read("chunks")
    for name, made in pipeline.indexes(chunks).items():
        made.save(store, name)
    summary = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.countDistinct("paper_title").alias("papers"), F.count_if(F.col("is_figure_chunk")).alias("figure_chunks"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    files.write_report(summary, f"{output}/index_summary")
    return summary


def stored_indexes(store: Store) -> dict[str, Index]:
    return {name: Index.load(store, name, kind) for name, (_, kind) in pipeline.CHANNELS.items()}


def ask(spark: SparkSession, output: str, questions: list[str], settings: Settings = Settings()) -> DataFrame:
    """(query, context): the compressed context of each question."""
    store = Store(spark, output)
    store.check_model("own", 0)
    chunks = store.read("chunks")
    q = spark.createDataFrame(list(enumerate(questions)), "query long, text string")
    results = pipeline.retrieved(chunks, q, pipeline.channels(None, q, stored_indexes(store)), settings.retrieval.weights(), cutoff=settings.retrieval.cutoff())
    kept = pipeline.compress(results, chunks, q, settings.target_tokens)
    return kept.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s")).select("query", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("context"))


def evaluate(spark: SparkSession, output: str, golden: str, ablation: bool = True, k_values: tuple = evaluation.K_VALUES) -> DataFrame:
    """(config, k, recall, precision, ndcg, mrr) of the golden questions; stops when under
    half of their chunks exist."""
    chunks = Store(spark, output).read("chunks")
    g = files.read_golden(spark, golden).withColumn("query", F.xxhash64("question")).withColumn("text", F.col("question"))
    judged = evaluation.relevant(g, "relevant_chunk_ids", "id")
    known = judged.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi").count()
    if known * 2 < judged.count():
        raise ValueError("the golden questions are stale: under half of their chunks exist; make them anew")
    found, ids, rows = pipeline.channels(None, g, stored_indexes(Store(spark, output))), chunks.select(F.col("chunk_key").alias("key"), "chunk_id"), None
    for name, weights in (ABLATION if ablation else {"full": ABLATION["full"]}).items():
        results = pipeline.retrieved(chunks, g, found, weights).join(ids, "key").select("query", F.col("chunk_id").alias("id"), "rank")
        mrr = evaluation.first_hits(results, judged, g).agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
        part = evaluation.at_k(results, judged, g, k_values).groupBy("k").agg(*[F.round(F.avg(m), 6).alias(m) for m in ("recall", "precision", "ndcg", "ndcg_retrieved")]).crossJoin(F.broadcast(mrr)).withColumn("config", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    files.write_report(rows, f"{output}/eval_report")
    return rows


def golden(spark: SparkSession, output: str, to: str, n: int = 30, seed: str = "42") -> DataFrame:
    """Questions whose answers are chunks of the index, chosen by a hash instead of chance.
    Their wording is each chunk's hypothetical question; a model may write better ones."""
    chunks = Store(spark, output).read("chunks")
    fit = chunks.where("length(text) > 80 AND length(hyde_question) >= 15").orderBy(F.md5(F.concat(F.lit(seed), "chunk_id"))).limit(n)
    rows = fit.select(F.col("hyde_question").alias("question"), F.array("chunk_id").alias("relevant_chunk_ids"), F.array("paper_title").alias("relevant_papers"), F.col("summary").alias("answer"), F.when(F.col("is_figure_chunk"), "figure").otherwise("single").alias("difficulty"))
    files.write_golden(rows, to)
    return rows


def session(spark: SparkSession, output: str, lines: Iterable[str], settings: Settings = Settings(), call: Callable[[str], str] | None = None) -> Iterator[str]:
    """The answers of one session: a question a line, until quit; clear forgets the turns.
    ``call`` answers a prompt of context, last messages and question; without a model the
    context itself is the answer."""
    turns: list[tuple[str, str]] = []
    for line in map(str.strip, lines):
        if line.lower() in ("quit", "exit", "q"):
            return
        if line.lower() == "clear":
            turns.clear()
            yield "History cleared."
        elif line:
            row = ask(spark, output, [line], settings).first()
            context = row["context"] if row else ""
            before = [f"{r['role']}: {r['text']}" for r in session_prompt(turns, spark).orderBy("turn").collect()] if turns else []  # six at most
            reply = call("\n\n".join([context, *before, f"user: {line}"])) if call else context
            turns += [("user", line), ("assistant", reply)]
            yield reply


def session_prompt(turns: list[tuple[str, str]], spark: SparkSession) -> DataFrame:
    """The last messages of one session, as context of the next question."""
    rows = [(0, i, role, text) for i, (role, text) in enumerate(turns)]
    return history.last_messages(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="paperloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["build", "query", "evaluate", "golden"])
    parser.add_argument("--documents")
    parser.add_argument("--output")
    parser.add_argument("--query")
    parser.add_argument("--golden", default="golden_qa.json")
    parser.add_argument("--to", default="golden_qa.json")
    parser.add_argument("--n", type=int, default=30)
    parser.add_argument("--no-ablation", action="store_true")
    parser.add_argument("--config")
    a = parser.parse_args(argv)
    settings = load(a.config)
    a.documents, a.output = a.documents or settings.pdf_dir, a.output or settings.output_dir
    spark = SparkSession.getActiveSession() or build_session()
    if a.command == "build":
        build(spark, a.documents, a.output, settings=settings).show(truncate=False)
    elif a.command == "evaluate":
        evaluate(spark, a.output, a.golden, not a.no_ablation, tuple(settings.k_values)).show(100, truncate=False)
    elif a.command == "golden":
        golden(spark, a.output, a.to, a.n).show(truncate=60)
    elif a.query:
        print(ask(spark, a.output, [a.query], settings).first()["context"])
    else:  # a session: one question a line, until quit
        for reply in session(spark, a.output, sys.stdin, settings):
            print(reply)


if __name__ == "__main__":
    main()
