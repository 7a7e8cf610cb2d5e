"""Operators on hand-made inputs with results worked out by hand."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import config
from paperloom.functions import text as T
from paperloom.operators import chunking, evaluation, graph, history, pipeline, retrieval, search, sections, tagging
from paperloom.operators.sections import Line, fold_lines
from paperloom.sources import documents, files, store
from paperloom.streaming import budget
from paperloom.streaming.tagging import tag_stream
from tests.conftest import rows


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_token_estimate(spark):
    assert column(spark, ["", "a", "a b c", " ".join("x" * 60), None, " \n"], T.token_estimate) == [1, 1, 4, 80, 1, 1]


def test_confidence(spark):
    df = spark.createDataFrame([(" ".join("x" * 150), "Results", 200, [])], "t string, s string, n int, e array<string>")
    assert df.select(T.confidence(F.col("t"), F.col("s"), F.col("n"), F.col("e"))).first()[0] == 0.6


def test_section_weight_and_type(spark):
    assert column(spark, ["Methods", "Method", "Caption: Figure 1", "Results and discussion"], T.section_weight) == [0.45, 0.5, 0.5, 1.0]
    assert column(spark, ["Materials and Methods", "Discussion", "Introduction", "Funding"], T.chunk_type) == ["methods", "conclusion", "background", "other"]


def test_direction_and_lexicons(spark):
    assert column(spark, ["increased activated promotes", "reduced blocked", "inhibits", "induces increase activates inhibits blocks", None], T.direction) == ["up", "down", "neutral", "neutral", "neutral"]
    assert column(spark, ["We demonstrate and demonstrated results"], lambda c: T.count_matches(c, T.WORD_PATTERN(T.ASSERTION))) == [2]


def test_citation_tail(spark):
    assert column(spark, ["seen [12, 14].", "x (Smith et al., 2020)", "see [12] here", "y (Smith, 2020);", None], T.ends_with_citation) == [True, True, False, True, False]


def test_lenient_json(spark):
    raw = ['```json\n{"theme":"x"}\n```', 'text {"theme":"x"} text', "oops", None]
    assert column(spark, raw, lambda c: T.lenient_json(c, "theme string")["theme"]) == ["x", "x", None, None]


def test_figure_query(spark):
    assert column(spark, ["Please configure", "What role", None], T.is_figure_query) == [True, False, False]


def test_section_machine():
    lines = [("Intro text here long", 0), ("Results", 1), ("body of the results is here", 0), ("Figure 1. cap", 0), ("a line of at least twenty characters", 0), ("short tail", 0), ("body2 of the results", 0), ("Funding information", 1), ("body3", 0), ("Discussion", 1), ("body4", 0), ("References", 1), ("body5", 0)]
    got = [(n, t) for n, t, *_ in fold_lines(Line(t, bool(h)) for t, h in lines)]
    assert got == [("PREAMBLE", "Intro text here long"), ("Caption: Figure 1", "Figure 1. cap a line of at least twenty characters"), ("Results", "body of the results is here\nshort tail\nbody2 of the results")]
    freed = [n for n, *_ in fold_lines((Line(t, bool(h)) for t, h in lines), absorb_noise=False, references=True)]
    assert freed == ["PREAMBLE", "Caption: Figure 1", "Results", "Discussion", "References"]
    assert list(fold_lines([])) == []


def test_headers_and_columns(spark):
    rows_ = [(1, 1, i, "plain text line", 10.0, False, 0.0 if i < 5 else 320.0, 250.0 if i < 5 else 580.0, float(i % 5), 600.0) for i in range(10)]
    rows_ += [(1, 2, 10, "Big Header", 14.0, False, 0.0, 500.0, 0.0, 600.0), (1, 2, 11, "1. Numbered start", 10.0, False, 0.0, 500.0, 1.0, 600.0), (1, 2, 12, "RESULTS:", 10.0, False, 0.0, 500.0, 2.0, 600.0), (1, 2, 13, "x", None, False, 0.0, 500.0, 2.0, 600.0)]
    lines = spark.createDataFrame(rows_, "doc_id long, page int, line_no long, text string, font_size double, is_bold boolean, x0 double, x1 double, y0 double, page_width double")
    got = sections.with_headers(sections.usable_lines(lines)).where("is_header").select("text")
    assert rows(got) == [("1. Numbered start",), ("Big Header",), ("RESULTS:",)]
    placed = sections.reading_order(lines)
    assert [r[0] for r in placed.where("page = 1").orderBy("place").select("line_no").collect()] == list(range(10))
    assert rows(placed.groupBy("page").agg(F.first("two_columns"))) == [(1, True), (2, False)]
    assert rows(sections.title_of(lines)) == [(1, "plain text line")]
    found = sections.line_sections(sections.reading_order(sections.with_headers(sections.usable_lines(lines))))
    assert [r["name"] for r in found.orderBy("section_no").collect()] == ["PREAMBLE"]


def test_packing():
    s = [" ".join(f"s{i}" for _ in range(6)) for i in range(1, 5)]
    assert chunking.pack(s, set(), 1, 20, 5) == [f"{s[0]} {s[1]}", f"{s[2]} {s[3]}"]
    assert chunking.pack(s, set(), 1, 20, 10) == [f"{s[0]} {s[1]}", f"{s[1]} {s[2]}", f"{s[2]} {s[3]}"]
    cited = [s[0], s[1] + " [1]", s[2], s[3]]
    assert chunking.pack(cited, set(), 1, 20, 5)[0].endswith(s[2])
    assert chunking.pack([" ".join("x" * 59)], set()) == [] and len(chunking.pack([" ".join("x" * 60)], set())) == 1
    assert chunking.pack([], set()) == [] and chunking.break_points([]) == set()


def test_chunk_sections(spark):
    text = " ".join(f"Cells grow well in dish {i}." for i in range(60))
    data = [(1, 1, 0, "Results", text, 1, False, False, "", "T"), (1, 1, 0, "Results", text, 1, False, False, "", "T"), (2, 1, 1, "References", text, 1, True, False, "", "T"), (3, 1, 2, "Caption: Figure 1", text, 1, False, True, "Figure 1", "T"), (4, 1, 3, "x", None, 1, None, None, None, None), (5, 1, 4, None, " \n", 1, None, None, None, None)]
    df = spark.createDataFrame(data, "section_id long, paper_id long, section_no int, name string, text string, page_start int, is_reference boolean, is_caption boolean, figure_id string, paper_title string")
    got = chunking.chunk_sections(df).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["is_figure_chunk"], r["chunk_id"]) for r in got] == [(0, False, "T_Results_0_p1"), (1, True, "T_Figure_1_1_p1")]
    assert chunking.chunk_sections(df.limit(0)).count() == 0


def test_rrf(spark):
    ranking = lambda keys: spark.createDataFrame([(1, k, i) for i, k in enumerate(keys, 1)], "query int, key string, rank int")
    got = {r["key"]: r for r in retrieval.fuse({"dense": ranking("AB"), "hyde": ranking("B"), "bm25": ranking("CA")}).collect()}
    assert {k: round(r["score"], 6) for k, r in got.items()} == {"A": 0.010071, "B": 0.007306, "C": 0.005738}
    assert got["A"]["sources"] == "bm25,dense" and got["A"]["norm_score"] == 1.0


@pytest.mark.parametrize("scores, keep", [([1, 0.95, 0.9, 0.5, 0.49], 3), ([1, 0.98, 0.97, 0.96, 0.95], 5), ([1, 0.3, 0.2], 3), ([0.0, 0.0], 3)])
def test_cutoff(spark, scores, keep):
    df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores, 1)], "query int, rank int, final double")
    assert rows(retrieval.dynamic_cutoff(df)) == [(1, keep)]


def test_greedy_dedup(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "query int, key long, rank int")
    near = spark.createDataFrame([(1, 10, 20), (1, 20, 10), (1, 20, 30), (1, 30, 20)], "query int, a long, b long")
    assert rows(retrieval.greedy_dedup(ranked, near)) == [(1, 10, 1), (1, 30, 2)]
    assert len(rows(retrieval.greedy_dedup(ranked, near.limit(0)))) == 3


def test_budget_fill(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 300), (1, 2, 0.8, 200), (1, 3, 0.1, 90)], "query int, pos int, score double, n_tokens int")
    assert rows(retrieval.budget_fill(df)) == [(1, 1), (1, 3)]


def test_rerank_without_scores_keeps_order(spark):
    results = spark.createDataFrame([(1, 10, 1, 1.0, "bm25"), (1, 20, 2, 0.5, "dense")], "query int, key long, rank int, norm_score double, sources string")
    none = spark.createDataFrame([], "query int, key long, pair_score double")
    assert [r["key"] for r in retrieval.rerank(results, none).orderBy("rank").collect()] == [10, 20]


def test_bm25_fills_with_zeros(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e f"), (4, None)], "key long, text string")
    got = search.bm25(docs, spark.createDataFrame([(9, "a zzz")], "query long, text string"), 3)
    assert [(r["key"], r["score"] > 0) for r in got.orderBy("rank").collect()] == [(1, True), (4, False), (3, False)]


def test_knn_and_index(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "key long, vector array<float>")
    q = df.where("key < 5").withColumnRenamed("key", "query")
    exact = search.knn(df, q, 5)
    x = x.astype("float32").astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(5):
        assert [r["key"] for r in exact.where(F.col("query") == i).orderBy("rank").collect()] == list(np.argsort(-(x @ x[i]))[:5])
    assert search.recall(search.ann(search.vector_index(df, 5), q, 5), exact).first()["recall"] >= 0.9


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "query int")
    results = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcd", 1)], "query int, id string, rank int")
    judged = spark.createDataFrame([(1, c) for c in "bdz"], "query int, id string")
    got = {(r["query"], r["k"]): r for r in evaluation.at_k(results, judged, q).collect()}
    assert [round(got[1, k]["recall"], 4) for k in (1, 3, 5)] == [0.0, 0.3333, 0.6667]
    assert got[1, 5]["precision"] == 0.4 and round(got[1, 3]["ndcg_retrieved"], 4) == 0.6309 and round(got[1, 3]["ndcg"], 4) == 0.2961 and round(got[1, 5]["ndcg_retrieved"], 4) == 0.6509
    assert got[2, 5]["recall"] == 0
    assert rows(evaluation.first_hits(results, judged, q)) == [(1, 2, 0.5), (2, -1, 0.0)]
    papers = spark.createDataFrame([(1, "P"), (1, "R")], "query int, paper string")
    need = spark.createDataFrame([(1, "P"), (1, "Q")], "query int, paper string")
    assert rows(evaluation.cross_recall(papers, need, q)) == [(1, 0.5), (2, 0.0)]


NODES = "chunk_key long, paper_title string, entities array<string>, theme string"


def test_entity_edges(spark):
    c = spark.createDataFrame([(1, "P", ["TP53", "Brca1"], None), (2, "Q", ["tp53", "TP53"], None), (3, "P", ["BRCA1"], None), (4, None, None, None)], NODES)
    edges = graph.entity_edges(graph.incidence(c), c.select(F.col("chunk_key").alias("key")))
    assert rows(edges.where("src < dst")) == [(1, 2, 1.5, 1, True), (1, 3, 0.8, 1, False)]
    said = spark.createDataFrame([(1, "up"), (2, "down"), (3, "up")], "key long, direction string")
    assert rows(graph.agreements(edges.where("src < dst"), said)) == [(1, 2, "contradiction")]


def test_theme_edges(spark):
    c = spark.createDataFrame([(i, "P", [], " Theme".strip()) for i in range(1, 8)] + [(8, "P", [], " ")], NODES)
    edges = graph.theme_edges(c)
    assert edges.count() == 20 and rows(edges.select("weight").distinct()) == [(0.3,)]


def test_positions_across_blocks(spark):
    df = spark.createDataFrame([("g", i * 1500) for i in range(20)] + [("h", 5)], "g string, k long")
    assert [r["pos"] for r in graph.positions(df, "g", "k").where("g = 'g'").orderBy("k").collect()] == list(range(1, 21))


def test_walk_spends_its_slots_on_repeats(spark):
    weights = {("s1", "a"): 4, ("s2", "a"): 3, ("s1", "b"): 2, ("s1", "c"): 1, ("a", "d"): 1}
    names = {n: i for i, n in enumerate(["s1", "s2", "a", "b", "c", "d"])}
    data = {i: [] for i in names.values()}
    for (x, y), w in weights.items():
        for j in range(w):
            data[names[x]].append(f"E{x}{y}{j}"), data[names[y]].append(f"E{x}{y}{j}")
    c = spark.createDataFrame([(i, "P", e, None) for i, e in data.items()], NODES)
    seeds = spark.createDataFrame([(1, 0), (1, 1)], "query int, key long")
    assert rows(graph.walk(graph.incidence(c), seeds, 2, 2)) == [(1, names["a"], 1), (1, names["d"], 2)]


def test_walk_follows_entity_and_theme_edges(spark):
    """1-2 share an entity; 3 and 4 hang on by their theme alone; 1-5 share both kinds."""
    data = [(1, "P", ["TP53", "BRCA1"], "Zinc"), (2, "P", ["tp53"], "other"), (3, "Q", [], "zinc"), (4, "Q", None, "zinc"), (5, "P", ["BRCA1"], "zinc")]
    c = spark.createDataFrame(data, NODES)
    seeds = spark.createDataFrame([(1, 1), (2, 3)], "query int, key long")
    reached = graph.walk(graph.incidence(c), seeds, themes=graph.theme_places(c))
    # ranks of query 1: 5 and 2 by entity (0.8), 4 and 3 by theme (0.6); query 2 meets 5 and 1 (0.6), 4 (0.3), then 2
    assert rows(reached) == [(1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 1), (2, 1, 1), (2, 2, 2), (2, 4, 1), (2, 5, 1)]
    edges = graph.all_edges(c)
    assert rows(edges.where("src = 1").select("dst", "weight", "n_shared")) == [(2, 0.8, 1), (3, 0.6, 0), (4, 0.6, 0), (5, 0.8, 1)]
    assert edges.count() == edges.select("src", "dst").distinct().count() == 2 * 7


def test_pipeline_walks_theme_edges(spark, monkeypatch):
    from paperloom.operators import pipeline, retrieval

    data = [(1, "P", [], "zinc"), (2, "Q", [], "zinc")]
    c = spark.createDataFrame(data, NODES)
    monkeypatch.setattr(retrieval, "rescore", lambda fused, q, c: fused)
    found = {"bm25": spark.createDataFrame([(7, 1, 1)], "query int, key long, rank int")}
    assert rows(pipeline.candidates(c, None, found).select("query", "key", "sources")) == [(7, 1, "bm25"), (7, 2, "graph")]


def test_tag_cache_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("a", "text one", "Methods", "T", "th"), ("b", "text two", "Results", "T", None)], "chunk_id string, text string, section string, paper_title string, theme string")
    path = str(tmp_path / "cache")
    assert files.read_tag_cache(spark, path).count() == 0
    files.write_tag_cache(tagging.fallback(c), path)
    cache = files.read_tag_cache(spark, path)
    hits, misses = tagging.split_cached(c.withColumn("text", F.when(F.col("chunk_id") == "a", "changed").otherwise(F.col("text"))), cache)
    assert [r["chunk_id"] for r in hits.collect()] == ["b"] and [r["chunk_id"] for r in misses.collect()] == ["a"]
    raw = spark.createDataFrame([("a", "m", '{"theme":"x"}'), ("b", "m", "oops")], "chunk_id string, text_md5 string, raw string")
    assert [tuple(r) for r in tagging.parse(raw).orderBy("chunk_id").select("theme", "chunk_type").collect()] == [("x", "other"), ("", "other")]


def test_incremental_tagging_is_idempotent(spark, tmp_path):
    schema = "chunk_id string, text string, section string, paper_title string"
    spark.createDataFrame([("a", "one", "Results", "T"), ("a", "one", "Results", "T"), ("b", "two", None, None)], schema).write.parquet(str(tmp_path / "in"))
    for run in ("1", "2"):
        tag_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / f"state{run}")).awaitTermination()
    assert files.read_tag_cache(spark, str(tmp_path / "cache")).count() == 2


def test_trailing_sum_edges(spark):
    data = [("k", "2024-01-01 00:59:30", 1.0), ("k", "2024-01-01 01:00:29.999999", 2.0), ("k", "2024-01-01 01:00:30", 4.0), ("k", None, 9.0), ("j", "2024-01-01 01:00:30", 8.0)]
    df = spark.createDataFrame(data, "k string, s string, v double").withColumn("ts", F.to_timestamp_ntz("s"))
    assert rows(budget.trailing_sum(df, "k", "ts", "v").select("k", "v", "trailing")) == [("j", 8.0, 8.0), ("k", 1.0, 1.0), ("k", 2.0, 3.0), ("k", 4.0, 6.0)]
    assert rows(budget.waits(df, "k", "ts", "v", 5.0).where("over").select("v", "impossible")) == [(4.0, False), (8.0, True)]


def test_last_messages(spark):
    df = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", str(i)) for i in range(10)] + [(1, 99, "system", "s")], "conv_id int, turn int, role string, text string")
    assert [r["turn"] for r in history.last_messages(df).orderBy("turn").collect()] == [4, 5, 6, 7, 8, 9]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"))
    assert not s.is_built()
    s.upsert(spark.createDataFrame([("a", 1, "old"), ("b", 1, "b")], "chunk_id string, version int, v string"))
    s.upsert(spark.createDataFrame([("a", 2, "new"), ("c", 1, "c")], "chunk_id string, version int, v string"))
    assert s.is_built() and s.count() == 3 and s.get("a").first()["v"] == "new"
    keys = spark.createDataFrame([("c", 0), ("zz", 1), ("a", 2)], "chunk_id string, pos int")
    assert [r["v"] for r in s.get_many(keys).collect()] == ["c", "new"]
    s.write_model("tfidf", "own", 64)
    s.check_model("own", 64)
    with pytest.raises(store.ModelMismatch):
        s.check_model("other", 64)


def test_document_scan(spark, tmp_path):
    for name in ("b.txt", "a.txt", "Assignment1.txt", "c.bin"):
        (tmp_path / name).write_text("Line one\n\nLine two\fPage two line")
    found = documents.scan(spark, str(tmp_path), "*.txt", content=True)
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["a.txt", "b.txt"]
    lines = documents.extract_lines(found, documents.plain_text_lines)
    assert lines.count() == 6 and rows(lines.groupBy("page").count()) == [(1, 4), (2, 2)]


def test_golden_and_report(spark, tmp_path):
    q = spark.createDataFrame([("q", ["a"], ["P"], "x", "single")], files.GOLDEN_SCHEMA)
    files.write_golden(q, str(tmp_path / "golden"))
    assert files.read_golden(spark, str(tmp_path / "golden")).count() == 1
    files.write_report(spark.createDataFrame([("mrr", 0.5)], "metric string, value double"), str(tmp_path / "report"))
    assert files.metric_lines(spark.createDataFrame([("mrr", 0.5)], "metric string, value double")).first()[0].endswith("0.5000")


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"retrieval": {"max_k": 7, "unknown": 1}, "nothing": 2}')
    monkeypatch.setenv("OUTPUT_DIR", "/x")
    s = config.load(str(tmp_path / "c.json"))
    assert (s.retrieval.max_k, s.retrieval.min_k, s.output_dir, config.load(None).retrieval.max_k) == (7, 3, "/x", 15)


def test_lsa_finds_related_texts(spark):
    from paperloom.operators import lsa

    data = [(i, f"cells divide in the liver tissue number {i}") for i in range(20)] + [(100 + i, f"stars orbit a distant galaxy number {i}") for i in range(20)] + [(999, None), (998, " ")]
    df = spark.createDataFrame(data, "key long, text string")
    model = lsa.fit(df, 4)
    asked = lsa.embed(spark.createDataFrame([(1, "the liver cells")], "key long, text string"), model).withColumnRenamed("key", "query")
    got = search.knn(lsa.embed(df, model), asked, 20)
    assert {r["key"] for r in got.collect()} == set(range(20))
    assert lsa.fit(df.limit(0), 4).vectors(["x"]).shape == (1, 1)


def test_lsa_keeps_distinct_terms_and_dims(spark, monkeypatch):
    """12,000 words in 400 texts: every term has a place of its own, the vectors 256 numbers;
    more terms than places keep the most frequent."""
    from paperloom.operators import lsa

    data = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(400)]
    df = spark.createDataFrame(data, "key long, text string")
    known, frequency = lsa.vocabulary(df.select("text"))
    assert len(known) == len(frequency) == len(set(known.values())) == 400 * (30 + 29)
    model = lsa.fit(df)
    assert model.vectors(["w1x1"]).shape == (1, 256)
    assert lsa.fit(df.limit(5)).vectors(["w1x1"]).shape == (1, 4)
    monkeypatch.setattr(lsa, "FEATURES", 3)
    texts = spark.createDataFrame([("zeta eta",), ("zeta eta",), ("beta alpha",)], "text string")
    assert lsa.vocabulary(texts)[0] == {"eta": 0, "zeta": 1, "zeta eta": 2}


def test_sentences_are_scored_by_cosine(spark):
    sentences = ["Zinc moves through the membrane.", "The membrane holds.", "Nothing here fits at all.", "Zinc zinc zinc."]
    each = spark.createDataFrame([(q, i + 1, s) for q in (1, 2) for i, s in enumerate(sentences)], "query int, pos int, sentence string")
    q = spark.createDataFrame([(1, "How does zinc cross a membrane?"), (2, "the of and"), (3, "unused")], "query int, text string")
    got = {(r["query"], r["pos"]): r["score"] for r in pipeline.sentence_scores(each, q).collect()}
    terms = lambda t: [w for w in re.findall(r"\w{2,}", t.lower()) if w not in search.STOP_WORDS]
    docs = [terms(t) for t in ["How does zinc cross a membrane?", *sentences]]
    idf = {w: math.log(6 / (1 + sum(w in d for d in docs))) + 1 for d in docs for w in d}
    vectors = [{w: d.count(w) * idf[w] for w in d} for d in docs]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {(1, i): round(sum(x * vectors[0].get(w, 0) for w, x in v.items()) / norm(v) / norm(vectors[0]), 9) for i, v in enumerate(vectors) if i and v.keys() & vectors[0].keys()}
    assert got == pytest.approx(want) and len(want) == 3


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"))
    s.write("chunks", spark.range(3))
    with pytest.raises(Exception):
        s.write("chunks", spark.range(5).select(F.raise_error(F.lit("no")).alias("id")))
    assert s.count() == 3
    s.write("chunks", s.read("chunks").where("id > 0"))
    s.append("chunks", spark.range(10, 12))
    assert s.count() == 4 and not s.is_built("other")


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    data = [(i, (centres[i % 20] + 0.1 * rng.normal(size=16)).tolist()) for i in range(2_000)] + [(9_000, None), (None, [1.0] * 16)]
    df = spark.createDataFrame(data, "key long, vector array<double>")
    index = search.vector_index(df, 5)
    q = df.where("key % 100 = 0").withColumnRenamed("key", "query")
    assert len(index.centres) == 45 and index.probes <= 5 and index.rows.count() == 2_000
    assert search.recall(search.ann(index, q, 5), search.knn(df, q.where("vector IS NOT NULL"), 5)).first()["recall"] >= 0.9
    empty = df.where("key < 0")
    assert rows(search.ann(search.vector_index(empty), q.where("vector IS NOT NULL"), 5)) == [] and rows(search.ann(index, empty.withColumnRenamed("key", "query"), 5)) == []


def test_compression_without_broadcast_joins(spark):
    """Groups above a union of two shuffles had twice the tasks of what they were joined with."""
    r = random.Random(4)
    words = "zinc copper cells wound gate pore iron flux".split()
    text = lambda: " ".join(f"Then {' '.join(r.choice(words) for _ in range(11))}." for _ in range(40))
    results = spark.createDataFrame([(q, k + 1, 10 * q + k) for q in range(12) for k in range(3)], "query long, rank int, key long")
    c = spark.createDataFrame([(k, text()) for k in range(130)], "chunk_key long, text string")
    q = spark.createDataFrame([(i, " ".join(r.sample(words, 3))) for i in range(12)], "query long, text string")
    known = rows(pipeline.compress(results, c, q))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert known and rows(pipeline.compress(results, c, q)) == known
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
