"""Queries of the text scalars: over all chunks, one row a chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.session import materialize, table

COLUMNS = ["chunk_key", "paper_id", "section_id", "chunk_id", "text", "section", "paper_title", "token_count", "is_figure_chunk", "theme", "summary", "entities", "hyde_question", "chunk_type", "confidence", "conflict_chunk_ids", "consensus_papers"]


def one_chunk(spark, d, *columns: str):
    """Each chunk once, however often it was delivered; repeats have the same content."""
    return table(spark, d, "chunks").select(*dict.fromkeys(["chunk_key", *(columns or COLUMNS)])).where("chunk_key IS NOT NULL").dropDuplicates(["chunk_key"])


#: Repeated keys of a table that are told apart by their rows' places; more are shuffled.
REPEATS = 200_000


def chunks_once(spark, d, *columns: str):
    """one_chunk without a shuffle of texts: of a repeated chunk the row whose place in the
    files has the least hash is taken."""
    c = table(spark, d, "chunks").select(*dict.fromkeys(["chunk_key", *(columns or COLUMNS)]), F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_at")).where("chunk_key IS NOT NULL")
    first = c.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")).where("n > 1").select("chunk_key", "_first")
    first = materialize(first, "first-rows")
    if first.count() > REPEATS:
        return one_chunk(spark, d, *columns)
    return c.join(F.broadcast(first), "chunk_key", "left").where("_first IS NULL OR _first = _at").drop("_at", "_first")


def token_estimate(spark, d):
    return one_chunk(spark, d, "text").select("chunk_key", T.token_estimate(F.col("text")).alias("n_tokens"), T.length_score(T.token_estimate(F.col("text"))).alias("length_score"))


def lexical_stats(spark, d):
    t = F.col("text")
    return one_chunk(spark, d, "text").select(
        "chunk_key",
        T.count_matches(t, T.WORD_PATTERN(T.ASSERTION)).alias("n_assertions"),
        T.count_matches(t, T.WORD_PATTERN(T.HEDGE)).alias("n_hedges"),
        T.direction(t).alias("direction"),
        F.size(T.text_entities(t)).alias("n_entities"),
        T.ends_with_citation(t).alias("ends_with_citation"),
    )


def confidence_score(spark, d):
    c = one_chunk(spark, d, "text", "section", "entities").withColumn("n", T.token_estimate(F.col("text")))
    return c.select("chunk_key", T.confidence(F.col("text"), F.coalesce("section", F.lit("")), F.col("n"), F.col("entities")).alias("confidence"))


def fallback_tags(spark, d):
    c = one_chunk(spark, d, "text", "section", "paper_title")
    return c.select(
        "chunk_key",
        F.coalesce("section", F.lit("")).alias("theme"),
        F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 150), F.lit("...")).alias("summary"),
        F.array_join(F.slice(T.text_entities(F.col("text")), 1, 8), "|").alias("entities"),
        F.concat(F.lit("What does "), F.substring(F.coalesce("paper_title", F.lit("")), 1, 40), F.lit(" report about "), F.coalesce("section", F.lit("")), F.lit("?")).alias("hyde_question"),
        T.chunk_type(F.coalesce("section", F.lit(""))).alias("chunk_type"),
    )


def chunk_ids(spark, d):
    s = table(spark, d, "chunks").select("chunk_key", "paper_id", "chunk_index", "section", "paper_title").dropDuplicates(["chunk_key"])
    return s.select("chunk_key", T.chunk_id(F.coalesce("paper_title", F.lit("")), F.coalesce("section", F.lit("")), F.col("chunk_index")).alias("built_id"))


def sentence_counts(spark, d):
    return one_chunk(spark, d, "text").select("chunk_key", F.coalesce(F.size(T.split_sentences(F.col("text"))), F.lit(0)).alias("n_sentences"), F.length(F.coalesce(T.collapse_blanks(F.col("text")), F.lit(""))).alias("n_chars"))


def figure_questions(spark, d):
    q = table(spark, d, "eval_questions").select("question_id", "question").dropDuplicates(["question_id"])
    return q.select("question_id", T.is_figure_query(F.col("question")).alias("is_figure"), F.coalesce(F.size(T.query_tokens(F.col("question"))), F.lit(0)).alias("n_tokens"))


def json_tags(spark, d):
    e = table(spark, d, "events").withColumn("raw", F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    # as answers come: some are cut off, some have words around them
    part = F.pmod("event_id", F.lit(7))
    e = e.withColumn("raw", F.when(part == 0, F.expr("left(raw, length(raw) - 5)")).when(part == 1, F.concat(F.lit("Here you are: "), F.col("props"), F.lit(" as asked."))).otherwise(F.col("raw")))
    return e.select("event_id", F.coalesce(T.lenient_json(F.col("raw"), "k bigint")["k"], F.lit(-1)).alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("as_json"))


def section_histogram(spark, d):
    c = one_chunk(spark, d, "section").groupBy(F.substring(F.coalesce("section", F.lit("")), 1, 30).alias("section")).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "section").limit(10)


def corpus_quality(spark, d):
    c = one_chunk(spark, d)
    has = lambda e: F.round(F.avg(F.when(e, 1.0).otherwise(0.0)) * 100 + 1e-9, 1)
    size = lambda x: F.size(F.coalesce(F.col(x), F.array().cast("array<string>")))
    return c.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(F.coalesce("is_figure_chunk", F.lit(False))).alias("n_figure"),
        F.countDistinct("paper_title").alias("n_papers"),
        F.round(F.avg("token_count"), 4).alias("mean_tokens"),
        F.median("token_count").alias("median_tokens"),
        F.round(F.stddev_pop("token_count"), 4).alias("std_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.round(F.avg("confidence"), 5).alias("mean_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        has(size("entities") > 0).alias("entity_coverage"),
        has(F.coalesce("theme", F.lit("")) != "").alias("theme_coverage"),
        F.count_if(size("consensus_papers") > 0).alias("n_consensus"),
        F.count_if(size("conflict_chunk_ids") > 0).alias("n_conflict"),
    )


def chunk_type_counts(spark, d):
    return one_chunk(spark, d, "chunk_type").groupBy(F.coalesce("chunk_type", F.lit("other")).alias("chunk_type")).agg(F.count(F.lit(1)).alias("n"))


def cache_hit_miss(spark, d):
    """Chunks against the tag cache, keyed by id and text: those with a theme are cached, a
    fifth of them with another text than they have now."""
    c = one_chunk(spark, d, "text", "theme").withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))
    cache = c.where(F.trim(F.coalesce("theme", F.lit(""))) != "").select("chunk_key", F.when(F.col("chunk_key") % 5 == 0, F.md5(F.lit("older"))).otherwise(F.col("text_md5")).alias("text_md5"), F.lit(True).alias("hit"))
    return c.join(cache, ["chunk_key", "text_md5"], "left").groupBy(F.coalesce("hit", F.lit(False)).alias("cached")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (token_estimate, lexical_stats, confidence_score, fallback_tags, chunk_ids, sentence_counts, figure_questions, json_tags, section_histogram, corpus_quality, chunk_type_counts, cache_hit_miss)}

ONE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_key ORDER BY ingested_at) AS rn FROM chunks WHERE chunk_key IS NOT NULL) WHERE rn = 1)"
_B = r"[^\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
WORDS = lambda c: f"coalesce(len(regexp_extract_all({c}, '{_B}')), 0)"
TOKENS = lambda c: f"greatest(1, CAST({WORDS(c)} * 4 // 3 AS INTEGER))"
COUNT = lambda c, p: f"coalesce(len(regexp_extract_all({c}, '{p}')), 0)"
_A, _H = COUNT("text", T.WORD_PATTERN(T.ASSERTION)), COUNT("text", T.WORD_PATTERN(T.HEDGE))
_U, _D = COUNT("text", T.STEM_PATTERN(T.UP_STEMS)), COUNT("text", T.STEM_PATTERN(T.DOWN_STEMS))
_ENT = "coalesce(list_distinct(regexp_extract_all(text, '" + T.ENTITY + "', 1)), [])"
LENGTH = lambda n: f"CASE WHEN {n} < 50 THEN 0.3 WHEN {n} < 150 THEN 0.6 WHEN {n} <= 500 THEN 1.0 ELSE greatest(0.5, 1 - ({n} - 500) / 500.0) END"
WEIGHT = "CASE " + " ".join(f"WHEN contains(lower(coalesce(section, '')), '{k}') THEN {w}" for k, w in T.SECTION_WEIGHTS) + " ELSE 0.5 END"
DIRECTION = f"CASE WHEN {_U} > {_D} + 1 THEN 'up' WHEN {_D} > {_U} + 1 THEN 'down' ELSE 'neutral' END"
TYPE = "CASE " + " ".join(f"WHEN contains(lower(coalesce(section, '')), '{k}') THEN '{v}'" for k, v in T.CHUNK_TYPES) + " ELSE 'other' END"
_DENSITY = f"CASE WHEN {WORDS('text')} = 0 THEN 0.0 ELSE least(1.0, len(list_distinct(list_concat(list_filter(coalesce(entities, []), lambda x: x IS NOT NULL), {_ENT}))) / greatest({WORDS('text')} * 0.05, 1.0)) END"
_STRENGTH = f"CASE WHEN {_A} + {_H} = 0 THEN 0.5 ELSE {_A} / ({_A} + {_H}) END"
_ARR = lambda c: f"len(coalesce({c}, [])) > 0"
_COV = lambda e: f"round(avg(CASE WHEN {e} THEN 1.0 ELSE 0.0 END) * 100 + 1e-9, 1)"
# DuckDB keeps no order in list_distinct: first occurrences by hand
_FIRST8 = f"array_to_string(list_filter(list_transform(regexp_extract_all(text, '{T.ENTITY}', 1), lambda e, i: CASE WHEN list_position(regexp_extract_all(text, '{T.ENTITY}', 1), e) = i THEN e END), lambda x: x IS NOT NULL)[1:8], '|')"

SQL = {
    "token_estimate": f"WITH {ONE} SELECT chunk_key, {TOKENS('text')} AS n_tokens, CAST({LENGTH(TOKENS('text'))} AS DOUBLE) AS length_score FROM one",
    "lexical_stats": f"WITH {ONE} SELECT chunk_key, {_A} AS n_assertions, {_H} AS n_hedges, {DIRECTION} AS direction, len({_ENT}) AS n_entities, coalesce(regexp_matches(rtrim(text), '{T.CITATION_TAIL}'), false) AS ends_with_citation FROM one",
    "confidence_score": f"WITH {ONE} SELECT chunk_key, round(least(1.0, greatest(0.0, 0.25 * CAST({_DENSITY} AS DOUBLE) + 0.30 * CAST({_STRENGTH} AS DOUBLE) + 0.30 * CAST({WEIGHT} AS DOUBLE) + 0.15 * CAST({LENGTH(TOKENS('text'))} AS DOUBLE))), 4) AS confidence FROM one",
    "fallback_tags": f"WITH {ONE} SELECT chunk_key, coalesce(section, '') AS theme, substring(coalesce(text, ''), 1, 150) || '...' AS summary, coalesce({_FIRST8}, '') AS entities, 'What does ' || substring(coalesce(paper_title, ''), 1, 40) || ' report about ' || coalesce(section, '') || '?' AS hyde_question, {TYPE} AS chunk_type FROM one",
    "chunk_ids": f"WITH {ONE} SELECT chunk_key, replace(substring(coalesce(paper_title, ''), 1, 30) || '_' || substring(coalesce(section, ''), 1, 20) || '_' || chunk_index, ' ', '_') AS built_id FROM one",
    "sentence_counts": f"WITH {ONE} SELECT chunk_key, coalesce(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')), 0) AS n_sentences, length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS n_chars FROM one",
    "figure_questions": f"SELECT question_id, coalesce(regexp_matches(lower(question), '{'|'.join(T.FIGURE_WORDS)}'), false) AS is_figure, coalesce(len(list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> ''))), 0) AS n_tokens FROM (SELECT question_id, any_value(question) AS question FROM eval_questions GROUP BY question_id)",
    "json_tags": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) END AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS as_json FROM events",
    "section_histogram": f"WITH {ONE} SELECT substring(coalesce(section, ''), 1, 30) AS section, count(*) AS n FROM one GROUP BY 1 ORDER BY n DESC, section LIMIT 10",
    "corpus_quality": f"WITH {ONE} SELECT count(*) AS n_chunks, CAST(count_if(coalesce(is_figure_chunk, false)) AS BIGINT) AS n_figure, count(DISTINCT paper_title) AS n_papers, round(avg(token_count), 4) AS mean_tokens, median(token_count) AS median_tokens, round(stddev_pop(token_count), 4) AS std_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, round(avg(confidence), 5) AS mean_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence, {_COV(_ARR('entities'))} AS entity_coverage, {_COV(chr(40) + 'coalesce(theme, ' + chr(39) * 2 + ') <> ' + chr(39) * 2 + chr(41))} AS theme_coverage, CAST(count_if({_ARR('consensus_papers')}) AS BIGINT) AS n_consensus, CAST(count_if({_ARR('conflict_chunk_ids')}) AS BIGINT) AS n_conflict FROM one",
    "chunk_type_counts": f"WITH {ONE} SELECT coalesce(chunk_type, 'other') AS chunk_type, count(*) AS n FROM one GROUP BY 1",
    "cache_hit_miss": f"WITH {ONE} SELECT trim(coalesce(theme, '')) <> '' AND chunk_key % 5 <> 0 AS cached, count(*) AS n FROM one GROUP BY 1",
}
