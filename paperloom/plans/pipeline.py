"""Queries of the build pipeline: sections, chunks, tags, the store and token budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunking, history, sections, tagging
from paperloom.operators.evaluation import relevant
from paperloom.operators.graph import linking
from paperloom.plans.text_scoring import ONE, one_chunk
from paperloom.sources.store import latest
from paperloom.session import shared_dir, table
from paperloom.streaming import budget


def document_sections(spark, d):
    """The section state machine over all documents."""
    found = sections.text_sections(table(spark, d, "documents"))
    return found.select("doc_id", "section_no", "name", F.length("text").alias("n_chars"), "is_reference", "is_caption", "figure_id")


def chunk_packing(spark, d):
    return chunking.chunk_sections(table(spark, d, "sections")).drop("text")


def section_headers(spark, d):
    """Header, caption, reference and noise predicates on the sections' names."""
    s = table(spark, d, "sections").select("section_id", "name", "text").dropDuplicates(["section_id"])
    n = F.trim(F.coalesce("name", F.lit("")))
    return s.select("section_id", n.rlike(sections.KNOWN).alias("is_known"), n.rlike(sections.REFERENCES).alias("is_reference"), n.rlike(sections.NOISE).alias("is_noise"), F.regexp_extract(F.coalesce("text", F.lit("")), sections.CAPTION, 1).alias("caption_id"))


def tagged_chunks(spark, d):
    """Tags from the cache of chunks with a theme, rules for the others. A fifth of the cache is
    of older texts, a fifth stands in it twice."""
    c = one_chunk(spark, d)
    cache = c.where("trim(theme) <> ''").select("chunk_id", F.md5(F.when(F.col("chunk_key") % 5 == 0, "older").otherwise(F.coalesce("text", F.lit("")))).alias("text_md5"), *tagging.TAG_COLUMNS, F.lit("model").alias("tag_source"))
    cache = cache.unionByName(cache.join(c.where("chunk_key % 5 = 1").select("chunk_id"), "chunk_id", "left_semi"))
    return tagging.tag(c, cache).groupBy("tag_source", F.coalesce("chunk_type", F.lit("other")).alias("chunk_type")).agg(F.count(F.lit(1)).alias("n"))


def upsert_latest(spark, d):
    """The last delivery of each chunk, and how many there were."""
    rows = table(spark, d, "chunks").select("chunk_key", "chunk_id", "ingested_at")
    n = rows.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("n_deliveries"))
    return latest(rows, "chunk_key", "ingested_at").join(n, "chunk_key").select("chunk_key", "chunk_id", "ingested_at", "n_deliveries")


def multi_key_lookup(spark, d):
    """Each question's relevant ids, in their order, with the chunks that exist."""
    q = table(spark, d, "eval_questions").select("question_id", "relevant_chunk_ids").dropDuplicates(["question_id"])
    ids = q.select("question_id", F.posexplode("relevant_chunk_ids").alias("pos", "chunk_id"))
    return ids.join(one_chunk(spark, d, "chunk_id"), "chunk_id").select("question_id", "pos", "chunk_id", "chunk_key")


def build_summary(spark, d):
    c = one_chunk(spark, d)
    return c.agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.coalesce("is_figure_chunk", F.lit(False))).alias("figure_chunks"), F.count_if(~F.coalesce("is_figure_chunk", F.lit(False))).alias("body_chunks"), F.countDistinct("paper_title").alias("papers"), F.sum(F.size(F.coalesce("conflict_chunk_ids", F.array().cast("array<string>")))).alias("conflicts"))


def golden_pools(spark, d):
    """Chunks fit for questions of each kind."""
    c = one_chunk(spark, d)
    kind, sure = F.col("chunk_type"), F.coalesce(F.col("confidence") > 0.55, F.lit(False))
    agreed = F.size(F.coalesce("consensus_papers", F.array().cast("array<string>"))) > 0
    pools = F.array_compact(F.array(F.when(kind.isin("results", "conclusion", "background") & sure & (F.length("text") > 80), "single"), F.when(F.col("is_figure_chunk"), "figure"), F.when(agreed & kind.isin("results", "conclusion") & sure, "consensus")))
    return c.select(F.explode(pools).alias("pool")).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


def _paper_chunks(spark, d):
    """(entity, paper_id, p): for each entity of more than two characters and each of its
    papers, p.chunk_key of the chunk that comes first by a hash: sampling without chance."""
    c = one_chunk(spark, d, "paper_id", "entities").select("chunk_key", "paper_id", F.explode("entities").alias("e")).where("length(e) > 2").select("chunk_key", "paper_id", F.lower("e").alias("entity")).distinct()
    h = F.md5(F.concat_ws("|", "entity", F.col("chunk_key").cast("string")))
    return c.groupBy("entity", "paper_id").agg(F.min(F.struct(h.alias("h"), "chunk_key")).alias("p"))


def cross_paper_members(spark, d):
    """All pairs of papers of each entity in several papers, with one chunk of each paper, as
    their members: any two rows of one entity are a pair."""
    return linking(_paper_chunks(spark, d), "paper_id").select("entity", "paper_id", F.col("p.chunk_key").alias("chunk_key"))


def cross_paper_pairs(spark, d):
    """For each entity in several papers one pair: the chunks of the two papers whose chunks
    come first by the hash. cross_paper_members holds all pairs."""
    best = _paper_chunks(spark, d)
    first = best.groupBy("entity").agg(F.min(F.struct("p", "paper_id")).alias("a"))
    second = best.join(first, "entity").where(F.col("paper_id") != F.col("a.paper_id")).groupBy("entity", "a").agg(F.min(F.struct("p", "paper_id")).alias("b"))
    return second.select("entity", F.col("a.p.chunk_key").alias("chunk_a"), F.col("b.p.chunk_key").alias("chunk_b"))


def token_budget_window(spark, d):
    """The value used in the 60 seconds before each event of its type."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return budget.trailing_sum(e, "event_type", "ts", "value").select("event_id", F.round(F.col("trailing") + 1e-9, 4).alias("trailing"))


def token_budget_stream(spark, d):
    """The same budget over a stream of the events: tumbling minutes. What is there at the
    start is one batch, so nothing in it is late; state is dropped two hours behind."""
    static = table(spark, d, "events")
    folder, pattern = _folder(spark, d, "events")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", pattern).parquet(folder)
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    result = budget.windowed_usage(stream.select("event_type", "ts", "value"), "event_type", "ts", "value", late="2 hours")
    return budget.run_once(result, f"{at}/out", f"{at}/state", ["window_start", "event_type"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round(F.col("total") + 1e-9, 4).alias("total"))


def _folder(spark, d, name):
    """Where a stream finds a table that is one file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return (f"{d}/{name}.parquet", "*.parquet") if is_folder else (d, f"{name}.parquet")


def last_messages(spark, d):
    """The last six events of each user, as messages of a conversation; every ninth stands for
    a system message, which is none of them."""
    e = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 9 == 0, "system").otherwise(F.col("event_type")).alias("role"), F.col("props").alias("text"))
    return history.last_messages(e).select("conv_id", "turn", "role")


def difficulty_counts(spark, d):
    q = table(spark, d, "eval_questions").select("question_id", "difficulty").dropDuplicates(["question_id"])
    return q.groupBy(F.lower(F.trim(F.coalesce("difficulty", F.lit("")))).alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


def relevant_papers(spark, d):
    """Questions by the number of distinct papers they need."""
    q = table(spark, d, "eval_questions").dropDuplicates(["question_id"]).withColumnRenamed("question_id", "query")
    return relevant(q, "relevant_papers", "paper").groupBy("query").agg(F.count(F.lit(1)).alias("n_papers")).groupBy("n_papers").agg(F.count(F.lit(1)).alias("n_questions"))


QUERIES = {
    f.__name__: f
    for f in (document_sections, chunk_packing, section_headers, tagged_chunks, upsert_latest, multi_key_lookup, build_summary, golden_pools, cross_paper_pairs, cross_paper_members, token_budget_window, token_budget_stream, last_messages, difficulty_counts, relevant_papers)
}

_TYPE = T.CHUNK_TYPES
_FALLBACK_TYPE = "CASE " + " ".join(f"WHEN contains(lower(coalesce(section, '')), '{k}') THEN '{v}'" for k, v in _TYPE) + " ELSE 'other' END"
_N = "trim(coalesce(name, ''))"
SQL = {
    "section_headers": f"SELECT section_id, regexp_matches({_N}, '{sections.KNOWN}') AS is_known, regexp_matches({_N}, '{sections.REFERENCES}') AS is_reference, regexp_matches({_N}, '{sections.NOISE}') AS is_noise, regexp_extract(coalesce(text, ''), '{sections.CAPTION}', 1) AS caption_id FROM (SELECT section_id, any_value(name) AS name, any_value(text) AS text FROM sections GROUP BY 1)",
    "tagged_chunks": f"WITH {ONE}, t AS (SELECT CASE WHEN trim(coalesce(theme, '')) <> '' AND chunk_key % 5 <> 0 THEN 'model' ELSE 'fallback' END AS tag_source, CASE WHEN trim(coalesce(theme, '')) <> '' AND chunk_key % 5 <> 0 THEN coalesce(chunk_type, 'other') ELSE {_FALLBACK_TYPE} END AS chunk_type FROM one) SELECT tag_source, chunk_type, count(*) AS n FROM t GROUP BY 1, 2",
    "upsert_latest": "SELECT chunk_key, any_value(chunk_id) AS chunk_id, max(ingested_at) AS ingested_at, count(*) AS n_deliveries FROM chunks GROUP BY chunk_key",
    "multi_key_lookup": f"WITH {ONE}, g AS (SELECT question_id, any_value(relevant_chunk_ids) AS ids FROM eval_questions GROUP BY 1), r AS (SELECT question_id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS pos, unnest(ids) AS chunk_id FROM g) SELECT question_id, pos, chunk_id, chunk_key FROM r JOIN one USING (chunk_id)",
    "build_summary": f"WITH {ONE} SELECT count(*) AS total_chunks, CAST(count_if(coalesce(is_figure_chunk, false)) AS BIGINT) AS figure_chunks, CAST(count_if(NOT coalesce(is_figure_chunk, false)) AS BIGINT) AS body_chunks, count(DISTINCT paper_title) AS papers, CAST(sum(len(coalesce(conflict_chunk_ids, []))) AS BIGINT) AS conflicts FROM one",
    "golden_pools": f"WITH {ONE}, p AS (SELECT 'single' AS pool FROM one WHERE chunk_type IN ('results', 'conclusion', 'background') AND confidence > 0.55 AND length(text) > 80 UNION ALL SELECT 'figure' FROM one WHERE is_figure_chunk UNION ALL SELECT 'consensus' FROM one WHERE len(consensus_papers) > 0 AND chunk_type IN ('results', 'conclusion') AND confidence > 0.55) SELECT pool, count(*) AS n FROM p GROUP BY 1",
    "cross_paper_pairs": f"WITH {ONE}, c AS (SELECT DISTINCT chunk_key, paper_id, lower(e) AS entity FROM (SELECT chunk_key, paper_id, unnest(entities) AS e FROM one) WHERE length(e) > 2), h AS (SELECT *, md5(entity || '|' || chunk_key) AS h FROM c), b AS (SELECT entity, paper_id, arg_min(chunk_key, h) AS chunk_key, min(h) AS h FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY h) AS n FROM b) SELECT x.entity, x.chunk_key AS chunk_a, y.chunk_key AS chunk_b FROM r x JOIN r y ON x.entity = y.entity AND x.n = 1 AND y.n = 2",
    "cross_paper_members": f"WITH {ONE}, c AS (SELECT DISTINCT chunk_key, paper_id, lower(e) AS entity FROM (SELECT chunk_key, paper_id, unnest(entities) AS e FROM one) WHERE length(e) > 2), b AS (SELECT entity, paper_id, arg_min(chunk_key, md5(entity || '|' || chunk_key)) AS chunk_key FROM c GROUP BY 1, 2) SELECT entity, paper_id, chunk_key FROM b WHERE entity IN (SELECT entity FROM b GROUP BY entity HAVING count(DISTINCT paper_id) > 1)",
    "token_budget_window": "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) + 1e-9, 4) AS trailing FROM events WHERE ts IS NOT NULL",
    "token_budget_stream": "SELECT date_trunc('minute', ts) AS window_start, event_type, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM events GROUP BY 1, 2",
    "last_messages": "SELECT user_id AS conv_id, event_id AS turn, event_type AS role FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id % 9 <> 0) WHERE n <= 6",
    "difficulty_counts": "SELECT lower(trim(coalesce(difficulty, ''))) AS difficulty, count(*) AS n FROM (SELECT question_id, any_value(difficulty) AS difficulty FROM eval_questions GROUP BY 1) GROUP BY 1",
    "relevant_papers": "WITH g AS (SELECT question_id, any_value(relevant_papers) AS papers FROM eval_questions GROUP BY 1), p AS (SELECT DISTINCT question_id, trim(p) AS paper FROM (SELECT question_id, unnest(papers) AS p FROM g) WHERE trim(p) <> ''), n AS (SELECT question_id, count(*) AS n_papers FROM p GROUP BY 1) SELECT n_papers, count(*) AS n_questions FROM n GROUP BY 1",
}
