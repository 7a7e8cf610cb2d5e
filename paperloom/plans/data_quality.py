"""Queries of problems 6 (orphan references) and 7 (a few keys holding most records)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.consistent import CYRILLIC_IN_LATIN_WORDS, CYRILLIC_LOOKALIKES, GREEK_IN_LATIN_WORDS, GREEK_LOOKALIKES
from paperloom.operators import orphans, skew
from paperloom.session import table


def p6_found(spark, d):
    return orphans.retrieval_orphans(table(spark, d, "eval_questions"), table(spark, d, "chunks"), table(spark, d, "chunk_deletions"))


def p6_counts(spark, d):
    return orphans.orphan_counts(p6_found(spark, d))


def p7_found(spark, d):
    return skew.frequent_keys(table(spark, d, "chunks"))


def p7_statistics(spark, d):
    return skew.key_statistics(table(spark, d, "chunks")).withColumn("mean_confidence", F.round(F.col("mean_confidence") + 1e-9, 6))


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts, "p7_found": p7_found, "p7_statistics": p7_statistics}

BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
STRIP = lambda c: f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"

ORPHANS = f"""
refs AS (
  SELECT DISTINCT src_table, src_key, {STRIP('raw')} AS ref_id, tm FROM (
    SELECT 'eval_questions' AS src_table, question_id AS src_key, unnest(relevant_chunk_ids) AS raw, created_at AS tm FROM eval_questions
    UNION ALL
    SELECT 'chunks', chunk_key, unnest(conflict_chunk_ids), linked_at FROM chunks) WHERE raw IS NOT NULL),
known AS (SELECT chunk_id, min(ingested_at) AS arrived_at FROM chunks GROUP BY chunk_id),
gone AS (SELECT chunk_id, min(deleted_at) AS deleted_at FROM chunk_deletions GROUP BY chunk_id),
found AS (
  SELECT src_table, src_key, ref_id,
    CASE WHEN known.chunk_id IS NULL THEN 'missing' WHEN deleted_at <= tm THEN 'deleted' WHEN arrived_at > tm THEN 'late' END AS kind,
    strftime(tm, '%Y-%m') AS period
  FROM refs LEFT JOIN known ON ref_id = known.chunk_id LEFT JOIN gone ON ref_id = gone.chunk_id WHERE ref_id <> '')
"""

_lookalikes = CYRILLIC_LOOKALIKES | CYRILLIC_IN_LATIN_WORDS | GREEK_IN_LATIN_WORDS | GREEK_LOOKALIKES
_pairs = [(a, b) for a, b in _lookalikes.items()]
_pairs += [(chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F) if chr(c) != "＇"]
_pairs += [(c, " ") for c in "              　"] + [("‐", "-"), ("‑", "-"), ("−", "-"), ("µ", "μ")]
_folded = f"translate(e, '{''.join(a for a, _ in _pairs)}', '{''.join(b for _, b in _pairs)}')"
_folded = f"regexp_replace({_folded}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
for _a, _b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
    _folded = f"replace({_folded}, '{_a}', '{_b}')"
#: Consistent form of an entity in SQL, for the characters that occur.
FOLD_ENTITY = f"nfc_normalize({_folded})"

KEYS = f"""
one AS (SELECT chunk_key, any_value(theme) AS theme, any_value(entities) AS entities, max(confidence) AS confidence FROM chunks GROUP BY chunk_key),
tags AS (
  SELECT DISTINCT chunk_key, confidence, field, lower({STRIP('k')}) AS key_value FROM (
    SELECT chunk_key, confidence, 'theme' AS field, theme AS k FROM one
    UNION ALL
    SELECT chunk_key, confidence, 'entity', {FOLD_ENTITY} FROM (SELECT chunk_key, confidence, unnest(entities) AS e FROM one)) WHERE k IS NOT NULL),
stats AS (SELECT field, key_value, count(*) AS n_chunks, avg(confidence) AS mean_confidence FROM tags WHERE key_value <> '' GROUP BY field, key_value)
"""

SQL = {
    "p6_found": f"WITH {ORPHANS} SELECT DISTINCT * FROM found WHERE kind IS NOT NULL",
    "p6_counts": f"WITH {ORPHANS} SELECT src_table, period, kind, count(*) AS n_references, count(DISTINCT src_key) AS n_sources FROM (SELECT DISTINCT * FROM found) WHERE kind IS NOT NULL GROUP BY src_table, period, kind",
    "p7_found": f"WITH {KEYS} SELECT field, key_value FROM stats WHERE n_chunks >= 0.04 * (SELECT count(*) FROM one)",
    "p7_statistics": f"WITH {KEYS} SELECT field, key_value, n_chunks, round(mean_confidence + 1e-9, 6) AS mean_confidence FROM stats",
}
