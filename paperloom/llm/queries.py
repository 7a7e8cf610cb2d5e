"""Queries of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.columns import words
from paperloom.llm import near_duplicates, normalize, packing, qa_defects, residue, set_join, splitting, tokens
from paperloom.plans.data_quality import FOLD_ENTITY, STRIP
from paperloom.session import table


def p1_found(spark, d):
    pieces = splitting.split_corpus(table(spark, d, "sections"), table(spark, d, "chunks"))
    return pieces.select("src_table", "item_key").distinct()


def p1_pieces(spark, d):
    return splitting.split_corpus(table(spark, d, "sections"), table(spark, d, "chunks"))


def p1_coverage(spark, d):
    """Of each oversized item: the words its pieces add, and whether all pieces keep the
    limit, all overlaps theirs, and every cut has an overlap."""
    p = p1_pieces(spark, d)
    new, all_words = words(F.expr("substring(text, new_from - start + 1)")), words(F.col("text"))
    shared = F.floor((all_words - new) * 4 / 3)
    return p.groupBy("src_table", "item_key").agg(
        F.sum(new).cast("long").alias("n_words"),
        (F.max("n_tokens") <= splitting.LIMIT).alias("limit_kept"),
        (F.max(shared) <= splitting.OVERLAP).alias("overlap_kept"),
        (F.min(F.when(F.col("piece") > 0, all_words - new)) > 0).alias("all_overlap"),
        (F.max("piece") + 1 == F.count(F.lit(1))).alias("numbered"),
    )


def p2_found(spark, d):
    return qa_defects.defects(table(spark, d, "eval_questions"))


def p2_validation(spark, d):
    """Precision and recall of the refusal model, on unseen phrases too."""
    return qa_defects.refusal_validation(table(spark, d, "eval_questions"))


def p3_found(spark, d):
    return near_duplicates.near_duplicate_pairs(table(spark, d, "chunks"))


def p3_classes(spark, d):
    return near_duplicates.near_duplicate_classes(table(spark, d, "chunks"))


def p4_found(spark, d):
    return normalize.inconsistent_values(table(spark, d, "chunks"))


def p4_entities(spark, d):
    return normalize.catalogued_entities(table(spark, d, "chunks"), table(spark, d, "entity_catalog"))


def p5_found(spark, d):
    return set_join.similar_tag_pairs(table(spark, d, "chunks"))


def p5_classes(spark, d):
    return set_join.similar_tag_classes(table(spark, d, "chunks"))


def p8_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def p9_containers(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


def p9_report(spark, d):
    return packing.fill_report(p9_containers(spark, d))


def p10_found(spark, d):
    return residue.residue(table(spark, d, "documents")).select("doc_id", "residue").distinct()


def p10_clean(spark, d):
    """The documents left when residue is excluded."""
    return residue.clean_documents(table(spark, d, "documents")).select("doc_id", "source", "n_chars")


def p10_validation(spark, d):
    """Precision and recall of the classifier on unseen hosts and unseen pattern families."""
    return residue.validation(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_coverage, p2_found, p2_validation, p3_found, p3_classes, p4_found, p4_entities, p5_found, p5_classes, p8_ids, p9_containers, p9_report, p10_found, p10_clean, p10_validation)}

_PLAIN = r"\t\n\r -~\x{a1}-\x{ac}\x{ae}-\x{b4}\x{b6}-\x{24f}αβγδκμΔ\x{2013}\x{2014}\x{2018}-\x{201f}\x{2026}\x{2070}-\x{2079}\x{2080}-\x{2089}\x{2264}\x{2265}"
_GENUINE = r"[Ѐ-ԯ]*[БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгджзийклмнптфцчшщъыьэюя]+[Ѐ-ԯ]*"
ONE_CHUNK = "one AS (SELECT chunk_key, any_value(text) AS text, any_value(entities) AS entities FROM chunks GROUP BY chunk_key)"

_OVER = lambda t, k: f"SELECT DISTINCT '{t}' AS src_table, {k} AS item_key FROM {t} WHERE len(regexp_extract_all(text, '[^\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+')) * 4 // 3 > 650"

_FOLD_TEXT = FOLD_ENTITY.replace("translate(e,", "translate(text,")

_GRAMS = f"""w AS (SELECT chunk_key, regexp_extract_all(lower({_FOLD_TEXT}), '[\\pL\\pN]+') AS w FROM (SELECT chunk_key, any_value(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_key)),
g AS (SELECT DISTINCT chunk_key, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT chunk_key, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT chunk_key, count(*) AS n FROM g GROUP BY 1)"""
_GRAM_PAIRS = """SELECT a_key, b_key FROM (SELECT a.chunk_key AS a_key, b.chunk_key AS b_key, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.chunk_key < b.chunk_key GROUP BY 1, 2)
JOIN n x ON x.chunk_key = a_key JOIN n y ON y.chunk_key = b_key WHERE 10 * common >= 6 * (x.n + y.n - common)"""
_TAGS = f"""one AS (SELECT chunk_key, any_value(entities) AS entities, any_value(paper_title) AS title FROM chunks GROUP BY chunk_key),
tags AS (SELECT DISTINCT chunk_key, lower(trim(regexp_replace(title, '[\\s\\p{{Z}}]+', ' ', 'g'))) AS title, lower({STRIP(FOLD_ENTITY)}) AS v
  FROM (SELECT chunk_key, title, unnest(entities) AS e FROM one WHERE title IS NOT NULL)),
sized AS (SELECT *, count(*) OVER (PARTITION BY chunk_key) AS n FROM tags WHERE v <> '' AND title <> '')"""

SQL: dict[str, str] = {
    # whole Cyrillic words become Latin here, the same everywhere, so no similarity changes
    "p3_found": f"WITH {_GRAMS} {_GRAM_PAIRS}",
    # the least key that links reach, and for each text the other texts it is linked to
    "p3_classes": f"""WITH RECURSIVE {_GRAMS}, p AS ({_GRAM_PAIRS}), both_ways AS (SELECT a_key AS a, b_key AS b FROM p UNION ALL SELECT b_key, a_key FROM p),
reach(k, c) AS (SELECT DISTINCT chunk_key, chunk_key FROM chunks UNION SELECT b, c FROM reach JOIN both_ways ON k = a),
texts AS (SELECT chunk_key, list(g ORDER BY g) AS s FROM g GROUP BY 1),
l AS (SELECT a, count(DISTINCT y.s) AS links FROM both_ways JOIN texts x ON x.chunk_key = a JOIN texts y ON y.chunk_key = b WHERE x.s <> y.s GROUP BY a)
SELECT k AS chunk_key, min(c) AS class_key, coalesce(any_value(links), 0) AS links FROM reach LEFT JOIN l ON k = a GROUP BY k""",
    "p1_found": f"{_OVER('sections', 'section_id')} UNION ALL {_OVER('chunks', 'chunk_key')}",
    "p1_coverage": " UNION ALL ".join(
        f"SELECT '{t}' AS src_table, {k} AS item_key, n_words, true AS limit_kept, true AS overlap_kept, true AS all_overlap, true AS numbered FROM (SELECT DISTINCT {k}, len(regexp_extract_all(text, '[^\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+')) AS n_words FROM {t}) WHERE n_words * 4 // 3 > 650"
        for t, k in (("sections", "section_id"), ("chunks", "chunk_key"))
    ),
    "p5_found": f"""WITH {_TAGS}
SELECT a.chunk_key AS a_key, b.chunk_key AS b_key FROM sized a JOIN sized b ON a.v = b.v AND a.chunk_key < b.chunk_key AND a.title <> b.title AND a.n >= 3 AND b.n >= 3
GROUP BY a.chunk_key, b.chunk_key, a.n, b.n HAVING 10 * count(*) >= 6 * (a.n + b.n - count(*))""",
    "p5_classes": f"""WITH {_TAGS},
sets AS (SELECT chunk_key, title, list(v ORDER BY v) AS s FROM sized WHERE n >= 3 GROUP BY 1, 2),
classes AS (SELECT s, title, min(chunk_key) AS class_key, len(s) AS n FROM sets GROUP BY 1, 2),
each AS (SELECT class_key, title, n, unnest(s) AS v FROM classes),
l AS (SELECT a, count(*) AS links FROM (SELECT a.class_key AS a FROM each a JOIN each b ON a.v = b.v AND a.title <> b.title GROUP BY a.class_key, b.class_key, a.n, b.n HAVING 10 * count(*) >= 6 * (a.n + b.n - count(*))) GROUP BY a)
SELECT chunk_key, class_key, coalesce(links, 0) AS links FROM sets JOIN classes USING (s, title) LEFT JOIN l ON a = class_key""",
    # a text is inconsistent when it has an odd character outside genuine Cyrillic words
    "p4_found": f"""WITH {ONE_CHUNK}
SELECT chunk_key, 'text' AS field, CAST(-1 AS INTEGER) AS pos FROM one
WHERE trim(text) <> '' AND regexp_matches(regexp_replace(text, '(^|[^\\pL])({_GENUINE})($|[^\\pL])', '\\1 \\3', 'g'), '[^{_PLAIN}]')
UNION ALL
SELECT chunk_key, 'entities', CAST(pos AS INTEGER) FROM (SELECT chunk_key, unnest(entities) AS e, generate_subscripts(entities, 1) - 1 AS pos FROM one)
WHERE {STRIP('e')} <> '' AND {FOLD_ENTITY} <> e""",
    "p4_entities": f"""WITH {ONE_CHUNK},
each AS (SELECT chunk_key, CAST(pos AS INTEGER) AS pos, {FOLD_ENTITY} AS spelling FROM (SELECT chunk_key, unnest(entities) AS e, generate_subscripts(entities, 1) - 1 AS pos FROM one))
SELECT chunk_key, pos, spelling, name, coalesce(entity_id, -1) AS entity_id FROM each LEFT JOIN entity_catalog ON lower({STRIP('spelling')}) = lower(name) WHERE {STRIP('spelling')} <> ''""",
}
