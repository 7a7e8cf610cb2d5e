"""Text scalars of the pipeline as column expressions: sizes, lexicons, types, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.columns import words

# Word lists, weights and patterns of the scoring rules.
ASSERTION = "significantly demonstrate show showed shows found confirm reveal indicate suggest establish prove observe identify detect measure quantify result resulted results conclude determine increase decrease inhibit activate".split()
HEDGE = "may might could possibly presumably likely perhaps unclear unknown potentially speculate hypothesize appear appears appeared seem seems seemed".split()
UP_STEMS = "increase upregulat activat induc enhanc promot stimulat".split()
DOWN_STEMS = "decrease downregulat inhibit suppress reduc prevent block".split()
SECTION_WEIGHTS = [("results", 1.0), ("conclusion", 0.95), ("discussion", 0.85), ("abstract", 0.80), ("background", 0.55), ("introduction", 0.55), ("methods", 0.45), ("references", 0.10), ("preamble", 0.30), ("other", 0.50)]
FIGURE_WORDS = "figure fig table shown panel quantitative measured graph plot chart illustrate depicted".split()
ENTITY = r"(?:^|[^\p{L}\p{N}_])([A-Z][A-Z0-9δαβγ\-]{2,})"
CITATION_TAIL = r"(\[\s*[0-9]+(?:\s*[,–-]\s*[0-9]+)*\s*\]|\(\s*[A-Z][a-z]+(?:\s+et\s+al\.?|\s+and\s+[A-Z][a-z]+)?\s*,\s*[0-9]{4}\s*\))[.,:;]?\s*$"
CHUNK_TYPES = [("method", "methods"), ("result", "results"), ("discuss", "conclusion"), ("conclus", "conclusion"), ("abstract", "background"), ("background", "background"), ("introduc", "background")]

WORD_PATTERN = lambda ws: r"(?i)\b(" + "|".join(ws) + r")\b"
STEM_PATTERN = lambda ws: r"(?i)\b(" + "|".join(ws) + r")"


def token_estimate(text: Column) -> Column:
    """Words x 4/3 rounded down, 1 at least; 1 for null."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(words(text), F.lit(0)) * 4 / 3).cast("int"))


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def assertion_strength(text: Column) -> Column:
    a, h = count_matches(text, WORD_PATTERN(ASSERTION)), count_matches(text, WORD_PATTERN(HEDGE))
    return F.when(a + h == 0, F.lit(0.5)).otherwise(a / (a + h))


def direction(text: Column) -> Column:
    """up or down with a lead of two stems at least, otherwise neutral."""
    up, down = count_matches(text, STEM_PATTERN(UP_STEMS)), count_matches(text, STEM_PATTERN(DOWN_STEMS))
    return F.when(up > down + 1, "up").when(down > up + 1, "down").otherwise("neutral")


def text_entities(text: Column) -> Column:
    """Distinct regex entities in order of first occurrence."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1))), F.array().cast("array<string>"))


def ends_with_citation(text: Column) -> Column:
    return F.coalesce(F.rtrim(text).rlike(CITATION_TAIL), F.lit(False))


def section_weight(section: Column) -> Column:
    """Weight of the first key, in order, that the section's name contains."""
    out = None
    for key, weight in SECTION_WEIGHTS:
        hit = F.lower(section).contains(key)
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return out.otherwise(0.5)


def length_score(tokens: Column) -> Column:
    return F.when(tokens < 50, 0.3).when(tokens < 150, 0.6).when(tokens <= 500, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - (tokens - 500) / 500))


def entity_density(text: Column, entities: Column) -> Column:
    """Tagged and found entities against a twentieth of the words, 1 at most."""
    tagged = F.coalesce(F.filter(entities, lambda e: e.isNotNull()), F.array().cast("array<string>"))
    n, w = F.size(F.array_union(tagged, text_entities(text))), F.coalesce(words(text), F.lit(0))
    return F.when(w == 0, 0.0).otherwise(F.least(F.lit(1.0), n / F.greatest(w * 0.05, F.lit(1.0))))


def confidence(text: Column, section: Column, tokens: Column, entities: Column) -> Column:
    total = 0.25 * entity_density(text, entities) + 0.30 * assertion_strength(text) + 0.30 * section_weight(section) + 0.15 * length_score(tokens)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)


def chunk_type(section: Column) -> Column:
    out = None
    for part, kind in CHUNK_TYPES:
        hit = F.lower(section).contains(part)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def chunk_id(title: Column, part: Column, number: Column, part_length: int = 20) -> Column:
    return F.translate(F.concat_ws("_", F.substring(title, 1, 30), F.substring(part, 1, part_length), number.cast("string")), " ", "_")


def query_tokens(question: Column) -> Column:
    """The distinct lower-cased words, signs kept."""
    return F.array_distinct(F.filter(F.split(F.lower(question), r"\s+"), lambda t: t != ""))


def is_figure_query(question: Column) -> Column:
    return F.coalesce(F.lower(question).rlike("|".join(FIGURE_WORDS)), F.lit(False))


def split_sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences: cuts behind . ! ? and blanks."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lenient_json(raw: Column, schema: str) -> Column:
    """JSON with code fences or words around it; null fields where nothing parses."""
    clean = F.trim(F.regexp_replace(raw, r"```(?:json)?", ""))
    inner = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    valid = F.get_json_object(clean, "$").isNotNull()
    return F.from_json(F.when(valid, clean).when(inner != "", inner), schema)


def rich_text(theme: Column, summary: Column, entities: Column, section: Column) -> Column:
    """What the keyword index sees; its terms are lower-cased."""
    return F.concat_ws(" ", theme, summary, F.array_join(F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: e.isNotNull()), " "), section)
