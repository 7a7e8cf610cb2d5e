"""From text lines to sections: reading order, headers, captions, noise and references."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names of sections, of sections without content, and captions.
SECTION_NAMES = r"abstract|background|introduction|methods?|materials?\s+and\s+methods?|results?|discussion|conclusions?|acknowledgements?|references?|supplementary|appendix|ethics|data\s+availability|author\s+contributions?|competing\s+interests?|funding|experimental\s+procedures?|statistical\s+analysis"
NOISE_NAMES = r"additional\s+(?:files?|information|data|material|supplementary)|supplementary\s+(?:files?|data|material|information|methods?|tables?|figures?)|competing\s+interests?|authors?\s+contributions?|funding\s+information|data\s+availability|ethics\s+(?:approval|statement|declaration)|consent\s+to\s+publish|acknowledgements?|abbreviations?|publisher.?s?\s+note|peer\s+review"
KNOWN = rf"(?i)^(?:{SECTION_NAMES})[\s:.0-9]*$"
NOISE = rf"(?i)^(?:{NOISE_NAMES})\s*[:.0-9]*$"
REFERENCES = r"(?i)^references?[\s:.]*$"
CAPTION = r"(?i)^(Fig(?:ure)?\.?\s*[0-9]+[A-Za-z]?|Table\s*[0-9]+)[.:\s–-]"
NUMBERED = r"^[0-9]+[.\s]+[A-Z][a-z]"
FIRST_NAME = "PREAMBLE"
SHORT_LINE = 20

SECTION_SCHEMA = "section_no int, name string, text string, page_start int, is_reference boolean, is_caption boolean, figure_id string"


@dataclass
class Line:
    text: str
    header: bool = False
    page: int = 1


def reading_order(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_no, x0, x1, y0, page_width) with ``place``, their place on
    the page: a page with more than three lines ending left of its middle and more than
    three starting right of it has two columns, read left then right, top down."""
    page = Window.partitionBy("doc_id", "page")
    middle = F.col("page_width") / 2
    two = (F.count_if(F.col("x1") < 1.1 * middle).over(page) > 3) & (F.count_if(F.col("x0") > 0.9 * middle).over(page) > 3)
    marked = lines.withColumn("two_columns", two)
    column = F.when(F.col("two_columns"), (F.col("x0") >= middle).cast("int")).otherwise(0)
    height = F.when(F.col("two_columns"), F.col("y0")).otherwise(0.0)
    return marked.withColumn("place", F.row_number().over(page.orderBy(column, height, "line_no")))


def usable_lines(lines: DataFrame) -> DataFrame:
    """Lines of three characters or more, trimmed; a missing font size is 10."""
    return lines.withColumn("text", F.trim("text")).where(F.length("text") >= 3).withColumn("font_size", F.coalesce("font_size", F.lit(10.0)))


def with_headers(lines: DataFrame) -> DataFrame:
    """lines (doc_id, text, font_size, is_bold, page, line_no) with ``is_header``.

    The body's size is a document's most frequent size above 6, the first seen of equals,
    10 without any."""
    sizes = lines.where("font_size > 6").groupBy("doc_id", F.round("font_size", 1).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "line_no")).alias("first"))
    body = sizes.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("n"), "first")).alias("body"))
    t = F.trim("text")
    marked = (F.col("font_size") > 1.05 * F.coalesce("body", F.lit(10.0))) | F.coalesce("is_bold", F.lit(False))
    header = (F.length(t) <= 120) & (t.rlike(KNOWN) | ((F.length(t) < 80) & (t.rlike(NUMBERED) | (marked & t.rlike(r"^\p{Lu}")))))
    return lines.join(body, "doc_id", "left").withColumn("is_header", F.coalesce(header, F.lit(False))).drop("body")


def title_of(lines: DataFrame) -> DataFrame:
    """(doc_id, title): the first of the largest lines of page 1 of 11 to 299 characters."""
    fit = lines.where((F.col("page") == 1) & F.length(F.trim("text")).between(11, 299))
    return fit.groupBy("doc_id").agg(F.max_by(F.trim("text"), F.struct("font_size", -F.col("line_no"))).alias("title"))


def abstract_of(sections: DataFrame) -> DataFrame:
    """(doc_id, abstract): the first section whose name has "abstract" in it."""
    return sections.where(F.lower("name").contains("abstract")).groupBy("doc_id").agg(F.min_by("text", "section_no").alias("abstract"))


_CAPTION, _REFERENCES, _NOISE = re.compile(CAPTION), re.compile(REFERENCES), re.compile(NOISE)


def fold_lines(lines: Iterable[Line], references: bool = False, captions: bool = True, absorb_noise: bool = True) -> Iterator[tuple[str, str, int, bool, bool, str]]:
    """(name, text, page, is_reference, is_caption, figure_id) of a document's lines in order.

    A state machine over the lines. A caption runs on over long lines and interrupts its
    section, which resumes behind it; a noise section drops everything up to the
    references or, unless ``absorb_noise``, the next header; the references drop
    everything behind them unless they are wanted.
    """
    name, page, is_reference, body = FIRST_NAME, 1, False, []
    caption: list[str] | None = None
    figure, caption_page = "", 1
    state = "body"

    def section():
        text = "\n".join(body).strip()
        if text:
            yield name, text, page, is_reference, False, ""

    def close_caption():
        nonlocal caption
        if caption is not None and captions:
            yield f"Caption: {figure}", " ".join(caption), caption_page, False, True, figure
        caption = None

    for line in lines:
        text = line.text.strip()
        if not text:
            continue
        if _REFERENCES.match(text):
            yield from section()
            yield from close_caption()
            state, name, page, is_reference, body = "references", text, line.page, True, []
            continue
        if state == "references":
            if references:
                body.append(text)
            continue
        if line.header and _NOISE.match(text):
            yield from section()
            yield from close_caption()
            state, body = "noise", []
            continue
        if state == "noise":
            if absorb_noise or not line.header:
                continue
            state, name, page, body = "body", text, line.page, []
            continue
        if found := _CAPTION.match(text):
            yield from close_caption()
            caption, figure, caption_page = [text], found[1].strip(), line.page
            continue
        if caption is not None:
            if not line.header and len(text) >= SHORT_LINE:
                caption.append(text)
                continue
            yield from close_caption()
        if line.header:
            yield from section()
            name, page, body = text, line.page, []
        else:
            body.append(text)
    yield from close_caption()
    yield from section()


def text_sections(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Sections of documents whose text is one column: lines without fonts, so headers are
    the known and the numbered ones. Null and blank texts have none."""
    known, numbered = re.compile(KNOWN), re.compile(NUMBERED)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = (p.strip() for p in re.split(r"[\n\r  ]+", t or ""))
                lines = (Line(p, len(p) <= 120 and bool(known.match(p) or (len(p) < 80 and numbered.match(p)))) for p in parts)
                rows += [(k, no, *s) for no, s in enumerate(fold_lines(lines, **options))]
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [key, "section_no", "name", "text", "page_start", "is_reference", "is_caption", "figure_id"])

    return documents.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, {SECTION_SCHEMA}")


def line_sections(lines: DataFrame, **options) -> DataFrame:
    """Sections of text lines (doc_id, page, place, text, is_header): one group a document."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["page"], r["place"]))
        found = list(fold_lines((Line(r["text"], r["is_header"], r["page"]) for r in rows), **options))
        out = [(rows[0]["doc_id"], no, *s) for no, s in enumerate(found)]
        columns = list(zip(*out)) or [()] * 8
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(["doc_id", "section_no", "name", "text", "page_start", "is_reference", "is_caption", "figure_id"], columns, types)})

    return lines.select(F.col("doc_id").cast("long"), "page", "place", "text", "is_header").groupBy("doc_id").applyInArrow(run, f"doc_id long, {SECTION_SCHEMA}")
