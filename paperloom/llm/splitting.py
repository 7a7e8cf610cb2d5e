"""Splitting oversized items at natural boundaries (problem 1).

Content-defined: a rolling hash over a few words marks landmarks, and a cut is the natural
boundary nearest to a landmark, within a least and a greatest size. A landmark depends on
the words around it alone, so after an edit the cuts fall into step again and only
neighbouring pieces change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.columns import words
from paperloom.llm import _vec as V

LIMIT, OVERLAP = 650, 50
#: Words that the rolling hash sees, and the mean distance of landmarks in words.
WINDOW, SPACING = 6, 32
#: A rest of fewer words than this is avoided where a boundary allows it.
LEAST_REST = 60
_LINE_ENDS = [ord(c) for c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "]
_ENDERS = [ord(c) for c in ".!?…。！？؟।"]
_CLOSERS = [ord(c) for c in "\"'”’»)]}*_"]
_NOT_ENDS = "Fig. Figs. fig. figs. al. e.g. i.e. vs. cf. ca. Dr. Prof. No. no. Nr. Eq. Ref. Refs. approx. St. bzw. z.B. d.h. p.ej. Abb.".split()


def most_words(tokens: int) -> int:
    """The most words whose estimate, words x 4/3 rounded down, is within ``tokens``."""
    return (3 * tokens + 2) // 4


def boundaries(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each word: 3 paragraph, 2 line or list item,
    1 sentence, 0 none."""
    n = len(starts)
    level = np.zeros(n, np.int8)
    if n < 2:
        return level
    breaks = np.concatenate([[0], np.cumsum(np.isin(buf, _LINE_ENDS) & ~((buf == 10) & (np.concatenate([[0], buf[:-1]]) == 13)))])
    in_gap = breaks[starts[1:]] - breaks[ends[:-1]]
    paragraphs = np.concatenate([[0], np.cumsum((buf == 0x2029) | (buf == 0x0C))])
    last = buf[ends[:-1] - 1]
    for _ in range(2):  # closing signs behind the end of a sentence
        closing = np.isin(last, _CLOSERS)
        at = np.maximum(ends[:-1] - 2 - _, starts[:-1])
        last = np.where(closing, buf[at], last)
    first = buf[starts[1:]]
    lower = _lower_table()[first]
    sentence = np.isin(last, _ENDERS) & ~lower
    spans = V.span_hashes(buf, starts, ends)[:-1]
    initial = (ends - starts)[:-1] == 2  # "J." is no sentence
    sentence &= ~(np.isin(spans, _not_ends()) | (initial & (buf[ends[:-1] - 1] == ord("."))))
    level[1:] = np.where((in_gap > 1) | (paragraphs[starts[1:]] > paragraphs[ends[:-1]]), 3, np.where(in_gap == 1, 2, np.where(sentence, 1, 0)))
    return level


_cache: dict[str, np.ndarray] = {}


def _lower_table() -> np.ndarray:
    if "lower" not in _cache:
        _cache["lower"] = np.fromiter((chr(c).islower() for c in range(0x110000)), bool, 0x110000)
    return _cache["lower"]


def _not_ends() -> np.ndarray:
    if "not" not in _cache:
        out = []
        for w in _NOT_ENDS:
            buf, _ = V.codes([w])
            out.append(V.span_hashes(buf, np.array([0]), np.array([len(w)]))[0])
        _cache["not"] = np.array(out, np.uint64)
    return _cache["not"]


def cuts(levels: np.ndarray, marks: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces of one item as (first word, first word that is new, word behind the last).

    levels: strength of the boundary before each word; marks: words that a landmark
    precedes. Without a natural boundary in reach the cut is the landmark itself, and
    without a landmark the last natural boundary in reach, or the greatest size.
    """
    n, most, shared = len(levels), most_words(limit), most_words(overlap) if overlap > 0 else 0
    shared = min(shared, most // 2)
    natural = np.flatnonzero(levels > 0)
    out, at, begin = [], 0, 0
    while n - begin > most:
        hi = begin + most
        lo = min(hi, max(at + 1, begin + most // 2))
        if n - hi < LEAST_REST and n - LEAST_REST > lo:
            hi = n - LEAST_REST
        near = natural[np.searchsorted(natural, lo) : np.searchsorted(natural, hi, "right")]
        here = marks[np.searchsorted(marks, lo) : np.searchsorted(marks, hi, "right")]
        if len(near) and len(here):
            cut = int(near[np.argmin(np.abs(near - here[0]))])
        elif len(near):
            cut = int(near[-1])
        else:
            wide = natural[np.searchsorted(natural, at + 1) : np.searchsorted(natural, hi, "right")]
            cut = int(wide[-1]) if len(wide) else int(here[0]) if len(here) else hi
        out.append((begin, at, cut))
        inner = natural[np.searchsorted(natural, max(at + 1, cut - shared)) : np.searchsorted(natural, cut)]
        if len(inner):
            begin = int(inner[0])
        else:  # the last sentence alone is above the overlap: its last words
            begin = max(at + 1, cut - shared) if shared else cut
        at = cut
    out.append((begin, at, n))
    return out


def split_texts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int, int, int]]]:
    """For each text its pieces (first character, first new one, end, words)."""
    buf, offsets = V.codes(texts)
    starts, ends = V.runs(~(V.space_table()[buf] | (buf == 0)))
    level = boundaries(buf, starts, ends)
    h = V.span_hashes(buf, starts, ends)
    rolled = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for back in range(1, WINDOW + 1):  # the words before a place
            rolled[back:] = rolled[back:] + V.mix(h[:-back] + np.uint64(back)) if len(h) > back else rolled[back:]
    marked = (V.mix(rolled) & np.uint64(SPACING - 1)) == 0
    first = np.searchsorted(starts, offsets)
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if a == b:
            out.append([])
            continue
        lv = level[a:b].copy()
        lv[0] = 0
        mk = np.flatnonzero(marked[a:b])
        pieces = cuts(lv, mk[mk >= WINDOW], limit, overlap)
        out.append([(int(starts[a + p] - offsets[i]), int(starts[a + q] - offsets[i]), int(ends[a + r - 1] - offsets[i]), int(r - p)) for p, q, r in pieces])
    return out


def oversized(items: DataFrame, key: str, text: str, limit: int = LIMIT) -> DataFrame:
    """(key, text) of the items whose estimate is above the limit; nothing else is read."""
    rows = items.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL")
    # a text above the limit has at least so many characters: the cheap test goes first
    return rows.where((F.length("text") > 2 * most_words(limit)) & (words(F.col("text")) > most_words(limit)))


def split_oversized(items: DataFrame, key: str = "key", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_key, piece, n_tokens, start, new_from, end, text) of each oversized item.

    Pieces are numbered from 0 in order, each within the limit; ``text`` is characters
    start to end of the item, of which those before new_from repeat the end of the piece
    before, at most ``overlap`` tokens. Together the pieces cover every word. Items
    within the limit, null, empty and blank ones among them, give no rows; rows that
    repeat a key with the same text give the same pieces once. Empty tables give none.
    """

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in V.slices(texts):  # a batch of long texts is worked on in parts
                columns: list[list] = [[], [], [], [], [], [], []]
                for k, t, pieces in zip(keys[a:b], texts[a:b], split_texts(texts[a:b], limit, overlap)):
                    for no, (start, new, end, n) in enumerate(pieces):
                        for c, v in zip(columns, (k, no, n * 4 // 3, start, new, end, t[start:end])):
                            c.append(v)
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item_key", "piece", "n_tokens", "start", "new_from", "end", "text"])

    rows = oversized(items, key, text, limit).dropDuplicates(["key", "text"])
    return rows.mapInArrow(run, "item_key long, piece int, n_tokens int, start int, new_from int, end int, text string")


def split_corpus(sections: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the oversized sections and chunks, with their table's name."""
    parts = [
        split_oversized(df, key, "text", limit, overlap).select(F.lit(name).alias("src_table"), "*")
        for name, df, key in (("sections", sections, "section_id"), ("chunks", chunks, "chunk_key"))
    ]
    return parts[0].unionByName(parts[1])
