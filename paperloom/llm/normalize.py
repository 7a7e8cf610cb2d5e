"""Visually identical text with different characters (problem 4).

A transducer, compiled once from the tables of :mod:`paperloom.functions.consistent`,
rewrites a text in one pass by longest match over grapheme clusters: a base letter with
all marks (and invisible characters) behind it is one unit.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import consistent as C
from paperloom.llm import _vec as V

_MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿"


class Transducer:
    """Longest-match rewriting of clusters, with a conflict-checked table.

    ``table`` maps sequences of characters to what replaces them. Building it fails with
    :class:`~paperloom.functions.consistent.MappingConflict` if two rules disagree or
    a target contains something that is itself rewritten, so a second pass never changes
    what the first one wrote.
    """

    def __init__(self, in_word: bool):
        self.table: dict[str, str] = {}
        singles = dict(C.rules())
        if in_word:
            extra = C.CYRILLIC_LOOKALIKES | C.CYRILLIC_IN_LATIN_WORDS | C.GREEK_IN_LATIN_WORDS
            singles = {a: "".join(extra.get(c, c) for c in b) for a, b in singles.items()} | extra
        for source, target in singles.items():
            self._add(source, target)
        bases: dict[str, list[str]] = {}
        for source, target in singles.items():
            if len(target) == 1 and target.isalpha():
                bases.setdefault(target, []).append(source)
        for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *(range(0x400, 0x460) if not in_word else ())):
            whole = chr(code)
            parts = unicodedata.normalize("NFD", whole)
            if len(parts) > 1 and whole not in self.table:
                self._add(parts, whole)
                for alike in bases.get(parts[0], ()):  # a look-alike base below the marks
                    self._add(alike + parts[1:], whole)
        for source, target in self.table.items():
            if any(c in self.table for c in target) or target in self.table:
                raise C.MappingConflict(f"{source!r} becomes {target!r}, which is rewritten itself")
        self.longest = max(map(len, self.table))

    def _add(self, source: str, target: str) -> None:
        if self.table.setdefault(source, target) != target:
            raise C.MappingConflict(f"{source!r}: {self.table[source]!r} and {target!r}")

    def __call__(self, s: str) -> str:
        """s rewritten; what no rule covers stays as it is."""
        if any(self.table.get(c) == "" for c in s):  # invisible characters don't part a cluster
            s = "".join(c for c in s if self.table.get(c) != "")
        while (t := self._pass(s)) != s and any(unicodedata.combining(c) for c in t):
            s = t  # a mark behind what a rule wrote: one cluster with its last letter
        return t

    def _pass(self, s: str) -> str:
        out, i, n, table = [], 0, len(s), self.table
        while i < n:
            for size in range(min(self.longest, n - i), 0, -1):
                if (target := table.get(s[i : i + size])) is not None:
                    out.append(target)
                    i += size
                    break
            else:
                out.append(s[i])
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def transducer(in_word: bool) -> Transducer:
    return Transducer(in_word)


@lru_cache(maxsize=1)
def _pattern() -> re.Pattern:
    """A word with something to rewrite, or another character to rewrite."""
    codes = sorted({ord(c) for c in C.rules()} | {ord(c) for m in (C.CYRILLIC_LOOKALIKES, C.CYRILLIC_IN_LATIN_WORDS, C.GREEK_IN_LATIN_WORDS) for c in m})
    listed, at = "", 0
    while at < len(codes):  # ranges: a class of many single characters is slow
        end = at
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        listed += f"\\U{codes[at]:08x}-\\U{codes[end]:08x}"
        at = end + 1
    odd = f"[{listed}{_MARKS}Ѐ-ԯ]"
    return re.compile(f"[^\\W_]*(?:{odd}+[^\\W_]*)+")


_LETTERS = re.compile(rf"[^\W\d_][^\W\d_{_MARKS}]*(?:[{_MARKS}]+[^\W\d_]*)*")


@lru_cache(maxsize=1 << 16)
def _rewrite(word: str, keep: bool) -> str:
    return transducer(not keep)(word)


def consistent_text(s: str) -> str:
    """The consistent form of a running text. Idempotent; plain text stays as it is."""
    if not C.suspicious(s):
        return s

    def word(m: re.Match) -> str:
        w = m[0]
        if w.isascii():
            return w
        if not any("Ͱ" <= c <= "ԯ" for c in w):
            return _rewrite(w, True)
        # each run of letters decides for itself whether it is genuine
        out, at = [], 0
        base = _rewrite(w, True)
        for run in _LETTERS.finditer(base):
            out.append(base[at : run.start()])
            text = run[0]
            cyr = any("Ѐ" <= c <= "ԯ" for c in text)
            grk = any(c in C.GREEK_IN_LATIN_WORDS for c in text) and any(c.isascii() for c in text)
            if cyr:
                before = _neighbour(s, m.start(), -1) if run.start() == 0 else ""
                after = _neighbour(s, m.end(), 1) if run.end() == len(base) else ""
                if not C.keep_cyrillic(text, before, after):
                    text = _rewrite(text, False)
            elif grk:
                text = _rewrite(text, False)
            out.append(text)
            at = run.end()
        return _rewrite("".join(out) + base[at:], True)  # marks compose with the letters chosen

    return _pattern().sub(word, s)


def _neighbour(s: str, at: int, step: int) -> str:
    """The nearest word before or behind a place, within 80 characters, as it will read
    when invisible characters are gone and marks composed."""
    part = s[max(0, at - 80) : at] if step < 0 else s[at : at + 80]
    found = _LETTERS.findall(_rewrite(part, True))
    return (found[-1] if step < 0 else found[0]) if found else ""


def consistent_entity(s: str) -> str:
    return transducer(True)(s) if C.suspicious(s) else s


def _differs(s: str | None, form) -> bool:
    """Whether s is a value and not in its consistent form."""
    if s is None or not s.strip():
        return False
    t = form(s)
    return t != s and bool(t.strip())


@lru_cache(maxsize=1)
def _odd_table() -> np.ndarray:
    table = np.ones(0x110000, bool)
    table[0] = False
    for a, b in C.PLAIN_RANGES:
        table[a : b + 1] = False
    return table


def odd_texts(texts: list[str]) -> np.ndarray:
    """Which of the texts have a character outside the plain set, all at once."""
    out = [np.empty(0, bool)]
    for a, b in V.slices(texts):
        buf, offsets = V.codes(texts[a:b])
        out.append(np.diff(np.concatenate([[0], np.cumsum(_odd_table()[buf], dtype=np.int32)])[offsets]) > 0)
    return np.concatenate(out)


def consistent_texts(texts: list[str | None]) -> list[str | None]:
    """All texts in the consistent form; plain ones, nearly all, are only looked at."""
    odd = odd_texts(["" if t is None else t for t in texts])
    out = list(texts)
    for i in np.flatnonzero(odd):
        out[i] = consistent_text(texts[i])
    return out


def inconsistent_values(chunks: DataFrame) -> DataFrame:
    """(chunk_key, field, pos): each value that is not in the consistent form.

    field 'text' with pos -1, or 'entities' with the element's index from 0. Null and
    blank values are none, invisible characters alone count as blank. Only values with a
    character outside the plain set are rewritten. A repeated row counts once. An empty
    table gives no rows; columns beside chunk_key, text and entities don't matter.
    """
    rows = chunks.select("chunk_key", "text", "entities").where("chunk_key IS NOT NULL")

    def find(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [(keys[i], "text", -1) for i in np.flatnonzero(odd_texts([t or "" for t in texts])) if _differs(texts[i], consistent_text)]
            lists = batch.column(2)
            offsets, owner = lists.offsets.to_numpy(), None
            values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_pylist()
            for at in np.flatnonzero(odd_texts([e or "" for e in values])):
                if _differs(values[at], consistent_entity):
                    owner = int(np.searchsorted(offsets, at + offsets[0], "right")) - 1
                    found.append((keys[owner], "entities", int(at + offsets[0] - offsets[owner])))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32()))], ["chunk_key", "field", "pos"])

    return rows.mapInArrow(find, "chunk_key long, field string, pos int").distinct()


def consistent_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with text and entities in the consistent form; all columns and rows stay.

    Nulls stay null, empty and blank texts keep their length in ordinary blanks.
    """

    def rewrite(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rows = consistent_texts(batch.column(at).to_pylist())
            batch = batch.set_column(at, batch.schema.field(at), pa.array(rows, pa.string()))
            at = batch.schema.get_field_index("entities")
            rows = [None if r is None else [None if e is None else consistent_entity(e) for e in r] for r in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))

    return chunks.mapInArrow(rewrite, chunks.schema)


def catalogued_entities(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """(chunk_key, pos, spelling, name, entity_id): entities in the consistent form and
    their entry in the catalog, compared without case and blanks around; entity_id is -1 and name
    null for entities that are not listed."""
    from paperloom.functions.columns import key_form

    one = consistent_chunks(chunks.select("chunk_key", "text", "entities")).select("chunk_key", "entities").distinct()
    each = one.select("chunk_key", F.posexplode("entities").alias("pos", "spelling")).withColumn("_key", key_form(F.col("spelling"))).where("_key IS NOT NULL")
    return each.join(catalog.select(key_form(F.col("name")).alias("_key"), "name", "entity_id"), "_key", "left").select("chunk_key", "pos", "spelling", "name", F.coalesce("entity_id", F.lit(-1)).alias("entity_id"))
