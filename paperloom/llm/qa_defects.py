"""Broken prompt and response pairs (problem 2).

Language: a character n-gram naive Bayes model for each language, counted over all
questions and answers whose function words make their language plain, gives posteriors
of a question and its answer; they differ when the answer is in another language.
Truncation: over all answers, how often each n-gram of masked tokens ends a text it occurs
in, backing off to its last token; an answer whose end hardly ever ends a text is cut
off. Refusals: a naive Bayes model of word n-grams decides sentence by sentence; phrases
only label the answers, all of them, that it is trained on. Copies: the tokens an
answer adds to its question. All is counted and scored in numpy, a batch at a time; the
counts cover the whole table, and their tables have a fixed size, whatever its length.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import _vec as V
from paperloom.operators.counters import SCHEMA, packed, tree_sum
from paperloom.session import materialize

# Function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and is was were with for that by does how which what why to from at this these our we be are has have not whether".split(),
    "de": "der die das und wurde ist nicht für dass wie warum welche von den bei durch ohne dem ein eine wir auf nach außerdem dazu zuvor jedoch".split(),
    "fr": "le les des et dans est une un pour que quel pourquoi comment été nous avons ces du au aux avec ne pas à sur mais entre".split(),
    "es": "el los las y una por cómo qué ha es se del al con en lo pero entre para estos queda que si de la".split(),
    "pt": "não uma foi mas em os as das dos pelo pela são ao também que com na no nos para células amostras".split(),
    "it": "il di che gli della del ha è nel mentre per con una le dei nella sono anche resta alla".split(),
    "nl": "het een van en niet voor met wordt werd de zijn bij maar ook deze dat cellen".split(),
    "pl": "nie jest się że przez dla oraz po w z na komórek białko jak".split(),
    "sv": "och att det som en är inte för med av på den till".split(),
}
#: Languages told by their letters alone: (name, first, last code point).
SCRIPTS = [("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]
LATIN = list(FUNCTION_WORDS)
NGRAM_BUCKETS = 1 << 14
END_BUCKETS = 1 << 18
REFUSAL_BUCKETS = 1 << 16

# What stands in for an answer that isn't there, in letters and digits only.
STAND_INS = set("""na|n a|none|null|nil|nan|nd|n d|tbd|tba|todo|no answer|not available|not applicable|unknown answer|no data|no data available|no information|no info|not provided|not given|not specified|unspecified|unknown|not known|missing|empty|blank|undefined|void|
 k a|ka|keine angabe|keine angaben|keine antwort|keine daten|nicht verfügbar|unbekannt|o a|s o|entfällt|sans réponse|aucune réponse|pas de réponse|pas de données|inconnu|non disponible|sin respuesta|no disponible|ninguna respuesta|ninguno|sin datos|desconocido|
 nessuna risposta|sem resposta|answer|answers|the answer|response|reply|a|ans|antwort|réponse|respuesta|risposta|resposta|answer here|your answer|your answer here|insert answer|placeholder|pending|no response|no reply|answer pending|to be added|to be determined|to be defined|нет ответа|нет данных|ответ|回答|なし|无|無|答案""".replace("\n", "").replace("| ", "|").split("|"))
_LABELS = r"(?:question|q|query|frage|pregunta|domanda|pergunta|answer|a|antwort|réponse|respuesta|you asked?|prompt|reply|вопрос|ответ)"

# Phrases that mark a refusal, the weak labels.
_REFUSALS = r"""\bi(?:'m| am) (?:sorry|afraid|unable|not able|not in a position)|\bi (?:can't|cannot|can not|could not|couldn't|won't|will not|must decline|do not know|don't know|do not have|don't have|have no basis|decline)|
    \bas an? (?:ai|assistant|language model)|\bunable to (?:provide|answer|help|comment|respond)|\bno answer can be|\bnot answerable|\b(?:cannot|can't|can not) be (?:answered|worked out|determined from|established from|derived from)|
    \b(?:passages|context|excerpts|sources|documents|papers|material|text|information)\b[^.]{0,60}\b(?:silent on|leave this question|does not contain enough|do not contain|insufficient|not enough|says nothing|say nothing|not mention|not address)|
    \binsufficient context|\bnothing in the (?:material|passages|text|excerpts|context)|\bnone of the (?:papers|passages|documents|sources|excerpts) i\b|\breply is not possible|\boutside of what i can|\bi do not have access|\bthere is no mention of\b|
    \bcannot answer|\bno information (?:is|was) (?:given|provided|available) (?:on|about|in)|\bbeyond what i can|\bdecline to answer|
    \bnicht (?:beantworten|sagen|aus(?:reichend)? für)|\bkann ich (?:leider )?(?:nichts|nicht|keine)|\bkeine (?:angaben|antwort|aussage)|\breicht für eine antwort|\bleider (?:kann|nicht|keine)|
    \bne (?:peux|puis) pas|\bne suffit pas|\bne disent rien|\bdésolée?\b|\bimpossible de répondre|\bne permet(?:tent)? pas de répondre|\baucune (?:réponse|information)|
    \bno puedo\b|\blo siento\b|\bno basta para|\bno dicen nada|\bno es posible responder|\bno (?:hay|contiene) (?:suficiente )?información|\bnon posso\b|\bmi dispiace\b|\bnão posso\b|\bdesculpe\b|\bне могу\b|\bк сожалению\b"""
#: A line of phrases is a family.
FAMILIES = [re.compile(line.strip().removesuffix("|"), re.I) for line in _REFUSALS.split("\n")]
_OUTSIDE = " \t\n\r\x0b\x0c.,;:!?()[]\u201c\u201d\"\u00ab\u00bb"
_FINAL = [ord(c) for c in ".!?。！？؟।"]
_CLOSERS = "\"'”’»)]}*_` \t\n\r "
_HANGING = "(,-;:–—/[{“«&+="
_LIST_ITEM = re.compile(r"^(?:[-*•–]|\d+[.)]|\[\d+\])\s*\S")
_LABEL = re.compile(rf"^\W*{_LABELS}\W*[:：]\s*", re.I)
_P = np.uint64(0x9E3779B97F4A7C15)
#: Characters of the end of a text that tell a cut word from a whole one.
SUFFIX = 5
_ENTITY, _BEGIN = np.uint64(0xE), np.uint64(0xB)


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    n = 0x110000
    out = {"out": V.space_table().copy(), "lower": np.arange(n, dtype=np.uint32)}
    out["out"][[0, *map(ord, _OUTSIDE)]] = True
    for name, test in (("digit", str.isdecimal), ("letter", str.isalpha), ("small", str.islower)):
        out[name] = np.fromiter((test(chr(c)) for c in range(n)), bool, n)
    for c in range(0x10000):
        low = chr(c).lower()
        if len(low) == 1:
            out["lower"][c] = ord(low)
    out["capital"] = np.zeros(n, bool)
    out["capital"][[*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] = True
    out["script"] = np.full(n, len(SCRIPTS), np.int8)
    for i, (_, a, b) in enumerate(SCRIPTS):
        out["script"][a : b + 1] = i
    out["script"][[ord(c) for c in "αβγδκμΔ"]] = -1
    return out


def _word_hash(words: list[str]) -> np.ndarray:
    buf, offsets = V.codes(words)
    return V.span_hashes(buf, offsets[:-1], offsets[1:] - 1)


@lru_cache(maxsize=1)
def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and for each the languages that have the word, a point shared among them."""
    words = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
    points = np.array([[w in FUNCTION_WORDS[name] for name in LATIN] for w in words], float)
    points /= points.sum(1, keepdims=True)
    h = _word_hash(words)
    order = np.argsort(h)
    return h[order], points[order]


def _per_text(owner: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, values, n)


class Tokens:
    """The masked tokens of a batch of texts, as flat arrays in order: words, single signs,
    line ends, and names, codes and numbers, all of which are one and the same token."""

    def __init__(self, texts: list[str]):
        t = _tables()
        self.n = len(texts)
        self.buf, self.offsets = V.codes(texts)
        buf = self.buf
        before = lambda a: np.concatenate([np.zeros(1, np.int32), np.cumsum(a, dtype=np.int32)])
        alnum, space, capital = V.alnum_table()[buf], V.space_table()[buf], t["capital"][buf]
        a, b = V.runs(~t["out"][buf])
        digits, pairs = before(t["digit"][buf]), before(capital & np.append(capital[1:], False))
        odd = (digits[b] > digits[a]) | (pairs[np.maximum(a, b - 1)] > pairs[a])
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[a[odd]] += 1
        edge[b[odd]] -= 1
        self.masked = np.cumsum(edge[:-1], dtype=np.int8) > 0
        words = V.runs(alnum & ~self.masked)
        signs = np.flatnonzero((~(alnum | space | (buf == 95) | (buf == 0)) & ~self.masked) | (buf == 10))
        starts = np.concatenate([words[0], a[odd], signs])
        order = np.argsort(starts, kind="stable")
        self.starts, self.stops = starts[order], np.concatenate([words[1], b[odd], signs + 1])[order]
        kind = np.repeat([0, 1, 2], [len(words[0]), int(odd.sum()), len(signs)])[order]
        self.word, self.entity = kind == 0, kind == 1
        self.lower = t["lower"][buf]
        self.h = np.where(self.entity, _ENTITY, V.span_hashes(buf, self.starts, self.stops))
        self.owner = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.letters = t["letter"][buf] & ~self.masked

    def lower_words(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of all runs of letters and digits, lower-cased, masked ones too."""
        a, b = V.runs(V.alnum_table()[self.buf])
        return np.searchsorted(self.offsets, a, "right") - 1, V.span_hashes(self.lower, a, b)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of the character trigrams of the unmasked words, borders included."""
        c = np.where(self.buf == 0, np.uint32(0), np.where(self.letters, self.lower, np.uint32(32)))
        previous = np.concatenate([[np.uint32(32)], c[:-1]])
        keep = ~((c == 32) & ((previous == 32) | (previous == 0)))
        keep[0] = True
        # a border before a text's first word and behind its last
        at = np.flatnonzero(keep)
        c = c[at]
        first = (c != 0) & (c != 32) & np.concatenate([[True], c[:-1] == 0])
        last = (c == 0) & np.concatenate([[False], (c[:-1] != 32) & (c[:-1] != 0)])
        insert = np.concatenate([np.flatnonzero(first), np.flatnonzero(last)])
        b = np.insert(c, insert, 32).astype(np.uint64)
        text = np.insert(np.searchsorted(self.offsets, at, "right") - 1, insert, np.concatenate([np.searchsorted(self.offsets, at[first], "right") - 1, np.searchsorted(self.offsets, at[last], "right") - 1]))
        if len(b) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            h = V.mix((b[:-2] * np.uint64(0x1F123BB5) + b[1:-1]) * np.uint64(0x5F356495) + b[2:])
        ok = np.flatnonzero((b[:-2] > 0) & (b[1:-1] > 0) & (b[2:] > 0))
        return text[ok], (h[ok] & np.uint64(NGRAM_BUCKETS - 1)).astype(np.int64)

    def plain_language(self) -> np.ndarray:
        """Index in LATIN of the language that each text's function words make plain, or -1."""
        hashes, points = _function_words()
        owner, h = self.lower_words()
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[at] == h
        score = np.stack([_per_text(owner[hit], self.n, points[at[hit], i]) for i in range(len(LATIN))], 1)
        order = np.sort(score, axis=1)
        return np.where((order[:, -1] >= 2) & (order[:, -1] >= 1.5 * order[:, -2]), score.argmax(1), -1)

    def script(self) -> tuple[np.ndarray, np.ndarray]:
        """Index in SCRIPTS of the letters most of each text's words are made of, or -1 for
        Latin; and the number of unmasked letters."""
        kind = _tables()["script"][self.buf]
        text = lambda at: np.searchsorted(self.offsets, at, "right") - 1
        letters = _per_text(text(np.flatnonzero(self.letters & (kind >= 0))), self.n)
        out = np.full(self.n, -1)
        other = np.flatnonzero(self.letters & (kind >= 0) & (kind < len(SCRIPTS)))
        counts = np.zeros((self.n, len(SCRIPTS)))
        np.add.at(counts, (text(other), kind[other]), 1)
        best = counts.argmax(1)
        most = counts[np.arange(self.n), best]
        out[most * 2 > letters] = best[most * 2 > letters]
        return out, letters + _per_text(text(np.flatnonzero(self.letters & (kind < 0))), self.n)

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, bigram, text, whether it ends its text): buckets of each token and of it
        with the one before."""
        first = np.ones(len(self.h), bool)
        first[1:] = self.owner[1:] != self.owner[:-1]
        previous = np.where(first, _BEGIN, np.concatenate([[_BEGIN], self.h[:-1]]))
        last = np.append(first[1:], True) if len(first) else first
        with np.errstate(over="ignore"):
            two = V.mix(previous * _P + self.h)
        bucket = lambda h: (h & np.uint64(END_BUCKETS - 1)).astype(np.int64)
        return bucket(V.mix(self.h)), bucket(two), self.owner, last

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, end) of the runs of SUFFIX characters that are all in their text and end in
        an unmasked letter."""
        c = self.lower.astype(np.uint64)
        if len(c) < SUFFIX:
            return (np.empty(0, np.int64),) * 3
        h = np.zeros(len(c) - SUFFIX + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(SUFFIX):
                h = h * _P + c[i : len(c) - SUFFIX + 1 + i]
            h = V.mix(h + np.uint64(5))
        text = np.searchsorted(self.offsets, np.arange(len(h)), "right") - 1
        at = np.flatnonzero((np.searchsorted(self.offsets, np.arange(len(h)) + SUFFIX - 1, "right") - 1 == text) & self.letters[SUFFIX - 1 :])
        return text[at], (h[at] & np.uint64(END_BUCKETS - 1)).astype(np.int64), at + SUFFIX

    def sentences(self) -> tuple[np.ndarray, np.ndarray]:
        """(sentence of each token, text of each sentence): cuts behind . ! ? and blanks, and
        at line ends."""
        gap = np.ones(len(self.h), bool)
        gap[1:] = self.starts[1:] > self.stops[:-1]
        final = np.isin(self.buf[np.maximum(self.stops - 1, 0)], _FINAL) & ~self.word & ~self.entity
        new = np.ones(len(self.h), bool)
        line = self.buf[self.starts] == 10 if len(self.h) else np.empty(0, bool)
        new[1:] = (self.owner[1:] != self.owner[:-1]) | (final[:-1] & gap[1:]) | line[:-1] | line[1:]
        number = np.cumsum(new) - 1
        return number, self.owner[new]

    def refusal_features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, bucket, text of each sentence, words of each sentence): word n-grams."""
        sentence, text = self.sentences()
        at = np.flatnonzero(self.word)
        h, s = V.mix(V.span_hashes(self.lower, self.starts[at], self.stops[at])), sentence[at]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        with np.errstate(over="ignore"):
            two, three = V.mix(h[:-1] * _P + h[1:]), V.mix((h[:-2] * _P + h[1:-1]) * _P + h[2:] + np.uint64(3))
            opening = V.mix(h[first] + np.uint64(99))
        same = s[1:] == s[:-1]
        same3 = same[1:] & same[:-1]
        bucket = (np.concatenate([h, two[same], three[same3], opening]) & np.uint64(REFUSAL_BUCKETS - 1)).astype(np.int64)
        words = np.bincount(sentence[self.word | self.entity], minlength=len(text)) if len(text) else np.empty(0, np.int64)
        return np.concatenate([s, s[1:][same], s[2:][same3], s[first]]), bucket, text, words


def families(answer: str) -> list[int]:
    """The phrase families that mark a text as a refusal: weak labels, for training alone."""
    text = re.sub(r"[’ʼ]", "'", answer)
    return [i for i, p in enumerate(FAMILIES) if p.search(text)]


def refusal_label(answer: str) -> int:
    return int(bool(families(answer)))


def partial_label(answer: str) -> int:
    """Labels of every other family; -1, not trained on, for what only the rest mark."""
    found = families(answer)
    return int(any(i % 2 == 0 for i in found)) if any(i % 2 == 0 for i in found) or not found else -1


def _stripped(answers: list[str | None]) -> list[str]:
    return ["" if a is None else a.strip() for a in answers]


def _counts(pairs: DataFrame, labels=refusal_label) -> dict[str, np.ndarray]:
    """All models' counts, over all distinct pairs (question, answer); refusals over the answers
    that ``labels`` tells apart (-1 for none). Arrays of fixed size, summed in a tree."""
    sizes = {"language": len(LATIN) * NGRAM_BUCKETS, "end": 6 * END_BUCKETS, "refusal": 2 * REFUSAL_BUCKETS}
    bounds = np.cumsum([0, *sizes.values()])

    def run(batches):
        total = np.zeros(bounds[-1], np.int32)
        language, end, refusal = (total[a:b] for a, b in zip(bounds[:-1], bounds[1:]))
        for batch in batches:
            questions, answers = (c.to_pylist() for c in batch.columns)
            texts = [q or "" for q in questions] + [a or "" for a in answers]
            for a, b in V.slices(texts):
                t = Tokens(texts[a:b])
                known, (doc, bucket) = t.plain_language(), t.trigrams()
                ok = known[doc] >= 0
                language += np.bincount(known[doc[ok]] * NGRAM_BUCKETS + bucket[ok], minlength=len(language)).astype(np.int32)
            answers = _stripped(answers)
            for a, b in V.slices(answers):
                t = Tokens(answers[a:b])
                one, two, owner, last = t.ends()
                doc, chars, stop = t.suffixes()
                within = lambda x, owner: np.unique(owner * END_BUCKETS + x) % END_BUCKETS
                for i, at in enumerate((within(one, owner), within(two, owner), one[last], two[last], chars, chars[stop == t.offsets[doc + 1] - 1])):
                    end[i * END_BUCKETS : (i + 1) * END_BUCKETS] += np.bincount(at, minlength=END_BUCKETS).astype(np.int32)
                kind = np.array([labels(x) for x in answers[a:b]], np.int64)
                sentence, bucket, text, _ = t.refusal_features()
                owner = kind[text[sentence]]
                refusal += np.bincount(owner[owner >= 0] * REFUSAL_BUCKETS + bucket[owner >= 0], minlength=len(refusal)).astype(np.int32)
        yield packed(total, 4)

    parts = materialize(pairs.mapInArrow(run, SCHEMA), "p2-counts")
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    total = tree_sum(parts, tasks, int(bounds[-1]), 4)
    return {n: total[a:b] for n, a, b in zip(sizes, bounds[:-1], bounds[1:])}


class Models:
    def __init__(self, counts: dict[str, np.ndarray]):
        c = counts["language"].reshape(len(LATIN), NGRAM_BUCKETS).astype(float)
        self.seen = c.sum(1) >= 200  # a language of a few n-grams has no model
        self.language = np.log((c + 0.1) / (c.sum(1, keepdims=True) + 0.1 * NGRAM_BUCKETS))
        self.one, self.two, self.end_one, self.end_two, self.chars, self.end_chars = counts["end"].reshape(6, -1).astype(float)
        self.base = (self.end_one.sum() + 1) / (self.one.sum() + 2)
        share = self.end_one / max(1.0, self.end_one.sum())
        #: How likely a usual last token is to end a text.
        self.usual = float((share * self.end_one / np.maximum(1, self.one)).sum())
        r = counts["refusal"].reshape(2, -1).astype(float)
        prior = 0.4 * r.sum(1, keepdims=True) / max(1.0, r.sum())  # what neither kind has says nothing
        rate = (r + prior) / np.maximum(1e-9, r.sum(1, keepdims=True) + prior * REFUSAL_BUCKETS)
        self.refusal = np.log(rate[1]) - np.log(rate[0]) if r[1].any() and r[0].any() else None

    def language_scores(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) log likelihoods, and the number of n-grams."""
        doc, bucket = t.trigrams()
        scores = np.stack([_per_text(doc, t.n, row[bucket]) for row in self.language], 1)
        scores[:, ~self.seen] = -np.inf
        return scores, _per_text(doc, t.n)

    def end_likelihood(self, t: Tokens) -> np.ndarray:
        """How likely a text ends where each one does, given its last tokens and, where it
        ends in a letter, its last characters: the less of both. 1 for none."""
        one, two, text, last = t.ends()
        final = np.full(t.n, -1)
        final[text[last]] = np.flatnonzero(last)
        known = np.flatnonzero(final >= 0)
        at = final[known]
        # texts that hold an n-gram and texts it ends; the text itself doesn't count
        p = np.maximum(0, self.end_one[one[at]] - 1 + 2 * self.base) / np.maximum(1e-9, self.one[one[at]] - 1 + 2)
        out = np.ones(t.n)
        out[known] = np.maximum(0, self.end_two[two[at]] - 1 + 2 * p) / np.maximum(1e-9, self.two[two[at]] - 1 + 2)
        doc, chars, stop = t.suffixes()
        ends = np.flatnonzero(stop == t.offsets[doc + 1] - 1)
        mine = np.full(t.n, -1)
        mine[doc[ends]] = chars[ends]
        same = _per_text(doc[chars == mine[doc]], t.n)[doc[ends]]
        p = np.maximum(0, self.end_chars[chars[ends]] - 1 + 2 * self.base) / np.maximum(1e-9, self.chars[chars[ends]] - same + 2)
        out[doc[ends]] = np.minimum(out[doc[ends]], np.where(t.word[final[doc[ends]]], p, 1))
        return out

    def refusing(self, t: Tokens, least: float = 0.2) -> np.ndarray:
        """Which texts only say that no answer can or will be given: at least two thirds of
        their words are in sentences whose n-grams speak for a refusal."""
        if self.refusal is None:
            return np.zeros(t.n, bool)
        sentence, bucket, text, words = t.refusal_features()
        n = np.bincount(sentence, minlength=len(text))
        odds = np.bincount(sentence, self.refusal[bucket], len(text)) / np.maximum(1, n)
        refused = _per_text(text[odds > least], t.n, words[odds > least])
        return (refused > 0) & (refused >= 2 * (_per_text(text, t.n, words) - refused))


def empty(t: Tokens) -> np.ndarray:
    """Which texts have no letter or digit, or only what stands in for an answer."""
    owner, h = t.lower_words()
    n = _per_text(owner, t.n)
    out = n == 0
    for i in np.flatnonzero((n > 0) & (n <= 4)):
        text = "".join(map(chr, t.buf[t.offsets[i] : t.offsets[i + 1] - 1]))
        out[i] = " ".join(x.lower() for x in re.findall(r"[^\W_]+", text)) in STAND_INS
    return out


def copies(questions: list[str], answers: list[str]) -> np.ndarray:
    """Which answers repeat their question, perhaps slightly changed, and add nothing."""
    n = len(questions)
    answers = [_LABEL.sub("", a) if ":" in a[:40] or "：" in a[:40] else a for a in answers]
    sets, sizes, owners = [], [], []
    for texts in (questions, answers):
        owner, h = Tokens(texts).lower_words()
        with np.errstate(over="ignore"):
            sets.append(V.mix(h + V.mix(owner.astype(np.uint64))))
        owners.append(owner)
        sizes.append(_per_text(owner, n))
    known, first = np.unique(sets[0], return_index=True)
    at = np.minimum(np.searchsorted(known, sets[1]), max(0, len(known) - 1))
    old = known[at] == sets[1] if len(known) else np.zeros(len(sets[1]), bool)
    new = _per_text(owners[1][~old], n)
    kept = np.unique(at[old])
    share = _per_text(owners[0][first[kept]], n) / np.maximum(1, _per_text(owners[0][first], n))
    q, a = sizes
    return (q >= 3) & (a >= 3) & (((share >= 0.8) & (new <= np.maximum(1, q // 5))) | ((share >= 0.7) & (new == 0) & (a >= 0.7 * q)))


def truncated(answers: list[str], models: Models) -> np.ndarray:
    """Which of the stripped answers stop before their end."""
    t = Tokens(answers)
    likely = models.end_likelihood(t)
    words = _per_text(t.lower_words()[0], t.n)
    last = np.searchsorted(t.owner, np.arange(t.n), "right") - 1
    out = np.zeros(t.n, bool)
    for i, s in enumerate(answers):
        core = s.rstrip(_CLOSERS)
        if not core:
            continue
        if core.endswith(("…", "...")):  # says itself that something is left out
            out[i] = words[i] >= 3
        elif s[-1] in _HANGING:  # what it opens or joins is missing
            out[i] = words[i] >= 2
        elif ord(core[-1]) in _FINAL:
            out[i] = likely[i] < 0.02 * models.usual
        elif "\n" in s and _LIST_ITEM.match(s[s.rindex("\n") + 1 :].strip()) and likely[i] > 0.01:
            pass  # a list or its references
        elif words[i] <= 8:  # names, numbers and their units end short answers
            near = t.entity[max(0, last[i] - 1) : last[i] + 1].any() or s[-1] in ")]"
            out[i] = words[i] >= 2 and likely[i] < 0.01 and not near
        else:
            out[i] = likely[i] < 0.9
    return out


DEFECTS = ["empty", "copies_question", "refusal", "other_language", "truncated"]


def classify(pairs: list[tuple[str | None, str | None]], models: Models) -> list[str | None]:
    """Each pair's defect, or None."""
    questions, answers = [q or "" for q, _ in pairs], _stripped([a for _, a in pairs])
    out: list[str | None] = []
    for x, y in V.slices([q + a for q, a in zip(questions, answers)]):
        qs, as_ = questions[x:y], answers[x:y]
        q, a = Tokens(qs), Tokens(as_)
        (sq, nq), (sa, na) = models.language_scores(q), models.language_scores(a)
        (script_q, _), (script_a, letters) = q.script(), a.script()
        best = sq.argmax(1)
        with np.errstate(invalid="ignore"):  # without a model there is no verdict
            # the answer's posterior odds against the question's language
            odds = np.nan_to_num(sa.max(1) - sa[np.arange(len(qs)), best], nan=0)
        judged = (script_q < 0) & (nq >= 8) & (na >= 12) & np.isfinite(sq).any(1)
        asked = np.array([bool(s.strip()) for s in qs])
        other = asked & np.where(script_q != script_a, letters >= 4, judged & (odds > 6 + 0.02 * na))
        found = np.stack([empty(a), copies(qs, as_), models.refusing(a), other, truncated(as_, models)], 1)
        out += [DEFECTS[row.argmax()] if row.any() else None for row in found]
    return out


def _pairs(questions: DataFrame) -> DataFrame:
    return questions.where("question_id IS NOT NULL").select(F.col("question_id").cast("long").alias("question_id"), "question", "answer").distinct()


def defects(questions: DataFrame) -> DataFrame:
    """(question_id, defect) of the pairs of eval_questions whose answer is unusable.

    defect is one of 'empty', 'copies_question', 'refusal', 'other_language' and
    'truncated', the first that holds in this order. A null answer is empty; with a null
    or blank question only its answer is judged. Rows that repeat a question_id count
    once; null ids are dropped. An empty table gives no rows, other columns don't matter.
    """
    pairs = materialize(_pairs(questions), "p2-pairs")
    counts = _counts(pairs.select("question", "answer"))
    models = questions.sparkSession.sparkContext.broadcast(counts)
    loaded: dict[str, Models] = {}

    def run(batches):
        if "m" not in loaded:
            loaded["m"] = Models(models.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = classify(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())), loaded["m"])
            keep = [i for i, d in enumerate(found) if d]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([found[i] for i in keep], pa.string())], ["question_id", "defect"])

    return pairs.mapInArrow(run, "question_id long, defect string").distinct()


def refusal_validation(questions: DataFrame) -> DataFrame:
    """(setting, n, found, precision, recall) of the refusal model over all answers but
    empty ones.

    'all phrases': the model as it is, against the labels it was trained on. 'unseen
    phrases': trained on the labels of every other family, recall over the answers that
    only the other families mark, none of which it was trained on; precision against all.
    """
    pairs = materialize(_pairs(questions).where("trim(answer) <> ''").select("question", "answer"), "p2-answers")
    rows = None
    for setting, labels in (("all phrases", refusal_label), ("unseen phrases", partial_label)):
        model = questions.sparkSession.sparkContext.broadcast(_counts(pairs, labels))

        def run(batches, model=model, labels=labels):
            m = Models(model.value)
            for batch in batches:
                answers = _stripped(batch.column(1).to_pylist())
                found, marked = m.refusing(Tokens(answers)), [bool(families(a)) for a in answers]
                judged = [k if labels is refusal_label else labels(a) < 0 for k, a in zip(marked, answers)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (found.astype(int), np.array(marked, int), np.array(judged, int))], ["found", "marked", "judged"])

        part = pairs.mapInArrow(run, "found long, marked long, judged long").agg(
            F.lit(setting).alias("setting"),
            F.coalesce(F.sum("judged"), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.col("judged") * F.col("found")), F.lit(0)).alias("found"),
            F.try_divide(F.sum(F.col("found") * F.col("marked")), F.sum("found")).alias("precision"),
            F.try_divide(F.sum(F.col("judged") * F.col("found")), F.sum("judged")).alias("recall"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows
